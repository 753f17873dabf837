"""The partition join against all pairs, with families of texts around the threshold."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from tests.llm import brute
from tests.llm.test_operators import corpus, documents, result  # noqa: F401
from tests.support import differences

from lumenshelf.llm import confirm, partition_join, queries


def components(rows, percent, k):
    """{doc_id: (n_shingles, component_id)} by comparing all pairs."""
    return {i: found[:2] for i, found in brute.near(rows, percent, k).items()}


def families(seed, groups=8, members=14):
    """Groups of texts that share part of their lines, from hardly to nearly all, and chains of small changes."""
    rng = random.Random(seed)

    def line():
        return " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(1, 9)))

    rows = []
    for g in range(groups):
        base = [line() for _ in range(rng.choice([1, 2, 4, 20, 60]))]
        chain = rng.random() < 0.3
        changes = rng.choice([0.01, 0.03, 0.06, 0.1, 0.3])
        now = base
        for _ in range(members):
            now = [line() if rng.random() < changes else x for x in (now if chain else base)]
            if rng.random() < 0.2:
                now = now[: max(1, len(now) - 1)]
            rows.append(" ".join(now))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,percent,k", [(1, 85, 4), (2, 80, 5), (3, 60, 2), (4, 95, 1)])
def test_against_all_pairs(spark, seed, percent, k):
    rows = families(seed)
    got = result(partition_join.similar_sets(documents(spark, rows), percent, k), "doc_id", "n_shingles", "component_id")
    assert got == components(rows, percent, k)


def test_corpus(spark, corpus):  # noqa: F811
    got = result(partition_join.similar_sets(documents(spark, corpus), 85, 4), "doc_id", "n_shingles", "component_id")
    assert got == components(corpus, 85, 4)


def test_blocks_of_few_shingles(spark, monkeypatch):
    """A bucket whose sets are not all linked is compared in pairs of blocks, with the same result."""
    monkeypatch.setattr(confirm, "BLOCK_SHINGLES", 400)
    monkeypatch.setattr(confirm, "STAR", 3)
    rng = random.Random(9)
    base = [f"c{i}" for i in range(120)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = result(partition_join.similar_sets(documents(spark, rows), 85, 4), "doc_id", "n_shingles", "component_id")
    assert got == components(rows, 85, 4)


def test_null_repeated_and_no_rows(spark):
    rows = [(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "A B c d e"), (3, None), (4, ""), (5, " \t"), (6, "a b"), (7, "A B"), (8, "b a")]
    found = partition_join.similar_sets(documents(spark, rows), 85, 4).collect()
    assert sorted(map(tuple, found), key=repr) == sorted([(None, 2, None), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6), (8, 1, 8)], key=repr)
    assert partition_join.similar_sets(documents(spark, []), 85, 4).collect() == []


def test_very_long_texts(spark):
    words = [f"n{i}" for i in range(60_000)]
    changed = [w if i % 300 else "changed" for i, w in enumerate(words)]
    far = [w if i % 40 else "changed" for i, w in enumerate(words)]
    rows = [(5, " ".join(words)), (3, " ".join(changed)), (4, " ".join(far)), (9, " " * 1_500_000), (10, "q" * 1_500_000), (11, "q" * 1_500_000 + " ")]
    got = result(partition_join.similar_sets(documents(spark, rows), 85, 4), "doc_id", "n_shingles", "component_id")
    assert got == components(rows, 85, 4)
    assert got[5][1] == 3 and got[4][1] in (3, 4) and got[11][1] == 10


def test_segments_outnumber_the_differences():
    """In every band a linked pair differs in less segments than the larger set must look at."""
    for percent in (50, 60, 80, 85, 95):
        bands = partition_join.Bands(percent)
        size = np.arange(1, 3000)
        own, below = bands.roles(size)
        for r in size[::7]:
            for s in range(-(-r * percent // 100), r + 1):
                least = -(-percent * (r + s) // (100 + percent))
                differ = r + s - 2 * least
                if differ <= 0 or least > s:
                    continue
                at = [role for role in (own, below) if role[0][r - 1] == np.searchsorted(bands.low, s, "right") - 1][0]
                assert at[1][r - 1] >= at[2][r - 1] > differ


def test_sets_are_told_apart_by_words(monkeypatch):
    """With all hashes equal, words still decide."""
    monkeypatch.setattr(confirm, "word_hashes", lambda data, ws, we: np.zeros(len(ws), np.uint64))
    sets = confirm.exact_sets(pa.array(["a b c", "A b c", "a c b", "a", None, "a b c a b c"], pa.large_string()), 2)
    assert [len(s) for s in sets] == [2, 2, 2, 1, 0, 3]
    assert set(sets[0]) == set(sets[1]) and set(sets[0]) <= set(sets[5]) and not set(sets[0]) & set(sets[2])


def test_sql(spark, sf_dir):
    assert differences(queries.queries()["op13_jaccard_join"](spark, sf_dir), queries.oracle_sql()["op13_jaccard_join"], sf_dir) == ""
