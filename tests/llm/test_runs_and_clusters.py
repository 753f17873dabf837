"""Periodic runs and ball k-means against brute force and SQL."""

from __future__ import annotations

import random

import numpy as np
import pytest
from tests.llm import brute
from tests.llm.test_operators import documents, result
from tests.support import differences

from lumenshelf.llm import ball_kmeans, queries, runs, textkernel

DIGEST = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def periodic(rng, n):
    """Words with runs of several periods, nested and touching."""
    out = []
    while len(out) < n:
        unit = [f"w{rng.randrange(4)}" for _ in range(rng.randrange(1, 9))]
        out += (unit * 20)[: rng.randrange(1, 60)]
    return " ".join(out[:n])


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    rows = [(i, periodic(rng, rng.randrange(0, 200))) for i in range(60)]
    fib = ["a", "a b"]
    while len(fib[-1]) < 400:
        fib.append(f"{fib[-1]} {fib[-2]}")
    rows += [(60, None), (61, ""), (62, " \t\n"), (63, "x"), (64, "x " * 500), (65, fib[-1]), (66, rows[3][1]), (67, "\t".join("é ü é ü é ü é ü é ü é ü".split())), (68, "A a " * 20), (69, "x " * 11), (70, "x " * 12)]
    return rows + [(i, " ".join(str(rng.randrange(10**6)) for _ in range(300))) for i in range(71, 120)]


def test_runs(spark, texts):
    docs = documents(spark, texts)
    got = result(runs.run_digests(runs.periodic_runs(runs.with_planted_periods(docs))), "doc_id", *DIGEST)
    assert got == brute.run_digests(texts)


@pytest.mark.parametrize("min_length", [1, 2, 5, 30])
def test_runs_of_other_lengths(spark, texts, min_length):
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in runs.periodic_runs(documents(spark, texts), min_length).collect()}
    assert got == {i: brute.runs(brute.words(t), min_length) for i, t in texts}


def test_runs_of_repeated_rows_and_no_rows(spark):
    rows = [(None, "a " * 20), (1, "a " * 20), (1, "b c " * 9), (1, "b c " * 9)]
    found = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(runs.with_planted_periods(documents(spark, rows))).collect())
    assert found == [("1", 18, [(0, 18, 2)], "b c")] * 2 + [("1", 20, [(0, 20, 1)], "a"), ("None", 20, [(0, 20, 1)], "a")]
    assert runs.run_digests(runs.periodic_runs(runs.with_planted_periods(documents(spark, [])))).collect() == []


def test_a_very_long_text(spark):
    unit = " ".join(str(i) for i in range(50_000))
    rows = [(7, f"start {unit} {unit} {unit} {' '.join(['z'] * 300_000)}"), (8, "y" * 2_000_000), (9, " " * 2_000_000)]
    found = {r.doc_id: [tuple(x) for x in r.runs] for r in runs.periodic_runs(documents(spark, rows)).collect()}
    assert found == {7: [(1, 150_000, 50_000), (150_001, 300_000, 1)], 8: [], 9: []}


def test_words_that_share_a_hash():
    data = np.frombuffer(b"ab cd ab ef cd", np.uint8)
    ws, we, _ = textkernel.words(data, np.array([0, len(data)]))
    same = np.zeros(len(ws), np.uint64)
    ids = textkernel.word_ids(data, ws, we, same)
    assert ids.tolist() == [0, 1, 0, 2, 1]


def vectors(rng, n, centers=9):
    base = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(centers)]
    return [(i, [x + rng.gauss(0, 0.25) for x in base[rng.randrange(centers)]]) for i in range(n)]


def clustered(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).selectExpr("*", "1 as cluster", "'x' as v", "2 as n")
    return sorted((tuple(r) for r in ball_kmeans.ball_kmeans(df, **how).collect()), key=repr)


def singles(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def test_clusters(spark):
    rng = random.Random(12)
    rows = vectors(rng, 150)
    bad = [(900, None), (901, []), (902, [None] * 64), (903, [float("nan")] * 64), (904, [float("inf")] + [0.0] * 63), (905, [0.5] * 63), (906, [0.5] * 65)]
    ties = [(i, rows[0][1]) for i in range(1000, 1030)] + [rows[5], rows[5], (None, [0.25] * 64), (None, [0.25] * 64)]
    assert clustered(spark, rows + bad + ties) == brute.clusters(singles(rows + bad + ties))


@pytest.mark.parametrize("n", [1, 3, 8, 9])
def test_few_vectors(spark, n):
    rows = vectors(random.Random(n), n)
    assert clustered(spark, rows) == brute.clusters(singles(rows))


def test_all_vectors_equal_and_none(spark):
    rows = [(i, [0.5] * 64) for i in range(40)]
    assert clustered(spark, rows) == brute.clusters(rows)
    assert clustered(spark, []) == []


def test_large_components_take_no_part(spark):
    rows = vectors(random.Random(2), 20)
    assert clustered(spark, rows + [(99, [1e30] + [0.0] * 63), (98, [2.0**17] * 64)]) == brute.clusters(singles(rows))


def test_core_members_are_not_compared():
    rng = np.random.default_rng(3)
    centers = rng.integers(-1000, 1000, (12, 64))
    label = rng.integers(0, 12, 3000)
    x = centers[label] + rng.integers(-40, 41, (3000, 64))
    cluster, distance, compared = ball_kmeans.Gaps(centers).move(x, label.astype(np.int32))
    exact = ((x[:, None, :] - centers[None]) ** 2).sum(2)
    assert (cluster == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    assert compared < 1.1 * len(x)


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_ball_kmeans"])
def test_sql(spark, sf_dir, name):
    assert differences(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name], sf_dir) == ""
