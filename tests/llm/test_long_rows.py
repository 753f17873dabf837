"""Positions of large tables, and texts of a megabyte and more."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tests.llm.test_operators import documents

from lumenshelf.llm import hilbert, packing


@pytest.mark.parametrize("total", [1, 5, 23, 24, 25, 1000, 10**8, 10**10 + 7, 10**12, 10**15 + 1])
def test_runs_have_no_gap_at_any_size(spark, total):
    shards = 24
    start = [-(-s * total // shards) for s in range(shards + 1)]
    at = sorted({p for b in start for p in range(b - 2, b + 3) if 0 <= p < total} | {0, total - 1, total // 2})
    shard, slot = hilbert.runs_of("at", total, shards)
    found = spark.createDataFrame([(p,) for p in at], "at long").select("at", shard.alias("shard"), slot.alias("slot")).collect()
    for r in found:
        assert start[r.shard] <= r["at"] < start[r.shard + 1] and r["slot"] == r["at"] - start[r.shard]
    sizes = np.diff(start)
    assert sizes.max() - sizes.min() <= 1


LONG = {
    "spaces": " " * 1_000_000, "newlines": "\n" * 1_000_000 + "a", "tabs": "\t " * 500_000, "letter": "x" * 1_000_000, "prose": "the cat sat, on 12 mats.\n" * 40_000, "more spaces": " " * 10_000_000,
}


@pytest.fixture(scope="module")
def exact():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(public_tokenizers.path(packing.VOCABULARY)))


@pytest.mark.parametrize("name", LONG)
def test_long_texts_have_the_tokenizer_s_ids(exact, name):
    assert packing.encoder()(LONG[name]) == exact.encode(LONG[name], add_special_tokens=False).ids


def test_packing_long_white_space(spark, exact):
    rows = list(enumerate([*list(LONG.values())[:4], "short", None]))
    pieces = defaultdict(list)
    for r in packing.pack_sequences(documents(spark, rows)).collect():
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for i, text in rows:
        ids = np.array(exact.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for start, length, crc, tokens in sorted(pieces[i]):
            assert start == at and tokens == len(ids) and zlib.crc32(ids[start : start + length].tobytes()) == crc
            at += length
        assert at == len(ids)
