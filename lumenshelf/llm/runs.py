"""Periodic runs of words in each document.

A run of at least `min_length` words and twice its period q repeats itself for
max(q, min_length - q) words, which is at least half of min_length. So every
word of a run lies in a k-gram, k = ceil(min_length / 2), that occurs again in
its document. Words outside such k-grams are masked, and the search of Main
and Lorentz runs only on the segments that survive: each is halved, the runs
that cross its middle come from common extensions to both sides of the
middle, and the halves follow. All segments of a batch go through one level
at a time. Extensions are compared on ranks of words and of words doubled,
which are equal only where the words are: no hash decides on a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import U, chunks, joined_words, mix, utf8, word_hashes, word_ids


def spans(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place from 0) of each item of ranges with these lengths."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def surviving_segments(ids: np.ndarray, docs: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each stretch of words that repeated k-grams cover and that is long enough for a run."""
    k = -(-min_length // 2)
    m = len(ids) - k + 1
    none = np.zeros(0, np.int64)
    if m <= 0:
        return none, none
    at = np.flatnonzero(docs[:m] == docs[k - 1 :])
    # Equal hashes of different k-grams only spare words from the mask.
    gram = mix(docs[at].astype(U) + U(1))
    for j in range(k):
        gram = mix(gram * U(5) + ids[at + j].astype(U))
    order = np.argsort(gram, kind="stable")
    same = gram[order][1:] == gram[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, at[again], 1)
    np.add.at(edge, at[again] + k, -1)
    covered = np.cumsum(edge)[:-1] > 0
    first, last = covered.copy(), covered.copy()
    turn = docs[1:] != docs[:-1]
    first[1:] &= ~covered[:-1] | turn
    last[:-1] &= ~covered[1:] | turn
    lo, hi = np.flatnonzero(first), np.flatnonzero(last) + 1
    long_enough = hi - lo >= min_length
    return lo[long_enough], hi[long_enough]


class Extensions:
    """How far two places of a sequence agree to the right and to the left, by ranks of its stretches of 1, 2, 4, ... items."""

    def __init__(self, items: np.ndarray, longest: int):
        self.n = len(items)
        self.ranks = [items.astype(np.int32)]
        while 1 << len(self.ranks) <= longest:
            half, last = 1 << (len(self.ranks) - 1), self.ranks[-1].astype(np.int64)
            _, rank = np.unique(last[:-half] * (self.n + 1) + last[half:], return_inverse=True)
            self.ranks.append(rank.astype(np.int32))

    def equal(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the stretches of 2**level items from a and from b are the same; False where one leaves the sequence."""
        rank, most = self.ranks[level], len(self.ranks[level]) - 1
        inside = (a >= 0) & (b >= 0) & (a <= most) & (b <= most)
        return inside & (rank[np.clip(a, 0, most)] == rank[np.clip(b, 0, most)])

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Items from a on that agree with those from b on."""
        got = np.zeros(len(a), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            got += self.equal(level, a + got, b + got).astype(np.int64) << level
        return got

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Items before a that agree with those before b."""
        got = np.zeros(len(a), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            size = 1 << level
            got += self.equal(level, a - got - size, b - got - size).astype(np.int64) << level
        return got


def main_lorentz(items: np.ndarray, lo: np.ndarray, hi: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs inside the ranges lo:hi of items; equal items never stand on both sides of a range's end.

    `cap` is the longest period that a block may still hold. A block inside a
    run of period q holds no other run of period q or more, so deeper blocks
    of a long run are soon done.
    """
    ext = Extensions(items, int((hi - lo).max()))
    cap = (hi - lo) // 2
    found = []
    while len(lo):
        mid = (lo + hi) // 2
        hits = []
        for to_right in (True, False):
            block, q = spans(np.minimum(cap, hi - mid if to_right else mid - lo))
            q += 1
            a = mid[block] - (0 if to_right else q)
            b = a + q
            # A run agrees for `need` words around its middle, so for half of them on one side.
            need = np.maximum(q, min_length - q)
            level = np.minimum(np.log2((need + 1) // 2).astype(np.int64), len(ext.ranks) - 1)
            maybe = np.zeros(len(q), bool)
            for j in np.unique(level):
                of = np.flatnonzero(level == j)
                size = 1 << int(j)
                maybe[of] = ext.equal(j, a[of], b[of]) | ext.equal(j, a[of] - size, b[of] - size)
            block, q, a, b, need = (x[maybe] for x in (block, q, a, b, need))
            start, end = a - ext.left(a, b), b + ext.right(a, b)
            run = end - start - q >= need
            hits.append(np.stack([x[run] for x in (block, start, end, q)]))
        block, start, end, q = np.concatenate(hits, axis=1)
        found.append((start, end, q))
        caps = []
        for a, b in ((lo, mid), (mid, hi)):
            c = np.minimum(cap, (b - a) // 2)
            inside = (start <= a[block]) & (end >= b[block])
            np.minimum.at(c, block[inside], q[inside] - 1)
            caps.append(c)
        lo, hi, cap = np.concatenate([lo, mid]), np.concatenate([mid, hi]), np.concatenate(caps)
        live = (hi - lo >= min_length) & (cap > 0)
        lo, hi, cap = lo[live], hi[live], cap[live]
    start, end, q = (np.concatenate(x) for x in zip(*found))
    # The same stretch under a multiple of its period is no run of its own.
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    first = np.ones(len(q), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[first], end[first], q[first]


def batch_runs(ids: np.ndarray, docs: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs of a batch of documents, by start, then end; ids and docs are the word and document at each place."""
    lo, hi = surviving_segments(ids, docs, min_length)
    if not len(lo):
        return lo, lo, lo
    size = hi - lo
    owner, place = spans(size + 1)
    text = place < size[owner]
    at = lo[owner] + place
    # Each segment ends with an item of its own.
    items = np.where(text, ids[np.minimum(at, len(ids) - 1)], len(ids) + owner)
    _, items = np.unique(items, return_inverse=True)
    base = np.cumsum(size + 1) - size - 1
    start, end, q = main_lorentz(items, base, base + size, min_length)
    shift = (lo - base)[np.searchsorted(base, start, "right") - 1]
    return start + shift, end + shift, q


def _runs(min_length: int):
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run_type)), ("collapsed", pa.large_string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in chunks(offsets):
                o = offsets[lo : hi + 1]
                n = hi - lo
                text, ws, we, wd = joined_words(data[o[0] : o[-1]], o - o[0])
                start, end, q = batch_runs(word_ids(text, ws, we, word_hashes(text, ws, we)), wd, min_length)
                first_word = np.searchsorted(wd, np.arange(n + 1))
                doc = wd[start] if len(start) else start
                many = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
                fields = [pa.array(x.astype(np.int64)) for x in (start - first_word[doc], end - start, q)]
                runs = pa.ListArray.from_arrays(pa.array(many), pa.StructArray.from_arrays(fields, fields=list(run_type)))
                edge = np.zeros(len(ws) + 1, np.int64)
                np.add.at(edge, start + q, 1)
                np.add.at(edge, end, -1)
                kept = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
                out, ends = _joined(text, ws[kept], we[kept], wd[kept], n)
                collapsed = pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends.tobytes()), pa.py_buffer(out.tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n), pa.array(np.diff(first_word)), runs, collapsed.cast(pa.large_string())], schema=schema)

    return run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _joined(text: np.ndarray, ws: np.ndarray, we: np.ndarray, wd: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of each of n documents joined by one space, and the n + 1 offsets."""
    gap = np.zeros(len(ws), np.int64)
    gap[:-1] = wd[1:] == wd[:-1]
    size = we - ws + gap
    owner, place = spans(size)
    at = ws[owner] + place
    out = np.where(at < we[owner], text[np.minimum(at, max(len(text) - 1, 0))], 0x20).astype(np.uint8) if len(at) else np.zeros(0, np.uint8)
    return out, np.concatenate([[0], np.cumsum(np.bincount(wd, weights=size, minlength=n).astype(np.int64))]).astype(np.int64)


def periodic_runs(docs: DataFrame, min_length: int = 12) -> DataFrame:
    """The runs of each document: doc_id, n_words, runs (start, length, period; by start, then period) and the collapsed text.

    docs needs doc_id and text; other columns are ignored. Words are stretches
    without ASCII white space. A run is a stretch of consecutive words with
    smallest period q (words q apart are the same) of at least `min_length`
    and 2 * q words that no neighbouring word extends under q. The collapsed
    text joins by one space the words that no run holds beyond its first q.

    Null, empty and blank texts have no words, no runs and an empty collapsed
    text. Rows are judged one by one, so null and repeated doc_ids and equal
    texts do no harm. No rows give no rows. A document is handled whole by
    one task: for w words in surviving segments it holds some 4 * log2(w)
    bytes a word and takes O(w log² w) steps.
    """
    run, kind = _runs(min_length)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document (by crc32 of its doc_id) repeats a stretch of its words to its end.

    With h = crc32(decimal doc_id) and g = floor(h / 10), documents with
    h % 10 = 0 and n > 0 words get word a + (i - a) % p at each place i >= a,
    where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). Others, and
    rows without doc_id, keep their text.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    w = F.col("_words")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    split = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    # Only the rows that change are split; a generator keeps the words from being split once a use.
    changed = rows.where(h % 10 == 0).select("doc_id", "text", F.explode(F.array(split)).alias("_words"))
    n = F.size(w)
    a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
    p = (F.floor((n - a) / (g % 8 + 3)) + 1).cast("int")
    cycle = F.slice(w, a + 1, p)
    again = F.flatten(F.array_repeat(cycle, F.ceil((n - a) / p).cast("int")))
    text = F.when(n > 0, F.concat_ws(" ", F.slice(F.concat(F.slice(w, F.lit(1), a), again), F.lit(1), n))).otherwise(F.col("text"))
    return rows.where((h % 10 != 0) | h.isNull()).unionByName(changed.select("doc_id", text.alias("text")))


def run_digests(found: DataFrame) -> DataFrame:
    """One row of numbers and checksums a document, from the output of periodic_runs."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    listing = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    length = -F.col("_best")["shorter"]
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best")["start"].alias("start"), length.alias("length"), F.col("_best")["period"].alias("period"),
        F.expr("1000 * (-_best.shorter) div _best.period").alias("exponent_milli"), F.sha2(listing.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
