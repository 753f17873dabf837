"""Long repeated byte strings by a run-length index.

Places that can hold a repeat are found through anchors; what windows around
them can reach is gathered in groups and indexed: suffixes are sorted, the
Burrows-Wheeler transform is cut into runs, and the longest match of the
suffix with its neighbour is computed only at run ends (and among suffixes
that the sort left tied). From these samples the matching statistics of all
other places follow in text order, each one less than its predecessor's.
Places whose match reaches the length start a repeated window.

Two parts of the work need no index: a context that occurs twice, known by a
digest of its bytes, is repeated from end to end; and groups too large for
one task are narrowed down by digests of spans (`anchors.hot_windows`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import HOT, anchors, batches_of_groups, byte_units, contexts, hot_windows, numbered
from .filters import only_wanted
from .staging import discard, staged
from .textkernel import utf8

LENGTH = 400
ANCHOR = 192
#: Bytes that one index covers, about.
INDEX_BYTES = 1 << 20


class RunLengthIndex:
    """Matching statistics of a text of byte pieces, no match crossing a piece.

    pieces are joined with separators. Suffixes are sorted by their first
    `enough` symbols or more, to the end without it; places that are then
    still tied match at least so far, and that is what is told of them.
    """

    def __init__(self, pieces: list[np.ndarray], enough: int | None = None):
        sep = np.zeros(1, np.int16)
        text = np.concatenate([x for p in pieces for x in (p.astype(np.int16) + 1, sep)])
        n = len(text)
        self.starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in pieces])])
        # Ranks of the suffixes by their first h symbols, h doubling from 4.
        padded = np.concatenate([text, np.zeros(4, np.int16)])
        key = np.zeros(n, np.int64)
        for j in range(4):
            key *= 257
            key += padded[j : j + n]
        del padded
        self.ranks: list[tuple[int, np.ndarray]] = []
        h = 4
        rank = self._ranked(key)
        while True:
            self.ranks.append((h, rank))
            if rank.max() == n - 1 or enough is not None and h >= enough:
                break
            key = rank.astype(np.int64)
            key *= n + 1
            key[: max(0, n - h)] += rank[h:] + 1
            rank = self._ranked(key)
            h *= 2
        self.text, self.n = text, n
        self.suffixes = np.argsort(rank, kind="stable").astype(np.int32)
        # Places that share their rank with another.
        self.tied = (np.bincount(rank, minlength=n) > 1)[rank]
        self.depth = h
        self.bwt = text[self.suffixes - 1]
        self.bwt[self.suffixes == 0] = -1

    @staticmethod
    def _ranked(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        new = np.ones(len(key), np.int32)
        new[0] = 0
        key = key[order]
        new[1:] = key[1:] != key[:-1]
        rank = np.empty(len(key), np.int32)
        rank[order] = np.cumsum(new, dtype=np.int32)
        return rank

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes a and b, by descending doublings."""
        a, b = a.copy(), b.copy()
        out = np.zeros(len(a), np.int32)
        for h, rank in reversed(self.ranks):
            inside = (a < self.n) & (b < self.n)
            ok = np.zeros(len(a), bool)
            ok[inside] = rank[a[inside]] == rank[b[inside]]
            a[ok] += h
            b[ok] += h
            out[ok] += h
        for _ in range(3):
            inside = (a < self.n) & (b < self.n)
            ok = np.zeros(len(a), bool)
            ok[inside] = self.text[a[inside]] == self.text[b[inside]]
            a[ok] += 1
            b[ok] += 1
            out[ok] += 1
            a[~ok] = self.n
        return out

    def statistics(self) -> np.ndarray:
        """Of every place, the longest match with any other place of the text."""
        n, sa, at = self.n, self.suffixes, np.arange(self.n, dtype=np.int32)
        # First rows of the runs, and rows of places that follow a tied one; row 0 has no neighbour above it.
        after = np.zeros(n, bool)
        after[1:] = self.tied[:-1]
        after = after[sa]
        cut = self.bwt[1:] != self.bwt[:-1]
        best = np.zeros(n, np.int32)
        for side in (0, 1):
            rows = np.flatnonzero(cut | (after[1:] if side == 0 else after[:-1])) + 1
            sample = np.full(n, -1, np.int32)
            sample[sa[rows - side]] = self.common(sa[rows - 1], sa[rows])
            sample[sa[0] if side == 0 else sa[-1]] = 0
            sample[self.tied] = self.depth
            last = np.maximum.accumulate(np.where(sample >= 0, at, 0))
            best = np.maximum(best, sample[last] - (at - last))
        ends = np.repeat(self.starts[1:] - 1, np.diff(self.starts))
        return np.minimum(best, ends - at)


def merged(rows: dict[str, list]) -> tuple[list[int], list[int], list[np.ndarray]]:
    """Pieces (row_id, start, bytes) that hold every byte of the contexts once."""
    order = sorted(range(len(rows["row_id"])), key=lambda i: (rows["row_id"][i], rows["lo"][i]))
    ids, starts, parts = [], [], []
    end = None
    for i in order:
        row, lo, content = rows["row_id"][i], rows["lo"][i], rows["content"][i]
        if ids and ids[-1] == row and lo <= end:
            if lo + len(content) > end:
                parts[-1].append(content[end - lo :])
                end = lo + len(content)
        else:
            ids.append(row)
            starts.append(lo)
            parts.append([content])
            end = lo + len(content)
    return ids, starts, [np.frombuffer(b"".join(p), np.uint8) for p in parts]


def spans_of(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by windows of `length` at the sorted starts."""
    if not len(starts):
        return starts, starts
    new = np.concatenate([[True], np.diff(starts) > length])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    return starts[first], starts[last] + length


def _index(length: int, limit: int):
    schema = pa.schema([("row_id", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches_of_groups(batches, limit):
            ids, starts, pieces = merged(rows)
            index = RunLengthIndex(pieces, length)
            hit = index.statistics() >= length
            out: list[list] = [[], [], []]
            for row, lo, a, b in zip(ids, starts, index.starts[:-1], index.starts[1:]):
                s, e = spans_of(np.flatnonzero(hit[a:b]) + lo, length)
                out[0] += [row] * len(s)
                out[1] += s.tolist()
                out[2] += e.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, schema.types)], schema=schema)

    return run, "row_id long, s int, e int"


def union_mask(marks: list[dict], n: int) -> np.ndarray:
    """Which of n units the marks cover."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, [m["s"] for m in marks], 1)
    np.add.at(edge, [m["e"] for m in marks], -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("row_id", pa.int64()), ("removed", pa.int64()), ("spans", pa.int64()), ("sha", pa.string())])
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        out: list[list] = [[], [], []]
        for a, b, marks in zip(offsets[:-1], offsets[1:], batch.column("marks").to_pylist()):
            gone = union_mask(marks, b - a)
            out[0].append(int(gone.sum()))
            out[1].append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0)
            out[2].append(hashlib.sha256(data[a:b][~gone].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("row_id"), *(pa.array(x, t) for x, t in zip(out, schema.types[1:]))], schema=schema)


def repeated_marks(rows: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, limit: int = INDEX_BYTES) -> DataFrame:
    """(row_id, s, e): byte ranges of rows(row_id, text) that repeated strings of `length` bytes cover.

    Counts are staged before they are joined, so that Spark can split the
    rows of a hot fingerprint.
    """
    every = staged(anchors(rows, byte_units, length, anchor), "anchors")
    twice = staged(every.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"), "twice")
    found = staged(every.join(twice, "fp", "left_semi"), "repeated")
    discard(every, twice)
    classes = staged(found.groupBy("fp", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("row_id", "pos", "left", "right")).alias("rep")), "classes")
    whole = found.join(classes.where("n > 1").select("fp", "ctx"), ["fp", "ctx"], "left_semi")
    whole = staged(whole.select("row_id", (F.col("pos") - F.col("left")).alias("s"), (F.col("pos") + F.col("right")).alias("e")), "whole")
    # The others are compared with all contexts of their fingerprint.
    several = staged(classes.groupBy("fp").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1"), "several")
    places = staged(classes.join(several, "fp").select("fp", "ctx", "rep.*", (F.col("m") > hot).alias("hot")), "places")
    discard(found, classes, several)
    run, kind = _index(length, limit)
    groups = contexts(rows, places.where("not hot"), byte_units)
    part = staged(groups.repartition("fp").sortWithinPartitions("fp", "row_id", "lo").mapInArrow(run, kind), "part")
    marks = whole.unionByName(part)
    large = places.where("hot")
    if not large.isEmpty():
        held = staged(contexts(rows, large, byte_units, {"ctx": "binary"}).withColumn("ord", F.lit(0).cast("long")), "hot")
        shared = hot_windows(held, length, anchor, False, lambda n, least, own: n > 1)
        spans = large.join(shared, ["fp", "ctx"]).select("row_id", "pos", F.explode("spans").alias("w"))
        marks = marks.unionByName(spans.select("row_id", (F.col("pos") + F.col("w.s")).alias("s"), (F.col("pos") + F.col("w.e")).alias("e")))
    return marks


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, limit: int = INDEX_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 after removing repeated strings of `length` bytes.

    docs needs doc_id and text; other columns are ignored. Every byte goes
    that is covered by a string of `length` bytes which also starts anywhere
    else, in another row or in the same text; strings are judged on the
    input. Null counts as empty; texts shorter than `length` stay whole.
    Rows that repeat, or lack, a doc_id are texts of their own, so a long
    repeated row is removed in all its places. No rows give no rows.
    """
    rows = numbered(docs)
    marks = staged(repeated_marks(rows, length, anchor, hot, limit), "marks")
    listed = marks.groupBy("row_id").agg(F.collect_list(F.struct("s", "e")).alias("marks"))
    texts = only_wanted(rows.select("row_id", "text"), marks, "row_id")
    cut = texts.join(listed.hint("merge"), "row_id").select("row_id", "text", "marks").mapInArrow(_cut, "row_id long, removed long, spans long, sha string")
    base = rows.select("row_id", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    zero = F.lit(0).cast("long")
    return base.join(cut, "row_id", "left").select(
        "doc_id", "n_bytes", F.coalesce("removed", zero).alias("n_removed"), F.coalesce("spans", zero).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256")
    )
