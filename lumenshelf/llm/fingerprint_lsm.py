"""Incremental substring dedup with a log-structured fingerprint index.

The index is a list of immutable runs, each a table sorted by fingerprint of
the windows' anchors seen in one or more batches of documents, with the
first document of each context. A new batch is fingerprinted, merge-joined
with the runs and with itself, and what matches is verified: contexts are
equal where the digests of their words are, and windows of different
contexts are compared word by word. The batch becomes a run of its own; when
there are too many runs they are compacted into one, keeping the first
document of each context. Batches come in doc_id order, so a window is a
repeat exactly if the index or an earlier document of the batch holds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import anchors, batches_of_groups, contexts, hot_windows, numbered, word_units
from .filters import only_wanted
from .run_length_index import spans_of, union_mask
from .staging import discard, staged
from .textkernel import U, Prefix, chunks, joined_words, mix, utf8, word_hashes

WINDOW = 50
ANCHOR = 25
#: Batches of the query, and runs beyond which they are compacted.
BATCHES, MOST_RUNS = 3, 2
#: Bytes of words that one verification covers, about.
VERIFY_BYTES = 8 << 20

#: Contexts of one fingerprint that are verified in one task: some 8 MB of words.
HOT = 16384

#: First document of a context, and where in it.
_FIRST = ("first_doc", "row_id", "pos", "left", "right")


@dataclass
class FingerprintIndex:
    """Runs of (fp, ctx, first_doc, row_id, pos, left, right), each sorted by fp and ctx."""

    most_runs: int = MOST_RUNS
    runs: list[DataFrame] = field(default_factory=list)

    def entries(self) -> DataFrame | None:
        out = None
        for run in self.runs:
            out = run if out is None else out.unionByName(run)
        return out

    def add(self, run: DataFrame) -> None:
        """Append a run; with too many, compact all into one."""
        self.runs.append(staged(run, "run", ["fp", "ctx"]))
        if len(self.runs) > self.most_runs:
            merged = self.entries().groupBy("fp", "ctx").agg(F.min(F.struct(*_FIRST)).alias("m")).select("fp", "ctx", "m.*")
            old, self.runs = self.runs, [staged(merged, "run", ["fp", "ctx"])]
            discard(*old)


def shared_windows(rows: dict[str, list], window: int, k: int) -> list[np.ndarray]:
    """Of each context, the starts of its windows that a context of its group holds with a smaller first_doc.

    Windows are compared at equal offsets from the anchor; a hash brings
    equal ones together, and their words confirm them, run by run.
    """
    reach = window - k
    n = len(rows["fp"])
    text = np.frombuffer(b"".join(rows["content"]), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in rows["content"]])])
    text, ws, we, wd = joined_words(text, offsets)
    base = np.searchsorted(wd, np.arange(n + 1))
    prefix, raw = Prefix(word_hashes(text, ws, we)), text.tobytes()
    own, start, keys = [], [], []
    for i in range(n):
        before = rows["pos"][i] - rows["lo"][i]
        first, last = max(0, before - reach), min(before, int(base[i + 1] - base[i]) - window)
        if last < first:
            continue
        s = np.arange(first, last + 1)
        own.append(np.full(len(s), i))
        start.append(s + base[i])
        keys.append((s - before).astype(U) * U(0x9E3779B97F4A7C15) + U(rows["fp"][i] & (1 << 64) - 1))
    hits: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    if not own:
        return hits
    own, start = np.concatenate(own), np.concatenate(start)
    key = mix(prefix.span(start, start + window) ^ mix(np.concatenate(keys)))
    doc = np.array(rows["first_doc"])[own]
    order = np.lexsort((doc, key))
    head = np.concatenate([[True], np.diff(key[order].view(np.int64)) != 0])
    leader = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    later = doc[order] > doc[leader]
    mine, its = order[later], leader[later]
    by_place = np.lexsort((start[mine], own[mine]))
    mine, its = mine[by_place], its[by_place]

    def same(a: int, b: int, size: int) -> bool:
        return raw[ws[a] : we[a + size - 1]] == raw[ws[b] : we[b + size - 1]]

    # Runs of windows one after another, on both sides.
    new = np.ones(len(mine), bool)
    new[1:] = (own[mine[1:]] != own[mine[:-1]]) | (np.diff(start[mine]) != 1) | (np.diff(start[its]) != 1)
    sure = np.ones(len(mine), bool)
    edges = [*np.flatnonzero(new), len(mine)]
    for a, b in zip(edges, edges[1:]):
        if not same(start[mine[a]], start[its[a]], b - a + window - 1):
            sure[a:b] = [same(start[i], start[j], window) for i, j in zip(mine[a:b], its[a:b])]
    mine = mine[sure]
    cut = np.searchsorted(own[mine], np.arange(n + 1))
    for i in range(n):
        if cut[i + 1] > cut[i]:
            hits[i] = start[mine[cut[i] : cut[i + 1]]] - base[i]
    return hits


def _verify(window: int, k: int, limit: int):
    schema = pa.schema([("fp", pa.int64()), ("ctx", pa.binary()), ("spans", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches_of_groups(batches, limit):
            out: list[list] = [[] for _ in schema]
            for i, starts in enumerate(shared_windows(rows, window, k)):
                if len(starts):
                    before = rows["pos"][i] - rows["lo"][i]
                    spans = [{"s": s, "e": e} for s, e in zip(*((x - before).tolist() for x in spans_of(starts, window)))]
                    for column, x in zip(out, (rows["fp"][i], rows["ctx"][i], spans)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, schema.types)], schema=schema)

    return run, "fp long, ctx binary, spans array<struct<s:int,e:int>>"


def add_batch(index: FingerprintIndex, batch: DataFrame, texts: DataFrame, window: int = WINDOW, k: int = ANCHOR, hot: int = HOT, limit: int = VERIFY_BYTES) -> DataFrame:
    """Marks (row_id, s, e) of the batch's repeated words; the batch is then part of the index.

    batch and texts are (row_id, doc_id, text); every doc_id of the batch is
    above all that the index holds, and texts has the rows of both. Tables
    are staged before they are joined by fingerprint, so that Spark can split
    the rows of a hot one.
    """
    batch = batch.where("doc_id is not null")
    every = anchors(batch, word_units, window, k)
    if batch.where("doc_id <> row_id").isEmpty():
        every = staged(every.withColumn("first_doc", F.col("row_id")), "anchors")
    else:
        every = staged(every.join(batch.select("row_id", F.col("doc_id").alias("first_doc")), "row_id"), "anchors")
    run_of_batch = every.groupBy("fp", "ctx").agg(F.min(F.struct(*_FIRST)).alias("m")).select("fp", "ctx", "m.*")
    old, known = index.entries(), every.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    if old is not None:
        new = staged(every.select("fp").distinct(), "new")
        old = staged(old.join(new, "fp", "left_semi"), "old")
        known = known.unionByName(old.select("fp")).distinct()
        discard(new)
    known = staged(known, "known")
    here = staged(every.join(known, "fp", "left_semi"), "repeated")
    classes = here.select("fp", "ctx", *_FIRST, F.lit(True).alias("fresh"))
    if old is not None:
        classes = classes.unionByName(old.withColumn("fresh", F.lit(False)))
    classes = classes.groupBy("fp", "ctx").agg(F.min(F.struct("first_doc", "fresh", "row_id", "pos", "left", "right")).alias("m"))
    classes = staged(classes.select("fp", "ctx", "m.*"), "classes")
    # Not the first document of its context: all of the context is a repeat.
    first = staged(here.join(classes.select("fp", "ctx", F.col("first_doc").alias("earliest")), ["fp", "ctx"]), "first")
    whole = first.where("first_doc > earliest").select("row_id", (F.col("pos") - F.col("left")).alias("s"), (F.col("pos") + F.col("right")).alias("e"))
    # The first is compared with the other contexts of its fingerprint, where one has an earlier document.
    several = classes.groupBy("fp").agg(F.count("*").alias("m"), F.min("first_doc").alias("least"), F.max(F.when(F.col("fresh"), F.col("first_doc"))).alias("newest"))
    several = staged(several.where("m > 1 and newest > least").select("fp", (F.col("m") > hot).alias("hot")), "several")
    places = staged(classes.join(several, "fp").select("fp", "ctx", *_FIRST, "hot"), "places")
    discard(here, known, classes, several, old)
    run, kind = _verify(window, k, limit)
    carry = {"ctx": "binary", "first_doc": "long"}
    groups = contexts(texts, places.where("not hot"), word_units, carry)
    windows = groups.repartition("fp").sortWithinPartitions("fp", "first_doc", "pos").mapInArrow(run, kind)
    large = places.where("hot")
    if not large.isEmpty():
        held = staged(contexts(texts, large, word_units, carry).withColumnRenamed("first_doc", "ord"), "hot")
        windows = windows.unionByName(hot_windows(held, window, k, True, lambda n, least, own: least < own))
    spans = first.where("first_doc = earliest").join(windows, ["fp", "ctx"]).select("row_id", "pos", F.explode("spans").alias("w"))
    part = spans.select("row_id", (F.col("pos") + F.col("w.s")).alias("s"), (F.col("pos") + F.col("w.e")).alias("e"))
    marks = staged(whole.unionByName(part), "marks")
    index.add(run_of_batch)
    discard(every, places, first)
    return marks


def _kept(with_marks: bool):
    names = ["row_id", "n_words", "removed", "sha"] if not with_marks else ["row_id", "removed", "sha"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            marks = batch.column("marks").to_pylist() if with_marks else None
            out: list[list] = [[], [], []]
            for lo, hi in chunks(offsets):
                o = offsets[lo : hi + 1] - offsets[lo]
                text, ws, we, wd = joined_words(data[offsets[lo] : offsets[hi]], o)
                cut = np.searchsorted(wd, np.arange(hi - lo + 1))
                raw = text.tobytes()
                for i in range(hi - lo):
                    s, e = ws[cut[i] : cut[i + 1]], we[cut[i] : cut[i + 1]]
                    n = len(s)
                    if with_marks:
                        left = ~union_mask(marks[lo + i], n)
                        s, e = s[left], e[left]
                    out[0].append(n)
                    out[1].append(n - len(s))
                    out[2].append(hashlib.sha256(b" ".join([raw[a:b] for a, b in zip(s.tolist(), e.tolist())])).hexdigest())
            columns = [batch.column("row_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
            yield pa.RecordBatch.from_arrays(columns if not with_marks else [columns[0], *columns[2:]], names=names)

    return run, "row_id long, n_words long, removed long, sha string" if not with_marks else "row_id long, removed long, sha string"


def remove_repeated_windows(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW, k: int = ANCHOR, hot: int = HOT, most_runs: int = MOST_RUNS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 after removing repeated windows of `window` words.

    docs needs doc_id and text; other columns are ignored. A word goes if a
    window that covers it also starts in a document with a smaller doc_id;
    windows are judged on the input. The documents enter the index in
    `batches` batches of ascending doc_id. Null texts have no words. Rows
    without doc_id are neither cut nor indexed; rows that repeat a doc_id
    are one document, none earlier than the other. No rows give no rows.
    """
    rows = numbered(docs)
    parts = [i / batches for i in range(1, batches)]
    bounds = sorted({*(rows.agg(F.percentile_approx("doc_id", parts).alias("b")).first()["b"] or [])}) if parts else []
    index, marks = FingerprintIndex(most_runs), None
    for lo, hi in zip([None, *bounds], [*bounds, None]):
        batch = rows.where(F.col("doc_id").isNotNull())
        batch = batch if lo is None else batch.where(F.col("doc_id") > lo)
        batch = batch if hi is None else batch.where(F.col("doc_id") <= hi)
        so_far = rows if hi is None else rows.where(F.col("doc_id") <= hi)
        new = add_batch(index, batch, so_far, window, k, hot)
        marks = new if marks is None else marks.unionByName(new)
    run, kind = _kept(False)
    base = rows.select("row_id", "text").mapInArrow(run, kind)
    listed = marks.groupBy("row_id").agg(F.collect_list(F.struct("s", "e")).alias("marks"))
    texts = only_wanted(rows.select("row_id", "text"), marks, "row_id")
    run, kind = _kept(True)
    cut = texts.join(listed.hint("merge"), "row_id").select("row_id", "text", "marks").mapInArrow(run, kind)
    cut = cut.select("row_id", F.col("removed").alias("cut"), F.col("sha").alias("cut_sha"))
    out = base.join(cut, "row_id", "left")
    if rows.where("doc_id is null or doc_id <> row_id").isEmpty():
        out = out.withColumn("doc_id", F.col("row_id"))
    else:
        out = out.join(rows.select("row_id", "doc_id"), "row_id")
    return out.select("doc_id", "n_words", F.coalesce("cut", "removed").alias("n_removed"), F.coalesce("cut_sha", "sha").alias("kept_sha256"))
