"""MinHash near-dedup by fast similarity sketching.

A document's shingle set is sketched in rounds: every round throws each
shingle into one of `coordinates` bins with a value that grows with the
round, a coordinate keeps its least value, and a document stops as soon as
all its coordinates are filled. After as many rounds again, round i fills
coordinate i outright, so a set of any size fills every coordinate. Bands of coordinates
propose candidates; every link is confirmed on the full shingle sets.

Shape of the job: one pass over the texts gives signatures; equal sets
collapse into one class; classes that share a band are compared word by word
(`confirm`): with the least class of the band first, the rest only where
confirmed links leave a band in several components. Components of the links
give the result. No pair list of a band is ever written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .confirm import confirmed_components, texts_of
from .staging import discard, staged
from .textkernel import LOWER, U, chunks, mix, utf8, word_hashes, words

COORDINATES = 128
BAND_ROWS = 4


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each document's distinct shingles, in that order."""
    data = LOWER[data]
    ws, we, wd = words(data, offsets)
    h = word_hashes(data, ws, we)
    n = len(offsets) - 1
    count = np.bincount(wd, minlength=n)
    docs, hashes = [], []
    for size in range(1, k + 1):
        m = len(h) - size + 1
        if m <= 0:
            break
        ok = wd[:m] == wd[size - 1 :]
        if size < k:
            ok &= count[wd[:m]] == size
        at = np.flatnonzero(ok)
        x = mix(h[at] + U(size))
        for j in range(1, size):
            x = mix(x * U(5) + h[at + j])
        docs.append(wd[at])
        hashes.append(x)
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, U)
    d, x = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((x, d))
    d, x = d[order], x[order]
    keep = np.ones(len(x), bool)
    keep[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    return d[keep], x[keep]


def sketches(d: np.ndarray, x: np.ndarray, n: int, t: int) -> np.ndarray:
    """n rows of t filled coordinates; rows of empty sets stay unfilled."""
    empty = ~U(0)
    out = np.full((n, t), empty)
    flat = out.reshape(-1)
    for r in range(2 * t):
        h = mix(x ^ mix(np.array([r + 1], U))[0])
        at = (h % U(t)).astype(np.int64) if r < t else r - t
        np.minimum.at(flat, d * t + at, U(r) << U(55) | h >> U(9))
        go = (out == empty).any(axis=1)[d]
        if not go.any():
            break
        d, x = d[go], x[go]
    return out


def _signatures(k: int, t: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in chunks(offsets):
                o = offsets[lo : hi + 1]
                n = hi - lo
                d, x = shingle_sets(data[o[0] : o[-1]], o - o[0], k)
                first = np.searchsorted(d, np.arange(n + 1))
                size = np.diff(first)
                sums = []
                for salt in (U(11), U(13)):
                    c = np.zeros(len(x) + 1, U)
                    np.cumsum(mix(x * U(3) + salt), out=c[1:])
                    sums.append((c[first[1:]] - c[first[:-1]]).view(np.int64))
                s = sketches(d, x, n, t)
                keys = np.empty((n, t // rows), U)
                for b in range(t // rows):
                    key = np.full(n, b, U)
                    for j in range(rows):
                        key = mix(key * U(7) + s[:, b * rows + j])
                    keys[:, b] = key
                some = size > 0
                off = np.concatenate([[0], np.cumsum(some * (t // rows))]).astype(np.int32)
                bands = pa.ListArray.from_arrays(off, pa.array(keys[some].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n), pa.array(size), *map(pa.array, sums), bands], schema=schema)

    return run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 5, coordinates: int = COORDINATES, band_rows: int = BAND_ROWS) -> DataFrame:
    """Components of documents whose shingle sets are alike: doc_id, n_shingles, component_id, kept.

    docs needs doc_id and text; other columns are ignored. Two documents are
    linked where 100 * intersection >= percent * union of their sets of
    distinct `shingle`-word shingles (A-Z lower-cased; a shorter text is one
    shingle). component_id is the least doc_id reachable, kept marks it. At
    the default bands a pair at the threshold escapes with a chance of about
    5e-8, and 5e-11 at percent=85.

    Null, empty and blank texts have no shingles and are linked with
    nothing, as are rows without doc_id (their component_id is null, kept
    true). Rows that repeat a doc_id each get their own text's component.
    No rows give no rows.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    run, kind = _signatures(shingle, coordinates, band_rows)
    sig = staged(source.mapInArrow(run, kind), "signatures")
    key = ["n_shingles", "set_a", "set_b"]
    classes = staged(
        sig.where("n_shingles > 0 and doc_id is not null")
        .groupBy(*key).agg(F.min(F.struct("doc_id", "bands")).alias("m"))
        .select(*key, F.col("m.doc_id").alias("rep"), F.col("m.bands").alias("bands")),
        "classes",
    )
    bands = classes.select(F.lit(0).alias("kind"), F.explode("bands").alias("key"), "rep")
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    buckets = staged(bands.join(shared.hint("merge"), "key", "left_semi").select("kind", "key", "rep"), "buckets")
    texts = staged(texts_of(source, buckets.select("rep").distinct()), "candidates")
    found = confirmed_components(buckets, texts, classes.select("rep", "n_shingles"), shingle, percent).withColumnRenamed("node", "rep")
    discard(buckets, texts)
    label = classes.select(*key, "rep").join(found, "rep", "left").select(*key, F.coalesce("component", "rep").alias("component"))
    out = sig.select("doc_id", *key).join(label, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
