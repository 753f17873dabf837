"""Exact top-k inner products by MaxScore over postings.

A vector's dimensions are terms, and a block of vectors keeps the posting of
each term with the bounds of its components. For a query, terms are ordered
by the most they can add in the block. Those whose bounds together stay below
the query's k-th score so far are non-essential: a vector that only they hold
cannot enter the list. Essential postings are traversed, and the others are
probed, a few terms at a time, only for vectors that can still compete. The
k-th score rises from block to block of a task; tasks give their best k,
which are merged.

Shape of the job: queries go to the vectors and never the other way. They are
broadcast in waves of a bounded size, and a wave is one scan of all vectors
without a shuffle; what is shuffled is k rows a query and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

#: Vectors in a block, and bytes of query vectors that are broadcast at once.
BLOCK, WAVE_BYTES = 2048, 16 << 20
#: Share of components that are not zero from which a block's postings are kept as rows of a matrix.
DENSE = 0.25
#: Terms that are probed at once.
PROBE = 8
#: Products and sums below this are exact in doubles.
EXACT = float(1 << 53)


def vectors_of(ids: pa.Array, vectors: pa.Array, scale: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, floor(scale * x) as rows) of the vectors of each length; those that are null, empty or hold null or non-finite components are left out."""
    ok = ids.is_valid().to_numpy(zero_copy_only=False) & vectors.is_valid().to_numpy(zero_copy_only=False)
    offsets = vectors.offsets.to_numpy()
    values = vectors.values.to_numpy(zero_copy_only=False).astype(float)
    numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    for dims in np.unique(size[ok]):
        at = np.flatnonzero(ok & (size == dims))
        if not dims:
            continue
        rows = np.floor(values[offsets[at][:, None] + np.arange(dims)] * scale)
        good = np.isfinite(rows).all(axis=1)
        yield numbers[at[good]].astype(np.int64), rows[good].astype(np.int64)


class Block:
    """Postings of some vectors: a matrix by term where they are dense, else (vector, component) lists by term."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.n, self.terms = ids, len(rows), rows.shape[1]
        self.high, self.low = rows.max(axis=0), rows.min(axis=0)
        self.peak = float(np.abs(rows).max())
        self.dense = np.count_nonzero(rows) >= DENSE * rows.size
        self.probed = 0
        if self.dense:
            self.rows = {float: np.ascontiguousarray(rows.T.astype(float)), int: rows.T}
        else:
            term, self.who = np.nonzero(rows.T)
            self.what = rows.T[term, self.who]
            self.start = np.searchsorted(term, np.arange(self.terms + 1))

    def traverse(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, partial scores) of all that the postings of `terms` hold."""
        if self.dense:
            return np.arange(self.n), weights @ self.rows[float if weights.dtype == float else int][terms]
        lists = [slice(self.start[t], self.start[t + 1]) for t in terms]
        who = np.concatenate([self.who[x] for x in lists])
        part = np.concatenate([self.what[x] * w for x, w in zip(lists, weights)])
        found, place = np.unique(who, return_inverse=True)
        score = np.zeros(len(found), weights.dtype)
        np.add.at(score, place, part)
        return found, score

    def probe(self, terms: np.ndarray, weights: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """What `terms` add to the scores of `vectors` (ascending)."""
        self.probed += len(vectors) * len(terms)
        if self.dense:
            return weights @ self.rows[float if weights.dtype == float else int][np.ix_(terms, vectors)]
        out = np.zeros(len(vectors), weights.dtype)
        for t, w in zip(terms, weights):
            who, what = self.who[self.start[t] : self.start[t + 1]], self.what[self.start[t] : self.start[t + 1]]
            at = np.minimum(np.searchsorted(who, vectors), max(0, len(who) - 1))
            if len(who):
                out += np.where(who[at] == vectors, what[at] * w, 0)
        return out

    def search(self, query: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the vectors that reach `least`, and perhaps a few more."""
        whole = self.peak * float(np.abs(query).sum()) < EXACT
        bound = np.maximum(query.astype(float) * self.high, query.astype(float) * self.low)
        order = np.flatnonzero(query)
        order = order[np.argsort(-bound[order], kind="stable")]
        weights = query[order].astype(float) if whole else query[order]
        rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0.0]])
        # Bounds may be rounded where they are not exact.
        room = 0.0 if whole else 1e-12 * float(np.abs(bound).sum()) + 1
        below = np.flatnonzero(rest + room < least)
        if len(below):
            first = int(below[0])
            if not first:
                return self.ids[:0], weights[:0]
            at, score = self.traverse(order[:first], weights[:first])
        else:
            # Every term is essential, and even a vector without any of them competes.
            first, at, score = len(order), np.arange(self.n), np.zeros(self.n, weights.dtype)
            if first:
                some, part = self.traverse(order, weights)
                score[some] = part
        while True:
            still = score + (rest[first] + room) >= least
            if not still.all():
                at, score = at[still], score[still]
            if first == len(order) or not len(at):
                return self.ids[at], score
            score = score + self.probe(order[first : first + PROBE], weights[first : first + PROBE], at)
            first = min(first + PROBE, len(order))


class Lists:
    """The best k of each query so far; equal (id, score) pairs count once, ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * queries
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * queries

    def least(self, q: int) -> float:
        return float(self.scores[q][-1]) if len(self.scores[q]) == self.k else -np.inf

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(ids):
            return
        ids, scores = np.concatenate([self.ids[q], ids]), np.concatenate([self.scores[q], scores.astype(np.int64)])
        if len(ids) > 4 * self.k:
            # Repeats may hide better ones only among equal ids, so twice the distinct k are looked for among all.
            cut = np.partition(scores, len(scores) - 2 * self.k)[len(scores) - 2 * self.k]
            if len(np.unique(ids[scores >= cut])) >= self.k:
                ids, scores = ids[scores >= cut], scores[scores >= cut]
        order = np.lexsort((ids, -scores))
        ids, scores = ids[order], scores[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])
        self.ids[q], self.scores[q] = ids[new][: self.k], scores[new][: self.k]


def _search(shared, k: int, size: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: dict[int, tuple[np.ndarray, np.ndarray]] = shared.value
        lists = {dims: Lists(len(ids), k) for dims, (ids, _) in queries.items()}
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def scan(dims: int, last: bool) -> None:
            ids, rows = (np.concatenate(x) for x in zip(*held.pop(dims)))
            for at in range(0, len(ids), size):
                if len(ids) - at < size and not last:
                    held[dims] = [(ids[at:], rows[at:])]
                    break
                block = Block(ids[at : at + size], rows[at : at + size])
                for q, (own, query) in enumerate(zip(*queries[dims])):
                    found, score = block.search(query, lists[dims].least(q))
                    other = found != own
                    lists[dims].add(q, found[other], score[other])

        for batch in batches:
            for ids, rows in vectors_of(batch.column("vec_id"), batch.column("embedding")):
                dims = rows.shape[1]
                if dims in queries and len(ids):
                    held.setdefault(dims, []).append((ids, rows))
                    if sum(len(x) for x, _ in held[dims]) >= size:
                        scan(dims, False)
        for dims in [*held]:
            scan(dims, True)
        for dims, (ids, _) in queries.items():
            count = [len(x) for x in lists[dims].ids]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, count)), *(pa.array(np.concatenate(x)) for x in (lists[dims].ids, lists[dims].scores))], schema=schema)

    return run, "query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, queries: Column, k: int = 5, block: int = BLOCK, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products.

    vectors needs vec_id and embedding; other columns are ignored. `queries`
    marks the rows that are queries, and the candidates are all rows but
    those with the query's own vec_id. Rows with a null vec_id, a null
    vector, or a null or non-finite component take no part; an empty vector
    neither; vectors are only compared with vectors of their own length.
    Repeated rows count once. Sums are exact up to 63 bits. Ties go to the
    smaller vec_id; with fewer than k candidates all are returned; no rows
    give no rows.
    """
    context = vectors.sparkSession.sparkContext
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(queries, F.lit(False)).alias("_query"))
    rows = rows.where("vec_id is not null and size(embedding) > 0")
    asked = rows.where("_query").select("vec_id", "embedding").distinct()
    size = asked.agg(F.sum(F.size("embedding") * 8)).first()[0] or 0
    # Of about equal size, by a hash of vec_id.
    waves = max(1, -(-size // wave_bytes))
    run_of = rows.select("vec_id", "embedding")
    found = []
    for wave in range(waves):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == wave).toArrow()
        by: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in part.to_batches():
            for ids, v in vectors_of(b.column("vec_id"), b.column("embedding")):
                by.setdefault(v.shape[1], []).append((ids, v))
        shared = context.broadcast({dims: tuple(np.concatenate(x) for x in zip(*parts)) for dims, parts in by.items()})
        run, kind = _search(shared, k, block)
        best = run_of.mapInArrow(run, kind)
        found.append(staged(best, "best") if waves > 1 else best)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
