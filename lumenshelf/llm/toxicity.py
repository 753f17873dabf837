"""Toxicity by weak supervision.

Voters are lexicon entries (whole words) and patterns (word beginnings) that
toxic rows of the training fold hold more often than clean ones, chosen so
that together they reach many rows, and no group of copies fills the list. A
generative label model estimates by EM how often each voter fires on either
class, and the correlations of voters given the class, which discount votes
that repeat each other; the annotator's label is one more voter of estimated
accuracy, whose prior keeps the classes what they are. A linear classifier is
trained on the posterior labels and scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import only_wanted
from .langid import fold
from .staging import staged
from .textkernel import LOWER, U, chunks, mix, utf8, word_hashes, words

#: Beginnings of words, in bytes, that patterns look at.
BEGINNINGS = (4, 5, 6)
#: Bounds: entries that may become voters, voters, and labelled documents of each class that the label model and the classifier are fitted on.
ELIGIBLE, VOTERS, ROWS_PER_CLASS = 4096, 256, 20_000
#: Different entries that a task counts before it sends them on.
PENDING = 1 << 20
#: The annotator marks this share of toxic and of clean rows, as far as known beforehand.
MARKED = (0.9, 0.02)
LEAST_TOXIC_ROWS = 4


def entries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, entry hash) of every word and word beginning, repeats included."""
    data = LOWER[data]
    ws, we, wd = words(data, offsets)
    # Punctuation next to a word is no part of it.
    punct = ((data < 0x30) | (data > 0x39) & (data < 0x61) | (data > 0x7A)) & (data < 0x80)
    live = we > ws
    for _ in range(4):
        ws = ws + (live & punct[np.minimum(ws, len(data) - 1)])
        live = we > ws
        we = we - (live & punct[we - 1])
        live = we > ws
    ws, we, wd = ws[live], we[live], wd[live]
    docs, out = [wd], [word_hashes(data, ws, we)]
    for n in BEGINNINGS:
        long = we - ws > n
        docs.append(wd[long])
        out.append(mix(word_hashes(data, ws[long], ws[long] + n) ^ U(n)))
    return np.concatenate(docs), np.concatenate(out)


class Lookup:
    """Codes of entries in a fixed vocabulary; a bit table drops most others first."""

    def __init__(self, vocabulary: np.ndarray):
        self.sorted = np.sort(vocabulary)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.sorted & U((1 << 20) - 1)] = True

    def find(self, d: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, code) of the entries that the vocabulary holds."""
        maybe = self.bits[x & U((1 << 20) - 1)]
        d, x = d[maybe], x[maybe]
        at = np.minimum(np.searchsorted(self.sorted, x), max(0, len(self.sorted) - 1))
        hit = self.sorted[at] == x if len(self.sorted) else np.zeros(len(x), bool)
        return d[hit], at[hit]


def _count_rows(pending: int = PENDING):
    """(entry, toxic, clean): in how many toxic and clean documents of the task each entry is."""
    schema = pa.schema([("entry", pa.int64()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            e, at = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
            n = np.concatenate([c for _, c in parts])
            return e, np.stack([np.bincount(at, weights=n[:, k], minlength=len(e)) for k in (0, 1)], axis=1).astype(np.int64)

        def sent() -> pa.RecordBatch:
            e, n = parts[0]
            return pa.RecordBatch.from_arrays([pa.array(e.view(np.int64)), pa.array(n[:, 0]), pa.array(n[:, 1])], schema=schema)

        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False) == 1
            data, offsets = utf8(batch.column("text"))
            for lo, hi in chunks(offsets):
                o = offsets[lo : hi + 1]
                d, x = entries(data[o[0] : o[-1]], o - o[0])
                order = np.lexsort((d, x))
                d, x = d[order], x[order]
                new = np.ones(len(x), bool)
                new[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
                d, x = d[new], x[new]
                is_toxic = toxic[lo:hi][d]
                parts.append((x, np.stack([is_toxic, ~is_toxic], axis=1)))
                size += len(x)
                if size > 2 * pending:
                    parts[:] = [merged()]
                    size = len(parts[0][0])
                    if size > pending:
                        yield sent()
                        parts[:], size = [], 0
        if parts:
            parts[:] = [merged()]
            yield sent()

    return run, "entry long, toxic long, clean long"


def _hits(vocabulary: np.ndarray, keep: list[str], kinds: str):
    """Codes and counts of vocabulary entries in each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(vocabulary)
        size = max(1, len(vocabulary))
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in chunks(offsets):
                o = offsets[lo : hi + 1]
                d, at = look.find(*entries(data[o[0] : o[-1]], o - o[0]))
                pair, n = np.unique(d * size + at, return_counts=True)
                off = np.searchsorted(pair // size, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, hi - lo) for c in keep), pa.ListArray.from_arrays(off, pa.array(pair % size, pa.int32())), pa.ListArray.from_arrays(off, pa.array(n, pa.int32()))],
                    names=[*keep, "code", "n"],
                )

    return run, f"{kinds}, code array<int>, n array<int>"


def choose_voters(row: np.ndarray, code: np.ndarray, rows: int, weight: np.ndarray, most: int) -> np.ndarray:
    """Codes of up to `most` entries that reach many toxic rows together, from the hits (row, code) of each entry once a row.

    Greedy: an entry counts its weight over the rows that it is in, and a row
    counts half as much after each choice that is in it.
    """
    left = np.ones(rows)
    by_code = np.argsort(code, kind="stable")
    first = np.searchsorted(code[by_code], np.arange(len(weight) + 1))
    gain = weight * np.bincount(code, minlength=len(weight))
    chosen: list[int] = []
    while len(chosen) < most:
        best = int(gain.argmax())
        if gain[best] < weight[best] * 0.5:
            break
        chosen.append(best)
        left[row[by_code[first[best] : first[best + 1]]]] *= 0.5
        gain = weight * np.bincount(code, weights=left[row], minlength=len(weight))
        gain[chosen] = 0
    return np.array(chosen, np.int64)


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 25, marked: tuple[float, float] = MARKED) -> np.ndarray:
    """Posterior of the toxic class of each row from votes (rows, voters; 1 where one fires) and the annotator's labels.

    Every voter has a firing rate on either class; where it does not fire, it
    abstains. Its evidence is divided by
    one plus its positive correlations with other voters inside the classes,
    so that a word and its beginnings count about once. The annotator's rates
    have a prior as strong as the rows themselves, so the classes stay theirs.
    """
    v, y, known = votes.astype(float), labels.astype(float), float(len(labels))
    post = np.where(y > 0, 0.95, 0.05)
    for _ in range(rounds):
        w1, w0 = post.sum(), (1 - post).sum()
        fire1, fire0 = (post @ v + 0.5) / (w1 + 1), ((1 - post) @ v + 0.5) / (w0 + 1)
        hit1, hit0 = (post @ y + marked[0] * known) / (w1 + known), ((1 - post) @ y + marked[1] * known) / (w0 + known)
        inside = 0.0
        for p, f, w in ((post, fire1, w1), (1 - post, fire0, w0)):
            c = (v * p[:, None]).T @ v / max(w, 1e-9) - np.outer(f, f)
            s = np.sqrt(np.maximum(f * (1 - f), 1e-9))
            inside = inside + np.clip(c / np.outer(s, s), 0, 1) * w
        inside = inside / max(w1 + w0, 1e-9)
        np.fill_diagonal(inside, 0)
        share = 1 / (1 + inside.sum(axis=1))
        odds = np.log((w1 + 1) / (w0 + 1)) + v @ (np.log(fire1 / fire0) * share) + np.where(y > 0, np.log(hit1 / hit0), np.log((1 - hit1) / (1 - hit0)))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - post).max() < 1e-4:
            return new
        post = new
    return post


def train_linear(x: np.ndarray, target: np.ndarray, penalty: float = 0.05, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on soft labels by accelerated gradient steps."""
    n, m = x.shape
    w, b, vw, vb = np.zeros(m), 0.0, np.zeros(m), 0.0
    step = 4.0 / (1 + (x * x).sum(axis=1).mean())
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ vw + vb, -30, 30)))
        e = (p - target) / n
        nw, nb = vw - step * (x.T @ e + penalty / n * vw), vb - step * e.sum()
        vw, vb = nw + k / (k + 3) * (nw - w), nb + k / (k + 3) * (nb - b)
        w, b = nw, nb
    return w, float(b)


@dataclass
class ToxicityModel:
    vocabulary: np.ndarray
    weights: np.ndarray
    bias: float


def telling_entries(train: DataFrame, n1: int, n0: int, eligible: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of the `eligible` entries that tell most of the toxic rows of train(toxic, text), by the hash.

    Counts cover all rows. Entries in at least LEAST_TOXIC_ROWS toxic rows and four
    times as frequent there are ranked by toxic rows times the logarithm of that ratio.
    """
    run, kind = _count_rows()
    counts = train.select("toxic", "text").mapInArrow(run, kind).groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ratio = (F.col("toxic") + 0.5) / F.lit(n1 + 1.0) / ((F.col("clean") + 0.5) / F.lit(n0 + 1.0))
    told = counts.where(F.col("toxic") >= LEAST_TOXIC_ROWS).withColumn("ratio", ratio).where("ratio >= 4").withColumn("weight", F.log("ratio"))
    found = told.orderBy(F.desc(F.col("toxic") * F.col("weight")), "entry").limit(eligible).select("entry", "weight").toPandas()
    entry, weight = found["entry"].to_numpy(np.int64).view(U), found["weight"].to_numpy(float)
    order = np.argsort(entry)
    return entry[order], weight[order]


def fit_toxicity(docs: DataFrame, labels: DataFrame, eligible: int = ELIGIBLE, voters: int = VOTERS, rows_per_class: int = ROWS_PER_CLASS) -> ToxicityModel:
    """Learn from labels(doc_id, toxic) on docs(doc_id, text), outside the held-out fold.

    Entry counts cover all labelled rows; voters are chosen, and the label
    model and the classifier fitted, on the rows of at most `rows_per_class`
    labelled documents of each class, the first by a hash of doc_id. Only
    labelled texts are shuffled, once. A doc_id with several labels is toxic
    if one of them says so. Without toxic rows the model has no voters and
    scores every text by the prior.
    """
    marks = labels.where("toxic is not null and doc_id is not null").where(~fold()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") == 1).cast("int").alias("toxic"))
    marks = staged(marks, "marks")
    texts = only_wanted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), marks, "doc_id")
    # Merged at every size: labels grow with the input.
    train = staged(texts.join(marks.hint("merge"), "doc_id").select("doc_id", "toxic", "text"), "labelled")
    total = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    prior = float(np.log((n1 + 1) / (n0 + 1)))
    none = ToxicityModel(np.zeros(0, U), np.zeros(0), prior)
    if not n1:
        return none
    vocabulary, weight = telling_entries(train, n1, n0, eligible)
    if not len(vocabulary):
        return none
    ids = train.select("doc_id", "toxic").distinct()
    first = [ids.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class).select("doc_id") for c in (0, 1)]
    sample = train.join(F.broadcast(first[0].unionByName(first[1])), "doc_id").select(F.col("toxic").cast("long").alias("toxic"), F.xxhash64("doc_id", "text").alias("order"), "text")
    run, kind = _hits(vocabulary, ["toxic", "order"], "toxic long, order long")
    rows = sorted(sample.mapInArrow(run, kind).collect(), key=lambda r: (r["order"], r["toxic"]))
    marks = np.array([float(r["toxic"] == 1) for r in rows])
    hits = [(i, c) for i, r in enumerate(rows) if marks[i] for c in r["code"]]
    row, code = np.array(hits, np.int64).reshape(-1, 2).T
    chosen = np.sort(choose_voters(row, code, len(rows), weight, voters))
    if not len(chosen):
        return none
    column = np.full(len(vocabulary), -1)
    column[chosen] = np.arange(len(chosen))
    x = np.zeros((len(rows), len(chosen)), np.float32)
    for i, r in enumerate(rows):
        at = column[np.array(r["code"], np.int64)]
        x[i, at[at >= 0]] = np.log1p(np.array(r["n"]))[at >= 0]
    post = label_model((x > 0).astype(np.float32), marks)
    w, b = train_linear(x, post)
    # The sample holds the classes in other shares than the labelled rows do.
    s1, s0 = marks.sum(), len(marks) - marks.sum()
    shift = np.log(n1 / max(s1, 1)) - np.log(max(n0, 1) / max(s0, 1))
    return ToxicityModel(vocabulary[chosen], w, b + float(shift))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        look = Lookup(model.vocabulary)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in chunks(offsets):
                o = offsets[lo : hi + 1]
                n, size = hi - lo, max(1, len(model.vocabulary))
                d, at = look.find(*entries(data[o[0] : o[-1]], o - o[0]))
                pair, times = np.unique(d * size + at, return_counts=True)
                odds = np.full(n, model.bias)
                if len(pair):
                    odds += np.bincount(pair // size, weights=model.weights[pair % size] * np.log1p(times), minlength=n)
                score = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(lo, n) for c in ("doc_id", "held_out")] + [pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
                )

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs(doc_id, text).

    Only the text enters a score. Null and empty texts get the score of a
    text without any entry; null doc_ids are not held out; repeated rows are
    scored one by one; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold().alias("held_out"), "text")
    return source.mapInArrow(_score(shared), "doc_id long, held_out boolean, score double, predicted int")
