"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over every labelled text of the training
fold. The regression is trained online with follow-the-regularised-leader
(FTRL-proximal, L1 and L2 penalties) on a bounded sample per language, and
its scores are calibrated by a temperature fitted on held-back rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkernel import U, chunks, utf8

#: Hashed n-gram buckets.
BUCKETS = 1 << 15
#: Labelled rows per language that the regression is trained on, at most.
SAMPLE_PER_LANGUAGE = 1000
UNKNOWN = "und"


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the simple lower case (space for what is no letter), and whether it is a letter."""
    lower = np.full(0x110000, 0x20, np.uint32)
    letter = np.zeros(0x110000, bool)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            letter[c] = True
            low = s.lower()
            lower[c] = ord(low) if len(low) == 1 else c
    return lower, letter


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a batch of UTF-8 texts and their offsets; bytes that are no UTF-8 become U+FFFD."""
    raw = data.tobytes()
    try:
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        return points, starts[offsets]
    except UnicodeDecodeError:
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
        return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def ngram_buckets(points: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every n-gram of 1 to 3 characters; n-grams never cross documents."""
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    c = _letters()[0][points].astype(U)
    docs, out = [], []
    shift = U(64 - buckets.bit_length() + 1)
    h = np.zeros(len(c), U)
    for n in (1, 2, 3):
        m = len(c) - n + 1
        if m <= 0:
            break
        h = h[:m] * U(0x9E3779B97F4A7C15) + (c[n - 1 :] + U(n)) * U(0xD6E8FEB86659FD93)
        ok = doc[:m] == doc[n - 1 :]
        docs.append(doc[:m][ok])
        out.append(((h ^ h >> U(29)) * U(0xBF58476D1CE4E5B9) >> shift)[ok].astype(np.int32))
    if not docs:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(docs), np.concatenate(out)


def _document_frequencies(buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(buckets, np.int64), 0
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in chunks(offsets, 1 << 20):
                o = offsets[lo : hi + 1]
                d, b = ngram_buckets(*code_points(data[o[0] : o[-1]], o - o[0]), buckets)
                for first in range(0, hi - lo, 512):
                    part = (d >= first) & (d < first + 512)
                    has = np.zeros((min(512, hi - lo - first), buckets), bool)
                    has[d[part] - first, b[part]] = True
                    total += has.sum(axis=0)
                seen += hi - lo
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], seen)), pa.array(np.zeros(len(at) + 1, np.int64))], schema=schema)

    return run, "bucket int, n long, docs long"


def _frequencies_of(buckets: int):
    """Relative n-gram frequencies of each document, sparse: buckets as 32-bit integers and frequencies as 32-bit floats, packed."""
    schema = pa.schema([("lang", pa.string()), ("order", pa.int64()), ("times", pa.int64()), ("bucket", pa.binary()), ("tf", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i in range(batch.num_rows):
                a, b = offsets[i], offsets[i + 1]
                _, g = ngram_buckets(*code_points(data[a:b], np.array([0, b - a])), buckets)
                at, n = np.unique(g, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang").slice(i, 1).cast(pa.string()), batch.column("order").slice(i, 1), batch.column("times").slice(i, 1), pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([(n / max(1, n.sum())).astype("<f4").tobytes()], pa.binary())],
                    schema=schema,
                )

    return run, "lang string, order long, times long, bucket binary, tf binary"


@dataclass
class LanguageModel:
    """Per-bucket class scores (IDF folded in), the bias, and the temperature."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    buckets: int


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, buckets: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3) -> np.ndarray:
    """Weights (buckets + 1, classes) by FTRL-proximal; the last row is the bias."""
    z = np.zeros((buckets + 1, classes))
    n = np.zeros((buckets + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            at, x, y = rows[r]
            at, x = np.append(at, buckets), np.append(x, 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = np.outer(x, p)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(buckets + 1))


def fit_temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, on a grid."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    return float(min(grid, key=loss))


def fold(doc_id: str = "doc_id") -> Column:
    """True where the document is held out of training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_rows(rows: DataFrame, most: int, buckets: int) -> list[tuple[int, str, np.ndarray, np.ndarray]]:
    """(order, lang, buckets, frequencies) of the `most` rows of each language of rows(order, text, lang) with the lowest order, in that order.

    A threshold a language, somewhat above what evenly spread orders need,
    keeps the rest out of the shuffle. Rows equal in order are equal rows:
    they travel once, with their number. Where they leave a language short,
    its threshold is raised and its rows are read again.
    """
    count = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    unit = F.shiftrightunsigned(F.col("order"), 11) / float(1 << 53)
    rate = {c: (most + 6 * most**0.5 + 20) / n for c, n in count.items()}
    run, kind = _frequencies_of(buckets)
    out = []
    while rate:
        # As many rates as the model has classes; shuffling by language would gather a third of all texts in one task.
        rates = rows.sparkSession.createDataFrame(list(rate.items()), "lang string, rate double")
        drawn = rows.join(F.broadcast(rates), "lang").where(unit < F.col("rate")).groupBy("lang", "order").agg(F.first("text").alias("text"), F.count("*").alias("times"))
        found: dict[str, list] = {c: [] for c in rate}
        for r in drawn.mapInArrow(run, kind).collect():
            found[r["lang"]].append(r)
        for lang, rs in found.items():
            if rate[lang] < 1 and sum(r["times"] for r in rs) < most:
                rate[lang] *= 4
                continue
            del rate[lang]
            room = most
            # As the threshold takes the orders, without their sign.
            for r in sorted(rs, key=lambda r: r["order"] % (1 << 64)):
                take = min(room, r["times"])
                out += [(r["order"], lang, np.frombuffer(r["bucket"], "<i4").astype(np.int64), np.frombuffer(r["tf"], "<f4").astype(float))] * take
                room -= take
    return sorted(out, key=lambda r: r[:2])


def fit_language_model(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE, buckets: int = BUCKETS) -> LanguageModel | None:
    """Train on the rows of docs(doc_id, text, lang) outside the held-out fold; None if no row has a language.

    The classes are the languages of all these rows. The regression is fitted
    on `sample_per_language` rows of each, or all where a language has fewer:
    the lowest by a hash of doc_id and text, so that copies are drawn one by
    one; document frequencies cover all rows.
    """
    rows = docs.where(~fold() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.xxhash64("doc_id", "text", F.lit("sample")).alias("order"), "text", "lang")
    run, kind = _document_frequencies(buckets)
    counted = rows.select("text").mapInArrow(run, kind).groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(buckets)
    known = counted[counted["bucket"] >= 0]
    df[known["bucket"].to_numpy()] = known["n"].to_numpy()
    total = counted.loc[counted["bucket"] < 0, "n"].sum()
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    sample = sample_rows(rows, sample_per_language, buckets)
    langs = sorted({lang for _, lang, _, _ in sample})
    if not langs:
        return None
    code = {c: i for i, c in enumerate(langs)}
    data, held, seen = [], [], dict.fromkeys(langs, 0)
    for _, lang, bucket, tf in sample:
        row = (bucket, tf * idf[bucket] * 20.0, code[lang])
        # Every fifth row of a language is held back, so that each has rows to learn from.
        (held if seen[lang] % 5 == 4 else data).append(row)
        seen[lang] += 1
    w = train_ftrl(data, len(langs), buckets)
    scores = np.array([x @ w[at] + w[-1] for at, x, _ in held]).reshape(-1, len(langs))
    t = fit_temperature(scores, np.array([y for *_, y in held], np.int64))
    table = (w[:-1] * (20.0 * idf)[:, None]).astype(np.float32)
    return LanguageModel(langs, table, w[-1], t, buckets)


def predict_batch(model: LanguageModel, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class or -1, score) of each text."""
    n = len(offsets) - 1
    points, o = code_points(data, offsets)
    letter = np.concatenate([[0], np.cumsum(_letters()[1][points])])
    some = (letter[o[1:]] - letter[o[:-1]]) > 0
    d, b = ngram_buckets(points, o, model.buckets)
    count = np.maximum(np.bincount(d, minlength=n), 1)
    s = np.stack([np.bincount(d, weights=model.table[:, k][b], minlength=n) / count for k in range(len(model.langs))], axis=1) + model.bias
    s = s / model.temperature
    p = np.exp(s - s.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    return np.where(some, best, -1), np.where(some, p[np.arange(n), best], 0.0)


def _predict(shared, extra: list[str], types: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in chunks(offsets, 1 << 20):
                o = offsets[lo : hi + 1]
                if model is None:
                    best, score = np.full(hi - lo, -1), np.zeros(hi - lo)
                else:
                    best, score = predict_batch(model, data[o[0] : o[-1]], o - o[0])
                names = [model.langs[k] if k >= 0 else UNKNOWN for k in best]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in extra), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[*extra, *types])

    return run


def identify_languages(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs(doc_id, text).

    lang_pred is `und` with score 0 where the text is null or has no letter,
    or where no language could be learned. Null doc_ids are not held out;
    repeated rows are predicted one by one; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold().alias("held_out"), "text")
    return source.mapInArrow(_predict(shared, ["doc_id", "held_out"], ["lang_pred", "score"]), "doc_id long, held_out boolean, lang_pred string, score double")


#: Calibrated probability of a text's language below which the pipeline rejects it.
LEAST_SCORE = 0.5


def _identified(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in chunks(offsets, 1 << 20):
                o = offsets[lo : hi + 1]
                best, score = predict_batch(model, data[o[0] : o[-1]], o - o[0])
                yield batch.slice(lo, hi - lo).filter(pa.array((best >= 0) & (score >= least)))

    return run


def drop_unidentified(docs: DataFrame, model: LanguageModel | None, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs, all columns kept, whose language the model can tell.

    Texts that are null or have no letter go, and so do texts whose most
    likely language has a calibrated probability below `least`: at a half,
    texts of which no language is likelier than all others together. Without
    a model only the former go.
    """
    if model is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return docs.mapInArrow(_identified(docs.sparkSession.sparkContext.broadcast(model), least), docs.schema)
