"""Anchors: content-chosen places of a text where long repeats can be found.

A window of W units (bytes or words) that occurs twice has, in both places,
the same anchors: the places whose k-unit fingerprint is the least among
W - k + 1 neighbours. So it is enough to compare places with equal
fingerprints, about one in (W - k) / 2 units, and there only the context:
what windows of W units around the anchor can reach. A context is known by a
digest of its own bytes, so contexts of one digest are equal texts.

Contexts of one fingerprint form a group. A group of up to HOT contexts meets
in one task. In a larger one no context ever meets the others: windows are
narrowed down by counting digests of spans (`hot_windows`), so that a passage
that a third of all documents share costs each of them a few keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import only_wanted
from .staging import discard, staged
from .textkernel import U, Prefix, chunks, joined_words, minimizers, mix, utf8, word_hashes

#: 64-bit value of each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(0xA24BAED4963EE407))

#: Contexts of one fingerprint beyond which they are not compared in one task: about 2.5 MB of text, or 200 MB with its suffix ranks.
HOT = 4096
#: Parts that a range of windows is cut into at once.
FINER = 4
#: Rows that are taken from a record batch at once.
SLICE = 256

#: Of (data, offsets): the bytes to compare, start and end of each unit, the units' values, and each document's first unit.
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def byte_units(data: np.ndarray, offsets: np.ndarray):
    at = np.arange(len(data))
    return data, at, at + 1, BYTE_VALUES[data], offsets


def word_units(data: np.ndarray, offsets: np.ndarray):
    joined, start, end, doc = joined_words(data, offsets)
    return joined, start, end, word_hashes(joined, start, end), np.searchsorted(doc, np.arange(len(offsets)))


def digest(content: bytes, before: int) -> bytes:
    """16 bytes that stand for a span and the units of it before the anchor."""
    return hashlib.blake2b(content, digest_size=14).digest() + before.to_bytes(2, "big")


def numbered(docs: DataFrame) -> DataFrame:
    """(row_id, doc_id, text) with one row_id a row: doc_id itself where it is unique and never null."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    twice = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if twice.isEmpty():
        return rows.select(F.col("doc_id").alias("row_id"), "doc_id", "text")
    return staged(rows.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text"), "numbered")


def _anchors(units_of: Units, window: int, k: int):
    schema = pa.schema([("fp", pa.int64()), ("ctx", pa.binary()), ("row_id", pa.int64()), ("pos", pa.int32()), ("left", pa.int32()), ("right", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids = batch.column("row_id").to_numpy()
            for first, last in chunks(offsets):
                o = offsets[first : last + 1]
                raw, start, end, values, of = units_of(data[o[0] : o[-1]], o - o[0])
                raw, found, ctx = raw.tobytes(), [[] for _ in range(5)], []
                for i in range(last - first):
                    own = values[of[i] : of[i + 1]]
                    if len(own) < window:
                        continue
                    fp = Prefix(own).window(k)
                    at = minimizers(fp, window - k + 1)
                    lo, hi = np.maximum(at - (window - k), 0), np.minimum(at + window, len(own))
                    a, b = start[of[i] + lo].tolist(), end[of[i] + hi - 1].tolist()
                    ctx += [digest(raw[x:y], n) for x, y, n in zip(a, b, (at - lo).tolist())]
                    for column, x in zip(found, (fp[at].view(np.int64), np.full(len(at), ids[first + i]), at, at - lo, hi - at)):
                        column.append(x)
                if ctx:
                    fp, *rest = (np.concatenate(x) for x in found)
                    yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(ctx, pa.binary()), *(pa.array(x, t) for x, t in zip(rest, schema.types[2:]))], schema=schema)

    return run, "fp long, ctx binary, row_id long, pos int, left int, right int"


def anchors(rows: DataFrame, units_of: Units, window: int, k: int) -> DataFrame:
    """fp, ctx, row_id, pos, left, right of every anchor of rows(row_id, text).

    The context of an anchor is the units from pos - left to pos + right; ctx
    is its digest. Texts shorter than a window have no anchors.
    """
    run, kind = _anchors(units_of, window, k)
    return rows.select("row_id", "text").mapInArrow(run, kind)


def _contexts(units_of: Units, carry: list[str], types: list[pa.DataType]):
    names = ["fp", *carry, "row_id", "lo", "pos", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            out: list[list] = [[] for _ in names]

            def table() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, [pa.int64(), *types, pa.int64(), pa.int32(), pa.int32(), pa.binary()])], names=names)

            for i, (row, places) in enumerate(zip(batch.column("row_id").to_pylist(), batch.column("places").to_pylist())):
                own = data[offsets[i] : offsets[i + 1]]
                raw, start, end, _, _ = units_of(own, np.array([0, len(own)]))
                raw = raw.tobytes()
                for p in places:
                    lo, hi = p["pos"] - p["left"], p["pos"] + p["right"]
                    for column, x in zip(out, (p["fp"], *(p[c] for c in carry), row, lo, p["pos"], raw[start[lo] : end[hi - 1]])):
                        column.append(x)
                if len(out[0]) > 2000:
                    yield table()
                    out = [[] for _ in names]
            yield table()

    return run


def contexts(rows: DataFrame, places: DataFrame, units_of: Units, carry: dict[str, str] | None = None) -> DataFrame:
    """fp, carry, row_id, lo, pos, content of places(fp, row_id, pos, left, right, carry); carry gives the SQL type of each column."""
    carry = carry or {}
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    wanted = places.groupBy("row_id").agg(F.collect_list(F.struct("fp", "pos", "left", "right", *carry)).alias("places"))
    texts = only_wanted(rows.select("row_id", "text"), places, "row_id")
    kind = "".join(f"{c} {t}, " for c, t in {"fp": "long", **carry}.items()) + "row_id long, lo int, pos int, content binary"
    return texts.join(wanted.hint("merge"), "row_id").select("row_id", "text", "places").mapInArrow(_contexts(units_of, [*carry], [kinds[t] for t in carry.values()]), kind)


def _starts(content: bytes, words: bool) -> np.ndarray:
    """Start of each unit of a context, and of one past the last."""
    if not words:
        return np.arange(len(content) + 1)
    space = np.flatnonzero(np.frombuffer(content, np.uint8) == 0x20)
    return np.concatenate([[0], space + 1, [len(content) + 1]])


def _span_keys(window: int, k: int, width: int, words: bool):
    """Digests of the spans that all windows of a range share, and that they cover together.

    A window that starts `a` units before the anchor is window a; range j has
    windows j * width to (j + 1) * width - 1.
    """
    slack, gap = window - k, 1 if words else 0
    schema = pa.schema([("fp", pa.int64()), ("ctx", pa.binary()), ("ord", pa.int64()), ("part", pa.int32()), ("inner", pa.binary()), ("outer", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for fp, ctx, order, parts, lo, pos, content in zip(*(batch.column(c).to_pylist() for c in ("fp", "ctx", "ord", "parts", "lo", "pos", "content"))):
                start, before = _starts(content, words), pos - lo
                after = len(start) - 1 - before
                for j in range(-(-(slack + 1) // width)) if parts is None else parts:
                    near, far = j * width, min((j + 1) * width - 1, slack)
                    if before < near or after < window - far:
                        continue
                    keys = []
                    for a, b in ((near, window - far), (far, window - near)):
                        inside = before >= a and after >= b
                        # The fingerprint and the range are part of the key.
                        span = content[start[before - a] : start[before + b] - gap] if inside else b""
                        keys.append(digest(span + fp.to_bytes(8, "big", signed=True), j) if inside else None)
                    for column, x in zip(out, (fp, ctx, order, j, *keys)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, schema.types)], schema=schema)

    return run, "fp long, ctx binary, ord long, part int, inner binary, outer binary"


def hot_windows(found: DataFrame, window: int, k: int, words: bool, hit: Callable[[Column, Column, Column], Column], finer: int = FINER) -> DataFrame | None:
    """(fp, ctx, spans of s and e): windows, from s to e relative to the anchor, that contexts of large groups share; None where there is no context.

    found is staged (fp, ctx, ord, lo, pos, content). `hit` of (rows with a
    key, their least ord, the row's own ord) says whether a key counts. The
    windows around an anchor are taken in ranges. Where what a range covers
    counts, all its windows do, and one context goes on for all that agree on
    it, so that others can still find it; where no other context has what a
    range's windows have in common, none counts; else the range is cut into
    `finer` ranges. Digests are counted
    with partial aggregation and joined to staged counts, which Spark can
    split, so no group meets anywhere.
    """
    if found.isEmpty():
        return None
    slack = window - k
    widths = [1]
    while widths[-1] * finer <= slack:
        widths.append(widths[-1] * finer)
    state, marks = found.withColumn("parts", F.lit(None).cast("array<int>")), None
    for level, width in enumerate(reversed(widths)):
        run, kind = _span_keys(window, k, width, words)
        keys = staged(state.select("fp", "ctx", "ord", "parts", "lo", "pos", "content").mapInArrow(run, kind), "spans")

        def counted(name: str, *more: Column) -> DataFrame:
            return staged(keys.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"), *more).where("n > 1"), "counts")

        inner, outer = counted("inner"), counted("outer", F.min("ord").alias("least"), F.min(F.struct("ord", "ctx")).alias("lead"))
        open_ = keys.join(inner.select("inner"), "inner", "left_semi").join(outer, "outer", "left")
        whole = F.coalesce(hit(F.col("n"), F.col("least"), F.col("ord")), F.lit(False))
        open_ = staged(open_.select("fp", "ctx", "part", whole.alias("whole"), F.coalesce(F.col("lead.ctx") == F.col("ctx"), F.lit(False)).alias("leads")), "open")
        far = F.least((F.col("part") + 1) * width - 1, F.lit(slack))
        new = staged(open_.where("whole").select("fp", "ctx", (-far).cast("int").alias("s"), (F.lit(window) - F.col("part") * width).cast("int").alias("e")), "windows")
        marks = new if marks is None else marks.unionByName(new)
        rest = open_.where("leads or not whole")
        if width == 1 or rest.isEmpty():
            discard(keys, inner, outer, open_)
            break
        below = list(reversed(widths))[level + 1]
        children = F.sequence((F.col("part") * width / below).cast("int"), ((F.col("part") + 1) * width / below).cast("int") - 1)
        parts = staged(rest.select("fp", "ctx", children.alias("c")).groupBy("fp", "ctx").agg(F.flatten(F.collect_list("c")).alias("parts")), "parts")
        state = found.join(parts, ["fp", "ctx"])
        discard(keys, inner, outer, open_)
    return marks.groupBy("fp", "ctx").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def batches_of_groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[dict[str, list]]:
    """Rows sorted by fp, as columns, in runs of whole groups of about `limit` content bytes; groups of one row go."""
    held: dict[str, list] = {}
    size = 0

    def cut(upto: int) -> dict[str, list]:
        grp = np.array(held["fp"][:upto])
        twin = np.zeros(upto, bool)
        same = grp[1:] == grp[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        at = np.flatnonzero(twin)
        return {c: [x[i] for i in at] for c, x in held.items()}

    # A record batch may hold many times the limit, so it is taken in slices.
    slices = (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE))
    for batch in slices:
        for c in batch.schema.names:
            held.setdefault(c, []).extend(batch.column(c).to_pylist())
        size += sum(map(len, held["content"][-batch.num_rows :]))
        if size >= limit:
            last, upto = held["fp"][-1], len(held["fp"])
            while upto and held["fp"][upto - 1] == last:
                upto -= 1
            if upto:
                if len((out := cut(upto))["fp"]):
                    yield out
                held = {c: x[upto:] for c, x in held.items()}
                size = sum(map(len, held["content"]))
    if held and len((out := cut(len(held["fp"])))["fp"]):
        yield out
