"""Sharding along a Hilbert curve over several metadata dimensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import ordered_positions
from .staging import staged

#: Bits a dimension; with four dimensions an index has 32 bits.
BITS = 8


def hilbert_index(cells: list[np.ndarray], bits: int) -> np.ndarray:
    """Place of each point on the Hilbert curve through a cube of side 2**bits.

    Bit by bit from the top, the orthant code is turned by the reflections
    and exchanges that the higher bits have caused, then the Gray code of
    the whole is undone.
    """
    x = [c.astype(np.int64) for c in cells]
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            up = (x[i] >> b & 1).astype(bool)
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | ((x[i] ^ turn) >> b & 1)
    return out


def _cell(rank: Column, total: Column, bits: int) -> Column:
    """Quantile cell of a rank from 0, of `total` ranks."""
    return F.least(F.floor(rank * (1 << bits) / F.greatest(total, F.lit(1))), F.lit((1 << bits) - 1)).cast("int")


def value_cells(rows: DataFrame, column: str, bits: int) -> DataFrame:
    """(column, cell): order-preserving quantile cells of the distinct values, nulls in cell 0."""
    values = ordered_positions(rows.select(column).where(F.col(column).isNotNull()).distinct(), [F.col(column)], "_rank", "values")
    return values.select(column, _cell(F.col("_rank"), F.lit(values.count()), bits).alias("cell"))


def runs_of(at: str, total: int, shards: int) -> tuple[Column, Column]:
    """(shard, slot) of the position in column `at`, of `total` positions cut into runs whose lengths differ by one at most.

    Run s holds the positions from ceil(s * total / shards) on. All of it is
    64-bit integer division, exact for up to 2**62 / shards positions.
    """
    shard = f"{at} * {shards} div {max(total, 1)}"
    first = f"(({shard}) * {total} + {shards - 1}) div {shards}"
    return F.expr(shard).cast("int"), F.expr(f"{at} - {first}").cast("long")


def hilbert_shards(docs: DataFrame, shards: int = 24, bits: int = BITS) -> DataFrame:
    """Shards of equal row counts, cut from the Hilbert order of (lang, source, size, doc_id).

    docs needs doc_id, text, lang and source; other columns are ignored.
    Each dimension is quantised to 2**bits cells: lang and source by the
    order of their distinct values, size by its logarithm, doc_id by its
    quantiles. Rows are ordered by curve index, then doc_id, then size and
    checksum, and cut into runs whose lengths differ by one at most (law
    `rows`), so each shard's files span a narrow range of every dimension.

    Returns doc_id, size (UTF-8 bytes plus 8), text_crc32, law, shard, slot,
    grown_shard (null under this law) and hilbert. Null texts have no bytes,
    null lang, source or doc_id take the lowest cell; rows that repeat are
    placed one by one. With fewer rows than shards the last shards stay
    empty. No rows give no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = staged(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "lang", "source"
        ),
        "metadata",
    )
    low, high, total = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    low, high = (0, 0) if low is None else (low, high)
    log_cell = F.least(F.floor(F.log2("size") * ((1 << bits) / 32)), F.lit((1 << bits) - 1)).cast("int")
    id_cell = F.coalesce(_cell(F.col("doc_id").cast("double") - low, F.lit(float(high - low + 1)), bits), F.lit(0))
    cells = rows
    for c in ("lang", "source"):
        cells = cells.join(value_cells(rows, c, bits).withColumnRenamed("cell", f"{c}_cell"), c, "left")
    cells = cells.select("doc_id", "size", "text_crc32", F.coalesce("lang_cell", F.lit(0)).alias("a"), F.coalesce("source_cell", F.lit(0)).alias("b"), log_cell.alias("c"), id_cell.alias("d"))

    @F.pandas_udf("long")
    def curve(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index([x.to_numpy() for x in (a, b, c, d)], bits))

    indexed = cells.withColumn("hilbert", curve("a", "b", "c", "d")).drop("a", "b", "c", "d")
    placed = ordered_positions(indexed, [F.col(c) for c in ("hilbert", "doc_id", "size", "text_crc32")], "_at", "curve")
    shard, slot = runs_of("_at", total, shards)
    placed = placed.withColumns({"shard": shard, "slot": slot})
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert"
    )
