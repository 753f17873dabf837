"""A filter of bounded size that keeps rows nobody asks for out of a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkernel import U

#: Bits a wanted row, and the most of all: 16 MB, broadcast.
BITS_PER_ROW, MOST_BITS = 16, 1 << 27


def only_wanted(rows: DataFrame, wanted: DataFrame, key: str, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows whose key may be in `wanted`; the exact join is the caller's.

    The bitmap has BITS_PER_ROW bits for each counted row of `wanted`, up to
    `most_bits`; up to there about one row in 16 that nobody asks for stays.
    Beyond, the share that stays rises to all, which costs the caller's join
    one shuffle of `rows` and changes no result. Null keys may go.
    """
    bits = min(most_bits, max(1 << 16, 1 << (wanted.count() * BITS_PER_ROW - 1).bit_length()))

    def slot() -> Column:
        return F.pmod(F.xxhash64(key), F.lit(bits))

    found = (
        wanted.select(slot().alias("s")).groupBy(F.expr("s div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("b")).toArrow()
    )
    bitmap = np.zeros(bits // 64, U)
    bitmap[found["w"].to_numpy()] = found["b"].to_numpy().view(U)
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column("_slot").to_numpy()
            hit = (shared.value[s >> 6] >> (s & 63).astype(U) & U(1)).astype(bool)
            yield batch.select(names).filter(pa.array(hit))

    return rows.withColumn("_slot", slot()).mapInArrow(run, rows.schema)
