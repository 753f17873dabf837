"""Positions in a total order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged


def ordered_positions(df: DataFrame, by: list[Column], name: str, label: str = "ordered") -> DataFrame:
    """Add `name`, each row's position from 0 in the order `by`.

    Rows are range-partitioned and sorted, numbered inside their partition,
    and shifted by the sizes of the partitions before; only those sizes, one
    row a partition, meet in one task. `by` should order all rows, or rows
    that tie get any order among themselves. The result is staged, so a rerun
    of a task cannot change a position. No rows give no rows.
    """
    inner = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    part = staged(
        df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"_part": F.spark_partition_id(), "_inner": inner}),
        label,
    )
    before = part.groupBy("_part").agg(F.count("*").alias("_n")).withColumn(
        "_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    )
    before = before.select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    return part.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_inner")).drop("_part", "_inner", "_before")
