"""Places in a total order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def positions(rows: DataFrame, by: list, name: str) -> DataFrame:
    """Add `name`, each row's place from 1 in the total order `by`.

    Rows are dealt by range and numbered inside their partitions; the sizes
    of the partitions before, one row each, are added. `by` must order all
    rows, so that a task that runs again numbers them alike.
    """
    dealt = rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id())
    inside = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*by)))
    # One row a partition meets here.
    before = inside.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
    return inside.join(F.broadcast(before.drop("_n")), "_part").withColumn(name, (F.col("_before") + F.col("_at")).cast("int")).drop("_part", "_at", "_before")
