"""A query set against all rows, block by block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 4096


def against_all(queries: DataFrame, rows: DataFrame, key: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each query with each row.

    Rows are dealt to blocks of about `block_rows` by a hash of `key`, and a
    query goes once to every block, so the work spreads over the blocks. Up
    to `block_rows` rows, which have been counted, are broadcast as they
    are, and the queries are spread.
    """
    blocks = max(1, -(-rows.count() // block_rows))
    if blocks == 1:
        spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        one = F.lit(0)
        return queries.repartition(spread).withColumn("_block", one).join(F.broadcast(rows.withColumn("_block", one)), "_block").drop("_block")
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)))
    return queries.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(dealt, "_block").drop("_block")


def top_per(df: DataFrame, keys: list[str], by: list, n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each key, numbered from 1."""
    from pyspark.sql import Window

    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col(name) <= n)
