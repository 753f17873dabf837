"""Refreshing a table partition by partition."""

from __future__ import annotations

from pyspark.sql import DataFrame


def refresh_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Replace the partitions that rows fall into; all others keep their files.

    This is delete-and-insert of the touched partitions in one commit: new
    files are staged first, and a failed job leaves the table as it was. A
    partition that rows do not touch cannot be emptied this way.
    """
    rows.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
