"""Cutting the lineage of a table that later steps read several times."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    Only a session in one JVM may lack that folder; a temporary one is used
    then and removed at exit. On a cluster an unset folder is an error, as a
    temporary one would be another on each machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lumenshelf-saved-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(f"file://{folder}")
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    # A checkpoint computes its rows twice, unless they are kept meanwhile.
    kept = df.persist()
    out = kept.checkpoint()
    kept.unpersist()
    return out


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, kept nowhere else, and small where rows hold long lists."""
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
