"""Vectors of texts from an injected function, each different text computed once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: From a batch of texts to as many vectors.
Embed = Callable[[Sequence[str]], Sequence[Sequence[float]]]
#: Texts that one call gets.
BATCH = 256


def hash_embedder(dims: int = 16) -> Embed:
    """A function for tests: component i is byte i of the text's SHA-256, divided by 255."""

    def embed(texts: Sequence[str]) -> list[list[float]]:
        return [[b / 255 for b in hashlib.sha256(t.encode()).digest()[:dims]] for t in texts]

    return embed


def cached(spark: SparkSession, path: str) -> DataFrame:
    """content_hash, model, vec of the cache table, or no rows where there is none yet."""
    kind, where = "content_hash string, vec array<double>, model string", spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(path)


def embed_missing(texts: DataFrame, embed: Embed, path: str, model: str, batch: int = BATCH) -> None:
    """Add to the cache at `path` the vectors of the texts(text) that it lacks for this model.

    Equal texts are one call; null and blank texts none. The function runs in
    tasks, on up to `batch` texts at a time, and must give the same vector
    when a task runs again. New rows are appended as one commit.
    """
    spark = texts.sparkSession
    wanted = texts.where(F.trim("text") != "").select(F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), "text")
    wanted = wanted.groupBy("content_hash").agg(F.any_value("text").alias("text"))
    missing = wanted.join(cached(spark, path).where(F.col("model") == model).select("content_hash"), "content_hash", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                vectors = [[float(x) for x in v] for v in embed(part.column("text").to_pylist())]
                if len(vectors) != part.num_rows:
                    raise ValueError(f"{len(vectors)} vectors for {part.num_rows} texts")
                yield pa.RecordBatch.from_arrays([part.column("content_hash"), pa.array(vectors, pa.list_(pa.float64()))], names=["content_hash", "vec"])

    made = missing.mapInArrow(run, "content_hash string, vec array<double>").withColumn("model", F.lit(model))
    made.write.mode("append").partitionBy("model").parquet(path)


def embedded(rows: DataFrame, embed: Embed, path: str, model: str, batch: int = BATCH) -> DataFrame:
    """rows(text, ...) with `vec`, from the cache at `path`, which is filled up first; null and blank texts have none."""
    embed_missing(rows.select("text"), embed, path, model, batch)
    known = cached(rows.sparkSession, path).where(F.col("model") == model).select("content_hash", "vec")
    return rows.withColumn("content_hash", F.sha2(F.col("text").cast("binary"), 256)).join(known, "content_hash", "left").drop("content_hash")
