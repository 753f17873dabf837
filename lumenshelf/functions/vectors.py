"""Vector arithmetic on array<double> columns, in native expressions."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product, summed in array order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column | str) -> Column:
    """v over its length; the zero vector stays zero."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(F.col(v) if isinstance(v, str) else v)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity, 0 where a side has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def max_sim(query: Column | str, candidate: Column | str) -> Column:
    """Mean over query vectors of the best inner product with a candidate vector; 0 if either side is empty."""
    best = F.transform(query, lambda q: F.array_max(F.transform(candidate, lambda c: dot(q, c))))
    mean = F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(query)
    return F.when((F.size(query) > 0) & (F.size(candidate) > 0), mean).otherwise(F.lit(0.0))


def min_max(x: Column, low: Column, high: Column) -> Column:
    return (x - low) / (high - low + F.lit(1e-9))


def weighted_mean(df: DataFrame, keys: list[str], vec: str, weight: Column | None = None, name: str = "vec") -> DataFrame:
    """Per key, sum(weight * vec) / sum(weight), element by element; weight defaults to 1.

    Rows of weight 0 count for nothing; a key without weight is absent.
    """
    w = F.lit(1.0) if weight is None else weight
    rows = df.select(*keys, w.cast("double").alias("_w"), F.col(vec).alias("_v"), F.size(vec).alias("_n")).where("_w > 0 and _n > 0")
    # Whole vectors are added up, those of each length by themselves: a row for each of their numbers would be many times as many.
    by = rows.groupBy(*keys, "_n").agg(Summarizer.mean(array_to_vector("_v"), F.col("_w")).alias("_m"), F.sum("_w").alias("_w"))
    lengths = by.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_n", "_w", vector_to_array("_m").alias("_m")))).alias("_l"))

    def at(i: Column) -> Column:
        longer = F.filter("_l", lambda s: s["_n"] > i)
        return F.aggregate(longer, F.lit(0.0), lambda a, s: a + s["_w"] * s["_m"][i]) / F.aggregate(longer, F.lit(0.0), lambda a, s: a + s["_w"])

    mixed = F.transform(F.sequence(F.lit(0), F.col("_l")[F.size("_l") - 1]["_n"] - 1), at)
    return lengths.select(*keys, F.when(F.size("_l") == 1, F.col("_l")[0]["_m"]).otherwise(mixed).alias(name))
