"""Connected components of an edge list, by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable from each node of edges(a, b).

    Rounds of large-star and small-star rewire every node to the least
    neighbour it sees; each round is two aggregations and two joins over the
    remaining edges, staged so that rounds do not build on each other's
    lineage. A hub's edges are only aggregated and joined, never gathered.
    Edges with a null end and self-edges count for nothing; nodes without
    edges do not appear; no edges give no rows.
    """
    e = staged(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.withColumnRenamed("m", "v")).distinct()
        )
        e = staged(small, "edges")
        after = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
