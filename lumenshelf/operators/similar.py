"""Similar items: penalised inner products, edition collapse, over-fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import unit, weighted_mean
from . import kernels
from .blocks import top_per

# --- fixed values -----------------------------------------------------------
TIER_FACTOR = {"rich": 1.0, "kakao_desc": 0.95, "minimal": 0.85}
# ----------------------------------------------------------------------------


def penalised(score: Column, tier: Column) -> Column:
    """Score times its tier's factor where the score is positive; negative scores stay."""
    factor = F.coalesce(*(F.when(tier == t, F.lit(f)) for t, f in TIER_FACTOR.items()), F.lit(1.0))
    return F.when(score > 0, score * factor).otherwise(score)


def similar_to_vectors(queries: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """query_id, rank, book_id, score of the n best items for queries(query_id, vec, exclude); ties to the smaller id.

    `exclude` is an array of book ids that may not appear. Queries meet the
    items in blocks, and each block gives every query's n best.
    """
    tier = F.col("source_tier")
    factor = F.coalesce(*(F.when(tier == t, F.lit(f)) for t, f in TIER_FACTOR.items()), F.lit(1.0))
    rows = items.where("desc is not null").select("book_id", "desc", factor.alias("factor"), F.col("book_id").alias("owner"))
    return top_per(nearest(queries, rows, n), ["query_id"], [F.desc("score"), "book_id"], n).select("query_id", "rank", "book_id", "score")


def nearest(queries: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """query_id, book_id, score: n or more candidates of each query, its n best among them.

    queries(query_id, vec, exclude), rows(book_id, desc, factor, owner): rows
    whose owner a query excludes do not appear.
    """
    dims = rows.agg(F.max(F.size("desc"))).first()[0] or 0
    asked = queries.where("vec is not null").select("query_id", "vec", F.col("exclude").cast("array<bigint>").alias("exclude"))
    return kernels.meet(
        asked, "query_id", rows.select("book_id", "desc", "factor", "owner"), "book_id", kernels.blocks_of(rows, 8 * dims + 24),
        lambda t: (kernels.ids_of(t, "book_id"), kernels.vectors_of(t, "desc", dims), t.column("factor").to_numpy(), kernels.ids_of(t, "owner")), lambda b: kernels.nearest_of_block(b, dims, n),
    )


def similar_items(items: DataFrame, seeds: DataFrame, n: int) -> DataFrame:
    """similar_to_vectors for the description vectors of seeds(book_id); unknown seeds have no rows."""
    q = items.join(seeds.select("book_id").distinct(), "book_id", "left_semi")
    return similar_to_vectors(q.select(F.col("book_id").alias("query_id"), F.col("desc").alias("vec"), F.array("book_id").alias("exclude")), items, n)


def collapse_editions(ranked: DataFrame, meta: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The best ranked edition of each work, n a key, ranked anew; items without a title key all stay."""
    keyed = ranked.join(meta.select("book_id", T.work_key("title", "author").alias("_work")), "book_id", "left")
    work = F.coalesce("_work", F.concat(F.lit("#"), F.col("book_id").cast("string")))
    first = top_per(keyed.withColumn("_work", work), [*keys, "_work"], ["rank"], 1, "_first").drop("rank")
    return top_per(first, keys, [F.desc("score"), "book_id"], n).drop("_work", "_first")


def similar_works(items: DataFrame, seeds: DataFrame, n: int) -> DataFrame:
    """similar_items of other works: over-fetched, without editions of the seed, one edition of each work."""
    found = similar_items(items, seeds, 2 * n + 5)
    key = T.work_key("title", "author")
    keys = items.select("book_id", key.alias("_key"))
    found = found.join(keys, "book_id").join(keys.select(F.col("book_id").alias("query_id"), F.col("_key").alias("_seed")), "query_id")
    return collapse_editions(found.where(~F.coalesce(F.col("_key") == F.col("_seed"), F.lit(False))).drop("_key", "_seed"), items, ["query_id"], n)


def union_vector(items: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id, vec): the unit mean of the seeds' vectors of each query of seeds(query_id, book_id)."""
    mean = weighted_mean(seeds.join(items.select("book_id", "desc"), "book_id"), ["query_id"], "desc")
    return mean.select("query_id", unit("vec").alias("vec"))
