"""User state and pair counts kept up to date from changes, without reading what did not change.

A change is (user_id, book_id) with the row before and the row after, either
of which may be missing. Counts follow from what is added and taken away:
with B the row before and D the difference, a pair of one user's books gains
D x B + B x D + D x D.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .activity import ACTIVE_DAYS, TIER_LIKES
from .collaborative import PAIR_BLOCK, pairs_within

_COUNTS = {"total_likes": "like", "total_saves": "save", "total_finished": "finish"}


def changes_between(before: DataFrame, after: DataFrame) -> DataFrame:
    """user_id, book_id, old, new of the shelf rows that differ; old and new are structs (rating, status, updated_at) or null."""
    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("user_id", "book_id", F.struct("rating", "status", "updated_at").alias(name))

    both = side(before, "old").join(side(after, "new"), ["user_id", "book_id"], "full")
    return both.where(~F.col("old").eqNullSafe(F.col("new")))


def _flag(side: str, flag: str) -> Column:
    column, value = {"like": ("rating", "good"), "save": ("status", "wishlist"), "finish": ("status", "finished")}[flag]
    return F.coalesce((F.col(f"{side}.{column}") == value).cast("int"), F.lit(0))


def shelf_after(shelf: DataFrame, changes: DataFrame) -> DataFrame:
    """The shelf(user_id, book_id, rating, status, updated_at) with the changes made."""
    kept = shelf.join(changes.select("user_id", "book_id"), ["user_id", "book_id"], "left_anti")
    return kept.select("user_id", "book_id", "rating", "status", "updated_at").unionByName(changes.where("new is not null").select("user_id", "book_id", "new.rating", "new.status", "new.updated_at"))


def refresh_counters(counters: DataFrame, changes: DataFrame, shelf: DataFrame) -> DataFrame:
    """counters(user_id, total_likes, total_saves, total_finished, n_rows, last_active_at) brought up to the changes.

    `shelf` is the shelf after the changes. Only users whose latest row went
    away have their rows read again, for the date; a user without rows goes.
    Counters may be empty, and then the changes are the whole shelf.
    """
    delta = changes.groupBy("user_id").agg(
        *(F.sum(_flag("new", f) - _flag("old", f)).alias(f"_{c}") for c, f in _COUNTS.items()),
        F.sum(F.col("new").isNotNull().cast("int") - F.col("old").isNotNull().cast("int")).alias("_n_rows"),
        F.max("old.updated_at").alias("_gone"), F.max("new.updated_at").alias("_come"),
    )
    both = counters.join(delta, "user_id", "full")
    both = both.select(
        "user_id", *((F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in (*_COUNTS, "n_rows")), F.greatest("last_active_at", "_come").alias("last_active_at"),
        F.coalesce((F.col("_gone") >= F.col("last_active_at")) & ~F.coalesce(F.col("_come") >= F.col("_gone"), F.lit(False)), F.lit(False)).alias("_again"),
    ).where("n_rows > 0")
    again = both.where("_again").select("user_id")
    latest = shelf.join(again, "user_id", "left_semi").groupBy("user_id").agg(F.max("updated_at").alias("_latest"))
    return both.join(latest, "user_id", "left").withColumn("last_active_at", F.when(F.col("_again"), F.col("_latest")).otherwise(F.col("last_active_at"))).drop("_again", "_latest")


def state_of(counters: DataFrame, as_of: Column) -> DataFrame:
    """User state from counters: with tier and active flag, as `activity.user_state` gives it from the shelf."""
    likes = F.col("total_likes")
    return counters.select(
        "user_id", *_COUNTS, "last_active_at", F.when(likes >= TIER_LIKES[1], 2).when(likes >= TIER_LIKES[0], 1).otherwise(0).alias("tier"),
        (F.col("last_active_at") >= as_of - F.expr(f"interval {ACTIVE_DAYS} days")).alias("is_active"),
    )


def pair_changes(shelf: DataFrame, changes: DataFrame, block_rows: int = PAIR_BLOCK) -> DataFrame:
    """a, b, co_like, co_save: by how much the counts of pairs change; `shelf` is the shelf before the changes.

    Only shelves of users with changes are read. A long shelf is dealt to
    blocks, each of which meets the user's changes.
    """
    moved = changes.select("user_id", "book_id", (_flag("new", "like") - _flag("old", "like")).alias("like"), (_flag("new", "save") - _flag("old", "save")).alias("save")).where("like <> 0 or save <> 0")
    held = shelf.join(moved.select("user_id").distinct(), "user_id", "left_semi").where("rating = 'good' or status = 'wishlist'")
    held = held.select("user_id", "book_id", F.coalesce(F.expr("int(rating = 'good')"), F.lit(0)).alias("like"), F.coalesce(F.expr("int(status = 'wishlist')"), F.lit(0)).alias("save"))
    blocks = held.groupBy("user_id").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_n"))
    dealt = held.join(blocks, "user_id").select("user_id", F.pmod(F.xxhash64("book_id"), F.col("_n")).cast("int").alias("_block"), F.struct("book_id", "like", "save").alias("y"))
    sent = moved.join(blocks, "user_id").select("user_id", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_block"), F.struct("book_id", "like", "save").alias("x"))
    across = sent.join(dealt, ["user_id", "_block"]).where("x.book_id <> y.book_id").select("x", "y")
    within = pairs_within(moved, "user_id", "book_id", block_rows).select(*(F.struct(f"{v}.book_id", f"{v}.like", f"{v}.save").alias(v) for v in ("x", "y")))
    every = across.unionByName(within)
    return every.groupBy(F.least("x.book_id", "y.book_id").alias("a"), F.greatest("x.book_id", "y.book_id").alias("b")).agg(
        F.sum(F.col("x.like") * F.col("y.like")).alias("co_like"), F.sum(F.col("x.save") * F.col("y.save")).alias("co_save")
    ).where("co_like <> 0 or co_save <> 0")


def refresh_pairs(pairs: DataFrame, shelf: DataFrame, changes: DataFrame, block_rows: int = PAIR_BLOCK) -> DataFrame:
    """pairs(a, b, co_like, co_save), all that are not zero, brought up to the changes; `shelf` is the shelf before them."""
    delta = pair_changes(shelf, changes, block_rows)
    both = pairs.unionByName(delta).groupBy("a", "b").agg(F.sum("co_like").alias("co_like"), F.sum("co_save").alias("co_save"))
    return both.where("co_like <> 0 or co_save <> 0")


def frequent_pairs(pairs: DataFrame, least: int) -> DataFrame:
    """The pairs that `least` users like, or save, both; as `activity.co_occurrence` gives them from the shelf."""
    return pairs.where((F.col("co_like") >= least) | (F.col("co_save") >= least))
