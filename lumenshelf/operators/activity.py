"""User state, taste counters, co-occurrence, click rates, popularity and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .blocks import top_per
from .collaborative import pairs_within

# --- fixed values -----------------------------------------------------------
TIER_LIKES = (3, 6)
ACTIVE_DAYS = 30
TOP_AUTHORS, TOP_L1S = 5, 3
LEAST_PAIRS = 3
# ----------------------------------------------------------------------------


def user_state(shelf: DataFrame, as_of) -> DataFrame:
    """Counters, last activity, tier and active flag of each user of the shelf; as_of is a column."""
    likes = F.count_if(F.col("rating") == "good")
    return shelf.groupBy("user_id").agg(
        likes.alias("total_likes"),
        F.count_if(F.col("status") == "wishlist").alias("total_saves"),
        F.count_if(F.col("status") == "finished").alias("total_finished"),
        F.max("updated_at").alias("last_active_at"),
        F.when(likes >= TIER_LIKES[1], 2).when(likes >= TIER_LIKES[0], 1).otherwise(0).alias("tier"),
        (F.max("updated_at") >= as_of - F.expr(f"interval {ACTIVE_DAYS} days")).alias("is_active"),
    )


def top_taste(shelf: DataFrame, items: DataFrame, what: str, n: int) -> DataFrame:
    """user_id, rank, key, n of the most frequent authors or genres among a user's liked books."""
    key = T.primary_author("author") if what == "author" else F.col("l1")
    liked = shelf.where("rating = 'good'").join(items, "book_id").select("user_id", key.alias("key")).where("key is not null")
    return top_per(liked.groupBy("user_id", "key").agg(F.count("*").alias("n")), ["user_id"], [F.desc("n"), "key"], n)


def co_occurrence(shelf: DataFrame, least: int = LEAST_PAIRS) -> DataFrame:
    """a, b, co_like, co_save of books that `least` users like, or save, both.

    A user's shelf is dealt to pairs of blocks, so that one of any length
    spreads over all tasks. A book that less than `least` users like, and less
    save, is in no pair and left out first.
    """
    like, save = F.col("rating") == "good", F.col("status") == "wishlist"
    s = shelf.where(like | save).select("user_id", "book_id", F.coalesce(like, F.lit(False)).alias("like"), F.coalesce(save, F.lit(False)).alias("save"))
    enough = s.groupBy("book_id").agg(F.count_if("like").alias("likes"), F.count_if("save").alias("saves")).where(F.greatest("likes", "saves") >= least)
    found = pairs_within(s.join(enough, "book_id", "left_semi"), "user_id", "book_id").groupBy(F.col("x.book_id").alias("a"), F.col("y.book_id").alias("b")).agg(
        F.count_if(F.col("x.like") & F.col("y.like")).alias("co_like"), F.count_if(F.col("x.save") & F.col("y.save")).alias("co_save")
    )
    return found.where((F.col("co_like") >= least) | (F.col("co_save") >= least))


def click_rate(impressions: DataFrame, keys: list[str]) -> DataFrame:
    return impressions.groupBy(*keys).agg(
        F.count("*").alias("shown"), F.count_if(F.col("action").isin("clicked", "liked")).alias("hits"), (F.count_if(F.col("action").isin("clicked", "liked")) / F.count("*")).alias("ctr")
    )


def popular(items: DataFrame, library: int = 20, store: int = 10) -> DataFrame:
    """rank, book_id: the most borrowed titles, then the best sold of those not among them; one edition a title."""
    def best(column: str, rows: DataFrame) -> DataFrame:
        one = top_per(rows.where(F.col(column).isNotNull()), ["title"], [F.desc(column), "book_id"], 1, "_e")
        return one.select("book_id", "title", F.col(column).alias("value"))

    first = best("loan_count_12mo", items).orderBy(F.desc("value"), "book_id").limit(library)
    rest = best("sales_point", items).join(first.select("title"), "title", "left_anti").orderBy(F.desc("value"), "book_id").limit(store)
    both = first.withColumn("priority", F.lit(1)).unionByName(rest.withColumn("priority", F.lit(2)))
    # At most library + store rows meet here.
    return both.select("book_id", F.row_number().over(Window.orderBy("priority", F.desc("value"), "book_id")).alias("rank"))


def top_reasons(reasons: DataFrame) -> DataFrame:
    """The most mentioned reason of each book, the first of equals."""
    return top_per(reasons.where(F.trim("reason") != ""), ["book_id"], [F.desc("user_mention_count"), "reason_pos"], 1, "_r").select("book_id", "reason")


def transitions(events: DataFrame) -> DataFrame:
    """Changes of a (user, book) pair's state(user_id, book_id, state, at, event_id), nulls told apart."""
    w = Window.partitionBy("user_id", "book_id").orderBy("at", "event_id")
    rows = events.withColumns({"old": F.lag("state").over(w), "first": F.row_number().over(w) == 1})
    return rows.where(~F.col("first") & ~F.col("old").eqNullSafe(F.col("state"))).select("user_id", "book_id", "event_id", "old", F.col("state").alias("new"))
