"""Work queues over the catalogue and shelves: who still needs a step, in which order.

Every queue is a filter, an anti join where something already exists, and a
total order; a limit, where given, is the batch that a worker takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# --- fixed values -----------------------------------------------------------
SCRAPE_SKIP = ["유아", "어린이", "만화"]
TIER2 = 2
# ----------------------------------------------------------------------------


def _some(c: str) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) > 0


def first(rows: DataFrame, by: list, limit: int | None) -> DataFrame:
    """The first rows in an order, numbered from 1; without a limit all."""
    if limit is None:
        from ..operators.ranking import positions

        return positions(rows, by, "place")
    top = rows.orderBy(*by).limit(limit)
    from pyspark.sql import Window

    # At most `limit` rows meet here.
    return top.withColumn("place", F.row_number().over(Window.orderBy(*by)))


def needs_scrape(books: DataFrame, limit: int | None = None, skip: list[str] = SCRAPE_SKIP) -> DataFrame:
    """Books with an ISBN and no rich text, without the skipped genres, best sold first (unsold last)."""
    blocked = F.lit(False)
    for g in skip:
        blocked = blocked | F.contains(F.coalesce("genre", F.lit("")), F.lit(g))
    return first(books.where(F.col("isbn").isNotNull() & (F.coalesce("rich_description", F.lit("")) == "") & ~blocked), [F.desc_nulls_last("sales_point"), "book_id"], limit)


def needs_loan_count(books: DataFrame, source: str, least: int | None = None) -> DataFrame:
    """Books with an ISBN whose count is from elsewhere or nowhere, and is at least `least` where that is given."""
    rows = books.where(F.col("isbn").isNotNull() & ~F.col("loan_count_source").eqNullSafe(F.lit(source)))
    return rows if least is None else rows.where(F.col("loan_count") >= least)


def needs_looks(books: DataFrame) -> DataFrame:
    """Books with a cover that lack colours or a font."""
    return books.where((F.coalesce("cover_url", F.lit("")) != "") & (F.col("dominant_colors").isNull() | F.col("spine_font").isNull()))


def needs_keywords(books: DataFrame, limit: int | None = None) -> DataFrame:
    return first(books.where(F.col("library_keywords").isNull() & F.col("isbn").isNotNull()), [F.desc_nulls_last("sales_point"), "book_id"], limit)


def needs_genre(books: DataFrame, limit: int | None = None) -> DataFrame:
    return first(books.where(F.col("genre").isNull() & F.col("isbn").isNotNull()), [F.desc_nulls_last("loan_count"), "book_id"], limit)


def needs_tier2(books: DataFrame, embedded: DataFrame, force: bool = False) -> DataFrame:
    """Books with rich text that lack a full embedding of embedded(book_id, tier, data_sources), or one that knows their keywords."""
    rich = books.where("rich_description is not null")
    if force:
        return rich
    known = embedded.where(F.col("tier") == TIER2).select("book_id", F.coalesce("data_sources", F.array().cast("array<string>")).alias("_sources"))
    rows = rich.join(known, "book_id", "left")
    stale = _some("library_keywords") & ~F.array_contains("_sources", F.lit("library_keywords"))
    return rows.where(F.col("_sources").isNull() | stale).drop("_sources")


def pending_vectors(books: DataFrame, existing: DataFrame, limit: int | None = None) -> DataFrame:
    """Books without a vector; those that have one go before the limit counts."""
    return first(books.join(existing.select("book_id"), "book_id", "left_anti"), ["book_id"], limit)


def pending_reasons(books: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """Books with rich text that were not processed, best sold first."""
    rich = books.where(F.coalesce("rich_description", F.lit("")) != "")
    return first(rich.join(done.select("book_id"), "book_id", "left_anti"), [F.desc_nulls_last("sales_point"), "book_id"], limit)


def provisional(books: DataFrame) -> DataFrame:
    return books.where("source_tier <> 'rich'")


def stale_counts(books: DataFrame, limit: int | None) -> DataFrame:
    """The longest not refreshed first, those never refreshed before all."""
    return first(books.where("isbn is not null"), [F.asc_nulls_first("updated_at"), "book_id"], limit)


def changed_since(rows: DataFrame, built_at: Column, column: str = "updated_at") -> DataFrame:
    """Rows written after an index was built; none means that it need not be built again. The filter reaches the scan."""
    return rows.where(F.col(column) > built_at)


def after_key(rows: DataFrame, key: str, last: object | None, page: int) -> DataFrame:
    """The next page of a scan by a unique key."""
    return (rows if last is None else rows.where(F.col(key) > last)).orderBy(key).limit(page)


def page(rows: DataFrame, by: list, offset: int, size: int, keep: Column | None = None) -> DataFrame:
    """A page of a filtered scan in a total order."""
    return (rows if keep is None else rows.where(keep)).orderBy(*by).offset(offset).limit(size)


def users_to_embed(shelf: DataFrame, index: DataFrame) -> DataFrame:
    """(user_id, needed): whether a rated book of a user is outside the index, or has feedback without a vector.

    shelf has emotion_tags, review_text and has_feedback_vector; rows without
    a rating never count.
    """
    rated = shelf.where("rating in ('good', 'bad')").join(index.select("book_id", F.lit(True).alias("_known")), "book_id", "left")
    told = _some("emotion_tags") | (F.coalesce("review_text", F.lit("")) != "")
    needed = F.col("_known").isNull() | (told & ~F.col("has_feedback_vector"))
    return shelf.select("user_id").distinct().join(rated.groupBy("user_id").agg(F.bool_or(needed).alias("needed")), "user_id", "left").select("user_id", F.coalesce("needed", F.lit(False)).alias("needed"))


def needs_feedback_vector(shelf: DataFrame) -> DataFrame:
    """Shelf rows whose tags or review make a text that has no vector yet."""
    return shelf.where(T.feedback_text("emotion_tags", "review_text").isNotNull() & ~F.col("has_feedback_vector"))


def unreviewed(shelf: DataFrame, books: DataFrame) -> DataFrame:
    """Finished books that are known and not rated."""
    return shelf.where("status = 'finished' and rating is null").join(books.select("book_id"), "book_id", "left_semi")


def reembed_plan(rows: DataFrame) -> DataFrame:
    """reembed, update_tier, new_tier of rows(stored_tier, stored_text, new_text, new_tier); a lost text changes nothing."""
    lost = (F.coalesce("new_text", F.lit("")) == "") | F.col("new_tier").isNull()
    return rows.withColumns({
        "reembed": ~lost & ~F.col("new_text").eqNullSafe(F.col("stored_text")),
        "update_tier": ~lost & ~F.col("new_tier").eqNullSafe(F.col("stored_tier")),
        "new_tier": F.when(lost, F.col("stored_tier")).otherwise(F.col("new_tier")),
    })
