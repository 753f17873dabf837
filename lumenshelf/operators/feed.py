"""The home feed: sections by tier, theme choice, assembly without repeats, and what was shown.

Candidates of all slots are ranked at once, as many as the slots before can take
away; what repeats is then resolved in one pass over each user's short lists.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import against_all, top_per
from .catalogue import uniform
from .ranking import positions
from .saved import saved

# --- fixed values -----------------------------------------------------------
TEMPLATES = {
    0: [("trending", None), ("curation", "general"), ("curation", "general"), ("category_nav", None)],
    1: [("similar", None), ("curation", "by_author"), ("curation", "by_l1"), ("curation", "general"), ("category_nav", None)],
    2: [("personal_recommend", None), ("curation", "by_author"), ("similar", None), ("curation", "tier2+"), ("trending", None)],
}
SLOT_BOOKS = 10
RECENT_DAYS = 7
CLICKED_RATE, CLICKED_SHOWN, CLICKED_FACTOR, PERSONAL_FACTOR = 0.05, 20, 1.5, 2.0
LEAST_WEIGHT = 1e-6
FALLS_BACK = ["by_author", "by_l1", "tier2+"]
# ----------------------------------------------------------------------------


def templates(spark: SparkSession) -> DataFrame:
    """(tier, slot, type, personalization) of every section."""
    return spark.createDataFrame([(t, k, kind, who) for t, slots in TEMPLATES.items() for k, (kind, who) in enumerate(slots)], "tier int, slot int, type string, personalization string")


def fitting(users: DataFrame, themes: DataFrame) -> DataFrame:
    """(user_id, theme columns): themes that a user of users(user_id, tier, top_authors, top_l1s) may see; keyword themes never match.

    Themes of an author or a genre are joined by it. Those for everybody of a
    tier meet all users, in counted blocks.
    """
    p = F.col("personalization")
    least = F.when(p == "general", 0).when(p == "tier1+", 1).when(p == "tier2+", 2)
    columns = [*users.columns, *themes.columns]
    common = against_all(users, themes.where(least.isNotNull()), "id").where(F.col("tier") >= least).select(columns)
    out = common
    for kind, likes, target in (("by_author", "top_authors", "target_author"), ("by_l1", "top_l1s", "target_l1")):
        liking = users.withColumn("_key", F.explode(F.array_distinct(likes)))
        own = liking.join(themes.where(p == kind).withColumn("_key", F.col(target)), "_key").select(columns)
        out = out.unionByName(own)
    return out


def not_recent(pool: DataFrame, history: DataFrame, now: Column, days: int = RECENT_DAYS) -> DataFrame:
    """pool(user_id, id) without themes shown to the user in the last days."""
    return pool.join(history.where(F.col("shown_at") >= now - F.expr(f"interval {days} days")).select("user_id", F.col("curation_id").alias("id")).distinct(), ["user_id", "id"], "left_anti")


def fitting_counts(users: DataFrame, themes: DataFrame, history: DataFrame, now: Column, days: int = RECENT_DAYS) -> DataFrame:
    """(user_id, personalization, n): how many of the fitting themes were not shown to the user in the last days.

    The counts of not_recent(fitting(...)), without a row for each user and
    theme: themes are counted by tier, author and genre, and of what was shown
    to a user that is taken away which would fit.
    """
    p = F.col("personalization")
    least = F.when(p == "general", 0).when(p == "tier1+", 1).when(p == "tier2+", 2)
    common = themes.where(least.isNotNull()).groupBy("personalization").agg(F.count("*").alias("n"), F.first(least).alias("_least"))
    # One row a kind that goes by tier.
    every = users.join(F.broadcast(common), F.col("tier") >= F.col("_least")).select("user_id", "personalization", "n")
    fits = F.col("tier") >= least
    for kind, likes, target in (("by_author", "top_authors", "target_author"), ("by_l1", "top_l1s", "target_l1")):
        by = themes.where(p == kind).groupBy(F.col(target).alias("_key")).agg(F.count("*").alias("n"))
        own = users.select("user_id", F.explode(F.array_distinct(likes)).alias("_key")).join(by, "_key").select("user_id", F.lit(kind).alias("personalization"), "n")
        every, fits = every.unionByName(own), F.coalesce(fits, F.lit(False)) | F.coalesce((p == kind) & F.array_contains(likes, F.col(target)), F.lit(False))
    shown = history.where(F.col("shown_at") >= now - F.expr(f"interval {days} days")).select("user_id", F.col("curation_id").alias("id")).distinct()
    gone = shown.join(themes, "id").join(users, "user_id").where(fits).select("user_id", "personalization", F.lit(-1).cast("long").alias("n"))
    return every.unionByName(gone).groupBy("user_id", "personalization").agg(F.sum("n").alias("n")).where("n > 0")


def theme_weight() -> Column:
    w = F.coalesce("priority", F.lit(1.0))
    w = w * F.when((F.coalesce("click_rate", F.lit(0.0)) > CLICKED_RATE) & (F.coalesce("shown_count", F.lit(0)) >= CLICKED_SHOWN), CLICKED_FACTOR).otherwise(1.0)
    w = w * F.when(F.col("personalization").isin("by_l1", "by_author", "by_keyword"), PERSONAL_FACTOR).otherwise(1.0)
    return F.greatest(w, F.lit(LEAST_WEIGHT))


def renderable(ranked: DataFrame, books: DataFrame) -> DataFrame:
    """Rows of known books with a cover."""
    return ranked.join(books.where(F.coalesce("cover_url", F.lit("")) != "").select("book_id"), "book_id", "left_semi")


def latest_liked(shelf: DataFrame) -> DataFrame:
    return shelf.where("rating = 'good'").groupBy("user_id").agg(F.max_by("book_id", F.struct("updated_at", -F.col("book_id"))).alias("seed_id"))


def filled(ranked: DataFrame, seen: DataFrame, books: DataFrame, n: int = SLOT_BOOKS) -> DataFrame:
    """user_id, rank, book_id: the first n renderable rows of ranked(user_id, rank, book_id) that no earlier slot holds."""
    fresh = renderable(ranked, books).join(seen, ["user_id", "book_id"], "left_anti").withColumnRenamed("rank", "_was")
    return top_per(fresh, ["user_id"], ["_was", "book_id"], n).select("user_id", "rank", "book_id")


def filled_from_one(users: DataFrame, listed: DataFrame, seen: DataFrame, books: DataFrame, n: int = SLOT_BOOKS) -> DataFrame:
    """filled, where all of users(user_id) have the same list listed(rank, book_id).

    The list's renderable rows are numbered once. A user's first n open places
    are among the first n and as many more as the user has seen, so places are
    what a user's row holds, and no row for each user and book is made.
    """
    order = saved(positions(renderable(listed, books), [F.col("rank"), F.col("book_id")], "_place").select("_place", "book_id"))
    own = seen.select("user_id", "book_id").distinct().join(order, "book_id").groupBy("user_id").agg(F.collect_set("_place").alias("_own"))
    mine = users.select("user_id").distinct().join(own, "user_id", "left").withColumn("_own", F.coalesce("_own", F.array().cast("array<int>")))
    open_ = F.slice(F.array_except(F.sequence(F.lit(1), F.size("_own") + n), "_own"), 1, n)
    return mine.select("user_id", F.posexplode(open_).alias("_k", "_place")).join(order, "_place").select("user_id", (F.col("_k") + 1).alias("rank"), "book_id")


def assemble(
    users: DataFrame, personal: DataFrame, similar: DataFrame, trending: DataFrame, themes: DataFrame, lists: DataFrame, history: DataFrame, books: DataFrame, now: Column, seed: str
) -> DataFrame:
    """user_id, slot, type, curation_id, rank, book_id of each user's feed; sections without books, but for the navigation, are left out.

    users(user_id, tier, top_authors, top_l1s, has_seed); personal and similar
    are ranked lists (user_id, rank, book_id) of whole works; trending(rank,
    book_id) is one list, drawn anew for each user by falling weight;
    lists(id, rank, book_id) are the themes' books. A book appears once in a
    feed, in the first slot that wants it, and a theme too. Slots without a
    fitting theme fall back on general ones.
    """
    slots = templates(users.sparkSession)
    most = max(map(len, TEMPLATES.values()))
    # The slots before can take away so many books and themes at most.
    enough, choices = most * SLOT_BOOKS, most
    users, covered = saved(users), saved(books.where(F.coalesce("cover_url", F.lit("")) != "").select("book_id"))

    def listed(ranked: DataFrame, key: str) -> DataFrame:
        """(key, books): the first books with a cover, in order."""
        first = top_per(ranked.join(covered, "book_id", "left_semi"), [key], ["rank", "book_id"], enough, "_at")
        return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "book_id"))), lambda x: x["book_id"]).alias("books"))

    mine = users.join(F.broadcast(slots.withColumnRenamed("personalization", "_who")), "tier").select("user_id", "slot", "type", "has_seed", "_who")
    themed = mine.where((F.col("type") == "curation") | ((F.col("type") == "similar") & ~F.col("has_seed"))).withColumn("_who", F.coalesce("_who", F.lit("general")))
    of_theme = listed(lists, "id")
    ready = themes.where("is_active").join(lists.select("id").distinct(), "id", "left_semi")
    fit = not_recent(fitting(users.select("user_id", "tier", "top_authors", "top_l1s"), ready), history, now).drop("tier", "top_authors", "top_l1s")
    own = F.col("personalization") == F.col("_who")
    pool = themed.join(fit, "user_id").where(own | (F.col("_who").isin(FALLS_BACK) & (F.col("personalization") == "general"))).withColumn("_rest", (~own).cast("int"))
    key = F.log(uniform(F.lit(seed), F.col("slot"), "user_id", "id")) / theme_weight()
    drawn = top_per(pool.withColumn("_key", key), ["user_id", "slot", "_rest"], [F.desc("_key"), "id"], choices, "_k")
    drawn = drawn.join(of_theme, "id", "left").select("user_id", "slot", F.lit("curation").alias("type"), "id", (F.col("_rest") * choices + F.col("_k")).alias("place"), F.coalesce("books", F.array().cast("array<bigint>")).alias("books"))
    n = trending.count()
    # Falling linear weights: of n books the first weighs n, the last 1.
    shuffled = against_all(mine.where("type = 'trending'").select("user_id").distinct(), trending.withColumnRenamed("rank", "_r"), "book_id")
    by_weight = F.log(uniform(F.lit(seed), F.lit("trending"), "user_id", "book_id")) / F.greatest(F.lit(n + 1) - F.col("_r"), F.lit(1))
    shuffled = top_per(shuffled.withColumn("_key", by_weight), ["user_id"], [F.desc("_key"), "book_id"], n).select("user_id", "rank", "book_id")
    ranked = None
    for kind, rows in (("personal_recommend", personal), ("similar", similar), ("trending", shuffled)):
        who = mine.where((F.col("type") == kind) & (F.col("has_seed") if kind == "similar" else F.lit(True))).select("user_id", "slot", "type")
        one = who.join(listed(rows, "user_id"), "user_id").select("user_id", "slot", "type", F.lit(None).cast("long").alias("id"), F.lit(0).alias("place"), "books")
        ranked = one if ranked is None else ranked.unionByName(one)
    nav = mine.where("type = 'category_nav'").select("user_id", "slot", "type", F.lit(None).cast("long").alias("id"), F.lit(0).alias("place"), F.array().cast("array<bigint>").alias("books"))
    return drawn.unionByName(ranked).unionByName(nav).groupBy("user_id").applyInPandas(_resolved, "user_id long, slot int, type string, curation_id long, rank int, book_id long")


def _resolved(pdf: pd.DataFrame) -> pd.DataFrame:
    """One user's feed: slot after slot the first books, and of themes the first, that no earlier slot shows."""
    out, seen, picked = [], set(), set()
    user = pdf["user_id"].iloc[0]
    rows = sorted(zip(pdf["slot"], pdf["type"] == "curation", pdf["place"], pdf["type"], pdf["id"], pdf["books"]), key=lambda r: r[:3])
    drawn = set()
    for slot, themed, _, kind, theme, books in rows:
        if kind == "category_nav":
            out.append((user, slot, kind, None, None, None))
            continue
        if themed:
            if slot in drawn or int(theme) in picked:
                continue
            drawn.add(slot)
        fresh = [int(b) for b in books if int(b) not in seen][:SLOT_BOOKS]
        seen.update(fresh)
        if themed and fresh:
            picked.add(int(theme))
        out += [(user, slot, kind, int(theme) if themed else None, k + 1, b) for k, b in enumerate(fresh)]
    frame = pd.DataFrame(out, columns=["user_id", "slot", "type", "curation_id", "rank", "book_id"])
    return frame.astype({"curation_id": "Int64", "rank": "Int32", "book_id": "Int64"})


def impressions_of(feed: DataFrame, now: Column, version: str) -> tuple[DataFrame, DataFrame]:
    """Rows to append: (user_id, book_id, position, source, algorithm_version, shown_at), and (user_id, curation_id, shown_at)."""
    books = feed.where("book_id is not null").select("user_id", "book_id", (F.col("rank") - 1).alias("position"), F.col("type").alias("source"), F.lit(version).alias("algorithm_version"), now.alias("shown_at"))
    themes = feed.where("curation_id is not null").select("user_id", "curation_id").distinct().withColumn("shown_at", now)
    return books, themes


def attributed(impressions: DataFrame, actions: DataFrame) -> DataFrame:
    """impressions with the action of actions(user_id, book_id, action) on the newest row of the pair that has none."""
    open_ = top_per(impressions.where("action is null"), ["user_id", "book_id"], [F.desc("shown_at"), F.desc("event_id")], 1, "_k")
    hit = open_.join(actions.withColumnRenamed("action", "_new"), ["user_id", "book_id"]).select("event_id", "_new")
    return impressions.join(hit, "event_id", "left").withColumn("action", F.coalesce("action", "_new")).drop("_new")


def client_view(feed: DataFrame, hidden: DataFrame) -> DataFrame:
    """Curation and trending rows of a feed without the books that a user hides."""
    return feed.where("type in ('curation', 'trending') and book_id is not null").join(hidden.select("user_id", "book_id"), ["user_id", "book_id"], "left_anti")


def hour_bucket(at: Column | str) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH")


def feed_hash(updated_at: Column | str, at: Column | str) -> Column:
    """Key of a cached feed: it changes with the user's state and the hour."""
    return F.sha2(F.concat_ws("|", F.coalesce(F.date_format(updated_at, "yyyy-MM-dd HH:mm:ss"), F.lit("")), hour_bucket(at)), 256)


def age_seconds(at: Column | str, now: Column) -> Column:
    """Seconds since a time given as text; infinite where it is none."""
    return F.coalesce((F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp(at))).cast("double"), F.lit(float("inf")))

