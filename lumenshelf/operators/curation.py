"""Curation: generation, ageing and paging of themes, stages, confidence, and checks of what was written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# --- fixed values -----------------------------------------------------------
#: Parts of reasons that say nothing of a book, and names of categories.
GENERIC_PHRASES = ["재밌", "감동적", "좋은 책", "읽어볼 만", "추천", "괜찮", "잘 읽힌", "흥미롭", "인상적", "소장 가치", "몰입감", "흡입력", "정점", "걸작", "수작", "명작"]
META_CATEGORIES = ["국내도서", "해외도서", "소설", "에세이", "인문학", "교양 인문학", "만화", "라이트노벨", "명사에세이", "방송연예인에세이", "자기계발", "경제경영", "과학", "사회과학"]
LEAST_BOOKS = {"genre_combo": 10, "author": 3, "keyword": 5}
UNSHOWN_DAYS, LOW_DAYS, LOW_SHOWN, LOW_RATE = 30, 90, 100, 0.005
RETENTION_DAYS, STAGE_DAYS = 30, 7
GENRE_CAP = 4
DEPTHS = (5, 4, 3, 2, 1)
FAVOURITE = 1.2
UNREFINED = " 관련 책들"
TITLE_LENGTH = (4, 30)
# ----------------------------------------------------------------------------


def new_themes(books: DataFrame, existing: DataFrame, least: dict[str, int] = LEAST_BOOKS) -> DataFrame:
    """theme_key, theme_type, title, description, personalization, n of themes that enough books make and existing(theme_key) lacks."""
    l1, l2 = T.split_genre("genre")
    genre = books.select(l1.alias("a"), l2.alias("b")).where("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least["genre_combo"])
    author = books.select(T.primary_author("author").alias("a")).where("a is not null").groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= least["author"])
    word = books.select(F.explode("library_keywords").alias("a")).groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= least["keyword"])

    def theme(rows: DataFrame, kind: str, key: Column, title: Column, description: Column, who: str) -> DataFrame:
        return rows.select(F.concat(F.lit(f"{kind}|"), key).alias("theme_key"), F.lit(kind).alias("theme_type"), title.alias("title"), description.alias("description"), F.lit(who).alias("personalization"), "n")

    a, b = F.col("a"), F.col("b")
    found = (
        theme(genre, "genre_combo", F.concat_ws("|", a, b), F.concat_ws(" · ", a, b), F.concat(a, F.lit(" 중 "), b, F.lit(" 분류의 책들")), "general")
        .unionByName(theme(author, "author", a, F.concat(a, F.lit(" 컬렉션")), F.concat(a, F.lit(" 작가의 책들")), "by_author"))
        .unionByName(theme(word, "keyword", a, a, F.concat(a, F.lit(UNREFINED)), "general"))
    )
    return found.join(existing.select("theme_key"), "theme_key", "left_anti")


def retire_themes(themes: DataFrame, today: Column) -> DataFrame:
    """themes with is_active false where never shown for a month, or hardly clicked in a quarter."""
    unshown = (F.col("shown_count") == 0) & (F.col("created_at") < F.date_sub(today, UNSHOWN_DAYS))
    rate = F.when(F.col("shown_count") > 0, F.col("click_count") / F.col("shown_count")).otherwise(F.lit(0.0))
    low = (F.col("shown_count") >= LOW_SHOWN) & (rate < LOW_RATE) & (F.col("created_at") < F.date_sub(today, LOW_DAYS))
    return themes.withColumn("is_active", F.col("is_active") & ~unshown & ~low)


def retained(rows: DataFrame, at: str, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows of the last `days` days; with a table partitioned by day the rest is never read."""
    return rows.where(F.col(at) >= now - F.expr(f"interval {days} days"))


def next_stage(state: DataFrame, user_state: DataFrame, pairs: DataFrame, impressions: DataFrame, now: Column) -> DataFrame:
    """state(stage, entered_at, thresholds, pre_ctr) with next_stage, reason, and the rates before and after.

    thresholds is JSON such as {"stage1": {"users": 10, "pairs": 5},
    "min_exposure": 100, "rollback_threshold": -0.2}. A stage is left upwards
    after a week if enough users are active and enough pairs are liked
    together, downwards if the rate has fallen by the threshold.
    """
    def limit(path: Column) -> Column:
        return F.call_function("get_json_object", F.col("thresholds"), path).cast("int")

    users = user_state.agg(F.count_if("is_active").alias("users"))
    liked = pairs.agg(F.count_if(F.col("co_like") >= 3).alias("pairs"))
    # The state is one row.
    since = impressions.join(F.broadcast(state.select("entered_at")), F.col("shown_at") >= F.col("entered_at")).agg(
        F.count("*").alias("exposure"), F.when(F.count("*") > 0, F.count_if(F.col("action").isin("clicked", "liked", "saved")) / F.count("*")).alias("ctr")
    )
    # Four tables of one row each.
    one = state.crossJoin(users).crossJoin(liked).crossJoin(since)
    key = F.concat(F.lit("$.stage"), (F.col("stage") + 1).cast("string"))
    old = F.col("entered_at") < now - F.expr(f"interval {STAGE_DAYS} days")
    up = old & (F.col("users") >= limit(F.concat(key, F.lit(".users")))) & (F.col("pairs") >= limit(F.concat(key, F.lit(".pairs"))))
    down = old & (F.col("stage") > 0) & (F.col("pre_ctr") > 0) & (F.col("exposure") >= F.get_json_object("thresholds", "$.min_exposure").cast("int"))
    down = down & ((F.col("ctr") - F.col("pre_ctr")) / F.col("pre_ctr") < F.get_json_object("thresholds", "$.rollback_threshold").cast("double"))
    up, down = F.coalesce(up, F.lit(False)), F.coalesce(down, F.lit(False))
    return one.select(
        "stage", F.when(up, F.col("stage") + 1).when(down, F.col("stage") - 1).otherwise(F.col("stage")).alias("next_stage"), F.when(up, "auto_promote").when(down, "auto_rollback").alias("reason"),
        "users", "pairs", F.when(up, F.col("ctr")).when(down, F.lit(None)).otherwise(F.col("pre_ctr")).alias("pre_ctr"), F.when(down & ~up, F.col("ctr")).alias("post_ctr"),
    )


def depth() -> Column:
    """Feedback depth of a shelf row, 1 to 5."""
    tags = F.coalesce(F.size("emotion_tags"), F.lit(0))
    return F.when(F.length("review_text") >= 50, DEPTHS[0]).when(tags >= 3, DEPTHS[1]).when(tags >= 1, DEPTHS[2]).when(F.col("rating").isNotNull(), DEPTHS[3]).otherwise(DEPTHS[4])


def weight(favourite: Column | None = None) -> Column:
    """Weight of a shelf row in a taste vector; disliked books have none, a favourite some more."""
    w = F.when(F.length("review_text") >= 50, 3.0).when(F.coalesce(F.size("emotion_tags"), F.lit(0)) >= 1, 2.0).when(F.col("rating").isNotNull(), 1.5).otherwise(1.0)
    if favourite is not None:
        w = w * F.when(F.coalesce(favourite, F.lit(False)), FAVOURITE).otherwise(1.0)
    return F.when(F.col("rating") == "bad", 0.0).otherwise(w)


def confidence(shelf: DataFrame, books: DataFrame, status: str = "finished") -> DataFrame:
    """user_id, score, feedback_depth, book_count, genre_diversity, rating_variance of each user of the shelf."""
    s = shelf.join(books.select("book_id", "genre"), "book_id", "left")
    read = F.col("status") == status
    by = s.groupBy("user_id").agg(
        F.count_if(read).alias("book_count"), F.coalesce(F.sum(F.when(read, depth())), F.lit(0)).alias("feedback_depth"),
        F.countDistinct(F.when(read, F.col("genre"))).alias("_genres"), F.countDistinct("rating").alias("_ratings"),
    )
    diversity = F.when(F.col("book_count") >= 3, F.least(F.col("_genres") / GENRE_CAP, F.lit(1.0))).otherwise(0.0)
    variety = F.col("_ratings") / 3.0
    score = F.least(F.col("feedback_depth") / 25.0 * 0.4 + diversity * 0.3 + variety * 0.15 + F.least(F.col("book_count") / 10.0, F.lit(1.0)) * 0.15, F.lit(1.0))
    return by.select("user_id", F.round(score, 3).alias("score"), "feedback_depth", "book_count", F.round(diversity, 3).alias("genre_diversity"), F.round(variety, 3).alias("rating_variance"))


def unrefined() -> Column:
    """Whether a keyword theme still has its generated description."""
    word = F.coalesce("target_keyword", F.lit(""))
    return (word != "") & (F.coalesce("description", F.lit("")) == F.concat(word, F.lit(UNREFINED)))


def theme_actions(keywords: DataFrame, results: DataFrame, length: tuple[int, int] = TITLE_LENGTH) -> DataFrame:
    """keyword, action, title, description of keywords(keyword): kill, keep or missing, by results(keyword, verdict, title, description).

    A kept theme needs a title of fitting length and a description, else the
    keyword counts as missing; results nobody asked for are left out.
    """
    title, text = F.trim(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("description", F.lit("")))
    fine = F.length(title).between(*length) & (text != "")
    action = F.when(F.col("verdict") == "kill", "kill").when((F.col("verdict") == "keep") & fine, "keep").otherwise("missing")
    keep = F.col("action") == "keep"
    return keywords.join(results, "keyword", "left").withColumn("action", action).select("keyword", "action", F.when(keep, title).alias("title"), F.when(keep, text).alias("description"))


def theme_page(lists: DataFrame, books: DataFrame, offset: int, size: int) -> DataFrame:
    """curation_id, total, pos, book_id, title of a page of lists(curation_id, book_ids); books that are gone are left out after the cut."""
    cut = lists.select("curation_id", F.size("book_ids").alias("total"), F.posexplode(F.slice("book_ids", offset + 1, size)).alias("pos", "book_id"))
    return cut.join(books.select("book_id", "title"), "book_id").select("curation_id", "total", (F.col("pos") + offset).alias("pos"), "book_id", "title")


def status_counters(books: DataFrame, vectors: DataFrame, reasons: DataFrame, embedded: DataFrame) -> DataFrame:
    """One row of counts of each pipeline step."""
    b = books.agg(
        F.count("loan_count").alias("with_loan_count"), F.count_if(F.col("loan_count").isNotNull() & F.col("rich_description").isNull()).alias("missing_rich_description"),
        F.count("rich_description").alias("with_rich_description"),
    )
    r = reasons.agg(F.count("*").alias("with_reasons"), F.countDistinct("book_id").alias("with_reasons_distinct_books"))
    # Four tables of one row each.
    return b.crossJoin(vectors.agg(F.count("*").alias("with_v3_vectors"))).crossJoin(r).crossJoin(embedded.agg(F.count("*").alias("with_embeddings")))


def reason_checks(reasons: DataFrame, least_length: float = 15.0, most_short: float = 0.3, most_generic: float = 0.05, repeats: int = 3) -> DataFrame:
    """avg_length, short_ratio, generic_ratio, repeated and ok of all reasons."""
    generic = reduce(lambda a, b: a | b, (F.contains("reason", F.lit(w)) for w in T.GENERIC_REASON_WORDS))
    told = reasons.agg(F.avg(F.length("reason")).alias("avg_length"), F.avg((F.length("reason") < 15).cast("double")).alias("short_ratio"), F.avg(generic.cast("double")).alias("generic_ratio"))
    same = reasons.groupBy("reason").agg(F.count("*").alias("n")).where(F.col("n") >= repeats).agg(F.count("*").alias("repeated"))
    fine = (F.col("avg_length") >= least_length) & (F.col("short_ratio") <= most_short) & (F.col("generic_ratio") <= most_generic) & (F.col("repeated") == 0)
    return told.crossJoin(same).withColumn("ok", fine)


def verification(books: DataFrame, vectors: DataFrame, reasons: DataFrame, genres: DataFrame, dims: int) -> DataFrame:
    """(check, value, ok) of the tables that an index is built from."""
    rich = books.where("rich_description is not null").agg(F.count("*").alias("n"))
    v = vectors.agg(F.count("*").alias("n"), F.count_if(F.col("desc").isNull()).alias("nulls"), F.count_if(F.size("desc") != dims).alias("odd"), F.count_if(F.col("l1_genre_id").isNull()).alias("no_l1"))
    orphans = vectors.where("l1_genre_id is not null").join(genres.select(F.col("genre_id").alias("l1_genre_id")), "l1_genre_id", "left_anti").agg(F.count("*").alias("orphans"))
    few = reasons.groupBy("book_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") < 5).alias("few"), F.count("*").alias("told"))
    levels = genres.agg(F.count_if(F.col("level") == "l1").alias("l1"), F.count_if(F.col("level") == "l2").alias("l2"))
    one = v.crossJoin(rich.withColumnRenamed("n", "rich")).crossJoin(orphans).crossJoin(few).crossJoin(levels)
    rows = F.array(*(
        F.struct(F.lit(name).alias("check"), F.col(c).cast("long").alias("value"), ok.alias("ok"))
        for name, c, ok in [
            ("vectors of rich books", "n", F.col("n") >= F.col("rich") * 0.995), ("null vectors", "nulls", F.col("nulls") == 0), ("odd dimensions", "odd", F.col("odd") == 0), ("orphan genres", "orphans", F.col("orphans") == 0),
            ("books of few reasons", "few", F.col("few") <= 80), ("books with reasons", "told", F.col("told") > 0), ("first genres", "l1", F.col("l1").between(15, 30)), ("second genres", "l2", F.col("l2") >= 100),
        ]
    ))
    return one.select(F.explode(rows).alias("c")).select("c.*")


def distribution(shelf: DataFrame) -> DataFrame:
    """what, value, n: rows by status, and by rating."""
    a = shelf.groupBy(F.col("status").alias("value")).agg(F.count("*").alias("n")).withColumn("what", F.lit("status"))
    b = shelf.groupBy(F.coalesce("rating", F.lit("(none)")).alias("value")).agg(F.count("*").alias("n")).withColumn("what", F.lit("rating"))
    return a.unionByName(b)


def by_path(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.coalesce(column, F.lit("(none)")).alias("path")).agg(F.count("*").alias("n"))


def histogram(values: DataFrame, column: str, edges: tuple[float, ...] = (0.3, 0.5, 0.7, 0.9, 0.99), saturated: float = 0.99) -> DataFrame:
    """least, greatest, mean, counts below each edge and above the last, and the saturated share in percent."""
    x = F.col(column)
    bins = [F.count_if((x >= lo) & (x < hi)).alias(f"bin{k}") for k, (lo, hi) in enumerate(zip((0.0, *edges), (*edges, 1.001)))]
    return values.agg(F.min(x).alias("least"), F.max(x).alias("greatest"), F.avg(x).alias("mean"), *bins, (F.count_if(x >= saturated) / F.count("*") * 100).alias("saturation_pct"))


def shelf_summary(shelf: DataFrame, books: DataFrame) -> DataFrame:
    """Per user: books in all, by status, rated, and different first genres."""
    s = shelf.join(books.select("book_id", T.split_genre("genre")[0].alias("_l1")), "book_id", "left")
    return s.groupBy("user_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "finished").alias("finished"), F.count_if(F.col("status") == "wishlist").alias("wishlist"), F.count_if(F.col("rating").isNotNull()).alias("rated"), F.countDistinct("_l1").alias("genres")
    )


def author_groups(shelf: DataFrame, books: DataFrame, least: int = 2) -> DataFrame:
    """user_id, author, n of authors with several books on a shelf, the largest groups of a user first."""
    rows = shelf.join(books.select("book_id", T.primary_author("author").alias("author")), "book_id").where("author is not null")
    return rows.groupBy("user_id", "author").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("book_id")).alias("book_ids")).where(F.col("n") >= least)


def reason_filter(reasons: str, title: str) -> Column:
    """Reasons of 10 to 60 letters that are no part of the title; short ones without a generic word."""
    parts = F.split(F.coalesce(title, F.lit("")), r"\s*[-–—:]\s*")
    generic = lambda r: reduce(lambda a, b: a | b, (F.contains(r, F.lit(w)) for w in T.GENERIC_REASON_WORDS))
    trimmed = F.transform(reasons, lambda r: F.trim(r))
    return F.filter(trimmed, lambda r: F.length(r).between(10, 60) & ~F.array_contains(parts, r) & (r != F.coalesce(title, F.lit(""))) & ((F.length(r) >= 15) | ~generic(r)))


def phrase_filter(reasons: str, generic: list[str], meta: list[str], least: int = 4) -> Column:
    """Reasons that are phrases: no generic or meta words, questions, sentences, nominal endings, comparisons or long texts."""
    def fine(reason: Column) -> Column:
        r = F.trim(reason)
        bad = [
            F.length(r) < least, *(F.contains(r, F.lit(p)) for p in generic), r.isin(meta), F.rlike(r, F.lit(r"(\?|할까|인가)$")), F.rlike(r, F.lit(r"^.+(?:이다|한다|된다|있다|없다|했다|됐다|아니다)$")),
            (F.length(r) > 12) & F.rlike(r, F.lit(r"[을를의에서로].*[냄함임음줌짐김됨봄럼침]$")), F.length(r) > 25, F.contains(r, F.lit(" vs ")) | F.contains(r, F.lit(" VS ")),
        ]
        return ~reduce(lambda a, b: a | b, bad)

    return F.filter(reasons, fine)


def verified(reason: str, evidence: str, source: str, share: float = 0.4) -> Column:
    """Whether the evidence, or without one the reason, is in the source text, or enough of its words are."""
    clean = F.regexp_replace(F.coalesce(source, F.lit("")), r"<[^>]+>", "")
    told = F.when(F.coalesce(evidence, F.lit("")) != "", F.col(evidence)).otherwise(F.col(reason))
    words = F.filter(F.split(told, r"\s+"), lambda w: F.length(w) >= 2)
    found = F.size(F.filter(words, lambda w: F.contains(clean, w)))
    return F.coalesce(F.contains(clean, told) | F.when(F.size(words) > 0, found / F.size(words) >= share).otherwise(False), F.lit(False))


def attribute_profile(feedback: DataFrame) -> DataFrame:
    """(user_id, attr, score): weighted mean of feedback(user_id, attr, score, weight), nulls left out, two decimals."""
    rows = feedback.where("score is not null")
    return rows.groupBy("user_id", "attr").agg(F.round(F.round(F.sum(F.col("score") * F.col("weight")) / F.nullif(F.sum("weight"), F.lit(0)), 9), 2).alias("score"))


def attribute_match(profile: DataFrame, attrs: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(user_id, book_id) with match: the mean product over the attributes that profile and attrs(book_id, attr, score) share, else 0."""
    p, a = profile.select("user_id", "attr", F.col("score").alias("_p")), attrs.where("score is not null").select("book_id", "attr", F.col("score").alias("_a"))
    told = pairs.select("user_id", "book_id").distinct().join(p, "user_id").join(a, ["book_id", "attr"]).groupBy("user_id", "book_id").agg(F.avg(F.col("_p") * F.col("_a")).alias("_m"))
    return pairs.join(told, ["user_id", "book_id"], "left").withColumn("match", F.coalesce("_m", F.lit(0.0))).drop("_m")


def composite(metrics: DataFrame) -> DataFrame:
    """hypothesis, groups, composite: group means of cov, div, auth, t5, ad, mixed, then averaged over the groups."""
    value = F.col("cov") * 0.25 + F.col("div") * 0.2 + F.col("auth") * 0.2 + F.col("t5") * 0.2 + F.col("ad") * 0.15
    means = metrics.groupBy("hypothesis", "grp").agg(*(F.avg(c).alias(c) for c in ("cov", "div", "auth", "t5", "ad")))
    return means.groupBy("hypothesis").agg(F.count("*").alias("groups"), F.avg(value).alias("composite"))
