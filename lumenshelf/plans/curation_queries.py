"""Queries of curation, stages, confidence, quality reports and reason rules, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import activity, curation, ingest
from ..sources import views
from . import text_queries as X
from .literals import Derived, Literal

STAGES = Literal(
    "stages", "id int, stage int, thresholds string, pre_ctr double",
    [(1, 0, '{"stage1": {"users": 1, "pairs": 0}, "min_exposure": 10, "rollback_threshold": -0.2}', None), (2, 1, '{"stage2": {"users": 1000000, "pairs": 1}, "min_exposure": 10, "rollback_threshold": -0.2}', 0.9), (3, 2, '{"min_exposure": 10}', 0.5)],
)
#: Thresholds of stages as JSON, one a nation.
THRESHOLDS = Derived("nations", "nation", """select n_nationkey as id, case when n_nationkey % 5 = 0 then null when n_nationkey % 4 = 0 then '{{"min_exposure": 10}}'
  else concat('{{"stage1": {{"users": ', cast(n_nationkey * 10 as varchar(20)), ', "pairs": ', cast(n_regionkey as varchar(20)), '}}, "rollback_threshold": -0.', cast(n_nationkey % 9 + 1 as varchar(20)), '}}') end as thresholds from {source}""")
#: Reasons of every kind that the rules tell apart, made of the names of parts.
REASONS = Derived("reason_rows", "part", """select p_partkey as id, case p_partkey % 12 when 0 then concat(p_name, ' - 바다의 기억') when 1 then concat(p_name, ': 바다') when 5 then null else p_name end as title,
  case p_partkey % 12 when 0 then '바다의 기억' when 1 then concat(p_name, '의 기억이 오래 남는 이야기') when 2 then '성장하는 주인공 이야기' when 3 then '짧다' when 4 then concat('가난한 ', p_brand, ' 바다를 건너 살아남는다') when 5 then '이것은 정말 좋은 책일까?'
    when 6 then concat(split_part(p_name, ' ', 1), ' vs 현재의 대비') when 7 then concat(split_part(p_name, ' ', 2), '에서 혼자 사는 삶을 그려냄') when 8 then null when 9 then concat('몰입감 있는 ', split_part(p_name, ' ', 1)) when 10 then '소설' else concat(' ', p_name, ' ') end as reason,
  case p_partkey % 5 when 0 then '' when 1 then null when 2 then '바다의 기억' when 3 then concat(split_part(p_name, ' ', 1), ' 없는 말') else '전혀 아님' end as evidence,
  case p_partkey % 7 when 0 then null when 1 then concat('<b>바다</b>의 기억이 남는다 ', p_name) when 2 then p_name else concat('바다의 기억, ', p_brand, ' 바다를 건너 ', p_type) end as source
from {source}""")
#: Figures of a test run, one a line item.
METRICS = Derived("metrics", "lineitem", "select concat('H', cast(l_linenumber as varchar(20))) as hypothesis, l_returnflag as grp, cast(l_discount * 10 as double) as cov, cast(l_tax * 10 as double) as div, cast(l_quantity / 50 as double) as auth, cast(l_orderkey % 10 as double) / 10 as t5, cast(l_suppkey % 5 as double) / 5 as ad from {source}")


def _now(spark: SparkSession, sf_dir: str):
    """The newest event; one number goes over the driver."""
    return F.lit(views.events(spark, sf_dir).agg(F.max("ts")).first()[0])


def _today():
    return F.lit(views.TODAY).cast("date")


def _themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A theme a catalogue row: its counts follow from the row's own numbers."""
    b = views.books(spark, sf_dir)
    return b.select("book_id", F.lit(True).alias("is_active"), (F.col("book_id") % 150).alias("shown_count"), F.when(F.col("book_id") % 3 == 0, 0).otherwise(F.col("book_id") % 5).alias("click_count"), "created_at")


def ag11_new_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = spark.createDataFrame([("keyword|red",), ("author|Brand#12",), ("nothing",)], "theme_key string")
    return curation.new_themes(views.books(spark, sf_dir), old)


def cu2_retired_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.retire_themes(_themes(spark, sf_dir), _today()).select("book_id", "is_active")


def cu5_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = curation.retained(views.impressions(spark, sf_dir), "shown_at", _now(spark, sf_dir), 14)
    return kept.select("event_id", "user_id")


def cu6_next_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of three stages entered ten days ago."""
    now = _now(spark, sf_dir)
    shelf, seen = views.shelf(spark, sf_dir), views.impressions(spark, sf_dir)
    users, pairs = activity.user_state(shelf, now), activity.co_occurrence(shelf)
    out = None
    for row in STAGES.rows:
        s = spark.createDataFrame([row], STAGES.schema).withColumn("entered_at", now - F.expr("interval 10 days"))
        one = curation.next_stage(s, users, pairs, seen, now).withColumn("id", F.lit(row[0]))
        out = one if out is None else out.unionByName(one)
    return out.withColumns({"pre_ctr": F.round("pre_ctr", 6), "post_ctr": F.round("post_ctr", 6)})


def ag7_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.confidence(views.shelf(spark, sf_dir), views.items(spark, sf_dir))


def js1_confidence_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = curation.confidence(views.shelf(spark, sf_dir), views.items(spark, sf_dir))
    return c.select("user_id", F.to_json(F.struct("book_count", "feedback_depth")).alias("result"))


def js2_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("thresholds")
    return THRESHOLDS.frame(spark, sf_dir).select("id", F.get_json_object(t, "$.stage1.users").cast("int").alias("users"), F.get_json_object(t, "$.stage1").isNotNull().alias("has_stage1"), F.get_json_object(t, "$.rollback_threshold").cast("double").alias("rollback"))


def mt6_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.shelf(spark, sf_dir)
    return s.select("user_id", "book_id", curation.depth().alias("depth"), curation.weight(F.col("book_id") % 7 == 0).alias("weight"))


def ag14_recent_click_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = curation.retained(views.impressions(spark, sf_dir), "shown_at", _now(spark, sf_dir), 7)
    return activity.click_rate(recent, ["source"]).withColumn("ctr", F.round("ctr", 6))


def ag2_changed_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of the users whose shelf changed in the last two days only."""
    now = _now(spark, sf_dir)
    shelf = views.shelf(spark, sf_dir)
    changed = curation.retained(shelf, "updated_at", now, 2).select("user_id").distinct()
    return activity.user_state(shelf.join(changed, "user_id", "left_semi"), now)


def tk8_theme_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.books(spark, sf_dir).where("library_keywords is not null")
    lists = b.select(F.explode("library_keywords").alias("curation_id"), "book_id").groupBy("curation_id").agg(F.sort_array(F.collect_list("book_id")).alias("book_ids"))
    return curation.theme_page(lists, views.books(spark, sf_dir).where("book_id % 7 <> 0"), 5, 10)


def str30_theme_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords with an editor's verdict of each kind, and whether their description is the generated one."""
    b = views.books(spark, sf_dir).where("library_keywords is not null").select(F.explode("library_keywords").alias("keyword")).distinct()
    n = F.length("keyword")
    verdicts = b.where(n % 5 != 0).select("keyword", F.when(n % 3 == 0, "kill").when(n % 3 == 1, "keep").otherwise("?").alias("verdict"), F.concat("keyword", F.lit(" 모음")).alias("title"), F.when(n % 2 == 0, "").otherwise("d").alias("description"))
    acts = curation.theme_actions(b, verdicts)
    gate = b.select("keyword", F.col("keyword").alias("target_keyword"), F.concat("keyword", F.when(n % 2 == 0, curation.UNREFINED).otherwise("!")).alias("description")).select("keyword", curation.unrefined().alias("unrefined"))
    return acts.join(gate, "keyword")


def ag15_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.status_counters(views.books(spark, sf_dir), views.items(spark, sf_dir), views.item_reasons(spark, sf_dir), views.item_vectors(spark, sf_dir))


def ag23_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.distribution(views.shelf(spark, sf_dir))


def ag25_match_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.by_path(views.books(spark, sf_dir), "loan_count_source")


def ag24_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the items' similarity to the next item."""
    i = views.items(spark, sf_dir).select("book_id", "desc")
    from ..functions.vectors import dot

    pairs = i.join(i.select((F.col("book_id") - 1).alias("book_id"), F.col("desc").alias("other")), "book_id").select(F.round(dot("desc", "other"), 6).alias("x"))
    h = curation.histogram(pairs, "x")
    return h.withColumns({c: F.round(c, 5) for c in ("least", "greatest", "mean", "saturation_pct")})


def ag20_shelf_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.shelf_summary(views.shelf(spark, sf_dir), views.books(spark, sf_dir))


def ag19_author_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.author_groups(views.shelf(spark, sf_dir), views.books(spark, sf_dir)).withColumn("book_ids", F.array_join("book_ids", ","))


def ag26_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.composite(METRICS.frame(spark, sf_dir)).withColumn("composite", F.round("composite", 6))


def ag27_reason_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = curation.reason_checks(views.item_reasons(spark, sf_dir).select("reason").unionByName(REASONS.frame(spark, sf_dir).where("reason is not null").select("reason")))
    return c.withColumns({x: F.round(x, 6) for x in ("avg_length", "short_ratio", "generic_ratio")})


def ag28_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.genre_set(views.books(spark, sf_dir)).withColumn("genre_id", F.concat_ws(":", "level", "genre_text"))
    i = views.items(spark, sf_dir).select("book_id", "desc", F.when(F.col("book_id") % 9 != 0, F.concat(F.lit("l1:"), "l1")).alias("l1_genre_id"))
    return curation.verification(views.books(spark, sf_dir), i, views.item_reasons(spark, sf_dir), g, 64)


def _attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, attr, score): a few attributes of each item, some unknown."""
    i = views.items(spark, sf_dir).select("book_id", F.explode(F.array(*map(F.lit, ("plot", "world", "style")))).alias("attr"))
    return i.select("book_id", "attr", F.when((F.col("book_id") + F.length("attr")) % 4 != 0, ((F.col("book_id") * F.length("attr")) % 10) / 10.0).alias("score"))


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = views.shelf(spark, sf_dir).where("rating = 'good'").select("user_id", "book_id", (1 + F.col("book_id") % 3).cast("double").alias("weight"))
    return curation.attribute_profile(rated.join(_attrs(spark, sf_dir), "book_id"))


def ag17_attribute_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir)


def ag18_attribute_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = views.shelf(spark, sf_dir).where("status = 'wishlist'").select("user_id", "book_id")
    return curation.attribute_match(_profile(spark, sf_dir), _attrs(spark, sf_dir), pairs).withColumn("match", F.round("match", 6))


def flt16_reason_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = REASONS.frame(spark, sf_dir).groupBy(F.coalesce("title", F.lit("")).alias("t"), "title").agg(F.array_sort(F.collect_list("reason")).alias("reasons"))
    return r.select("t", F.array_join(curation.reason_filter("reasons", "title"), "|").alias("kept"))


def flt17_phrase_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = REASONS.frame(spark, sf_dir).where("reason is not null")
    return r.select("id", (F.size(curation.phrase_filter(F.array("reason"), curation.GENERIC_PHRASES, curation.META_CATEGORIES)) > 0).alias("kept"))


def flt18_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return REASONS.frame(spark, sf_dir).where("reason is not null").select("id", curation.verified("reason", "evidence", "source").alias("kept"))


def dt_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT1 to DT4, HS2: hour bucket, age, intervals, cluster version and the key of a cached feed."""
    from ..operators import feed

    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    e = views.events(spark, sf_dir)
    text = F.when(F.col("event_id") % 10 == 0, "never").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    age = feed.age_seconds(text, now)
    return e.select(
        "event_id", feed.hour_bucket("ts").alias("bucket"), F.when(age == float("inf"), F.lit(-1.0)).otherwise(age).alias("age"), (F.col("ts") >= now - F.expr("interval 7 days")).alias("recent"), (age < 180).alias("fresh"),
        F.date_format("ts", "'v'yyyyMM").alias("version"), feed.feed_hash("ts", "ts").alias("hash"),
    )


QUERIES = [
    ag11_new_themes, cu2_retired_themes, cu5_retained, cu6_next_stage, ag7_confidence, js1_confidence_json, js2_thresholds, mt6_depth, ag14_recent_click_rate, ag2_changed_users, tk8_theme_page, str30_theme_gates, ag15_status, ag23_distribution,
    ag25_match_paths, ag24_histogram, ag20_shelf_summary, ag19_author_groups, ag26_composite, ag27_reason_checks, ag28_verification, ag17_attribute_profile, ag18_attribute_match, flt16_reason_filter, flt17_phrase_filter, flt18_verified, dt_times,
]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


_DEPTH = "case when length(review_text) >= 50 then 5 when len(emotion_tags) >= 3 then 4 when len(emotion_tags) >= 1 then 3 when rating is not null then 2 else 1 end"
_STATE = """select user_id, count(*) filter (rating = 'good') as total_likes, count(*) filter (status = 'wishlist') as total_saves, count(*) filter (status = 'finished') as total_finished,
max(updated_at) as last_active_at, case when count(*) filter (rating = 'good') >= 6 then 2 when count(*) filter (rating = 'good') >= 3 then 1 else 0 end as tier,
max(updated_at) >= (select max(ts) from events) - interval 30 days as is_active from shelf"""
_CONFIDENCE = f"""conf as (
  select user_id, book_count, feedback_depth, case when book_count >= 3 then least(genres / 4, 1.0) else 0 end as div, ratings / 3 as var
  from (select user_id, count(*) filter (status = 'finished') as book_count, coalesce(sum({_DEPTH}) filter (status = 'finished'), 0) as feedback_depth, count(distinct genre) filter (status = 'finished') as genres, count(distinct rating) as ratings
    from shelf left join (select book_id, genre from items) using (book_id) group by 1))"""
_ATTRS = "attrs as (select book_id, attr, case when (book_id + length(attr)) % 4 <> 0 then ((book_id * length(attr)) % 10) / 10 end as score from items, (select unnest(['plot', 'world', 'style']) as attr))"
_PROFILE = "prof as (select user_id, attr, round(round(sum(score * (1 + s.book_id % 3)) / sum(1 + s.book_id % 3), 9), 2) as score from shelf s join attrs a using (book_id) where rating = 'good' and score is not null group by 1, 2)"
_GENERIC = " or ".join(f"contains(r, '{g}')" for g in T.GENERIC_REASON_WORDS)


def oracle_sql() -> dict[str, str]:
    w = views.with_views
    r = f"with {REASONS.cte()}"
    pr = f"nullif(trim({X._chain('''split_part(author, ',', 1)''', r'\s*\([^)]*\)', rf'\s+({T.PRIMARY_ROLES})\s*$')}), '')"
    genre_ids = f"gs as (select distinct genre_text, level from (select case when trim({X._G}) <> '' then {X._BODY}[1] end as genre_text, 'l1' as level from books union all select case when trim({X._G}) <> '' and len({X._BODY}) >= 2 then array_to_string({X._BODY}[2:], ' ') end, 'l2' from books) where coalesce(genre_text, '') <> '')"
    told = "case when coalesce(evidence, '') <> '' then evidence else reason end"
    clean = "regexp_replace(coalesce(source, ''), '<[^>]+>', '', 'g')"
    words = f"list_filter(regexp_split_to_array({told}, '\\s+'), lambda x: length(x) >= 2)"
    return {
        "ag11_new_themes": w("books", f"""g as (select case when strpos(genre, '>') = 0 then genre else split_part(genre, '>', 1) end as a, nullif(split_part(genre, '>', 2), '') as b, count(*) as n from books group by 1, 2 having count(*) >= 10),
p as (select {pr} as a, count(*) as n from books group by 1 having count(*) >= 3), k as (select a, count(*) as n from (select unnest(library_keywords) as a from books) group by 1 having count(*) >= 5),
t as (select 'genre_combo|' || a || '|' || b as theme_key, 'genre_combo' as theme_type, a || ' · ' || b as title, a || ' 중 ' || b || ' 분류의 책들' as description, 'general' as personalization, n from g where a is not null and b is not null
  union all select 'author|' || a, 'author', a || ' 컬렉션', a || ' 작가의 책들', 'by_author', n from p where a is not null union all select 'keyword|' || a, 'keyword', a, a || ' 관련 책들', 'general', n from k)""")
        + "select * from t where theme_key not in ('keyword|red', 'author|Brand#12', 'nothing')",
        "cu2_retired_themes": w("books", "t as (select book_id, book_id % 150 as shown, case when book_id % 3 = 0 then 0 else book_id % 5 end as clicks, created_at from books)")
        + f"select book_id, not (shown = 0 and created_at < date '{views.TODAY}' - 30) and not (shown >= 100 and clicks / shown < 0.005 and created_at < date '{views.TODAY}' - 90) as is_active from t",
        "cu5_retained": w("impressions") + "select event_id, user_id from impressions where shown_at >= (select max(ts) from events) - interval 14 days",
        "cu6_next_stage": w("shelf impressions", STAGES.cte(), f"us as ({_STATE} group by 1)", "pairs as (select x.book_id as a, y.book_id as b, count(*) filter (x.rating = 'good' and y.rating = 'good') as co_like from shelf x join shelf y on x.user_id = y.user_id and x.book_id < y.book_id group by 1, 2)", """f as (
  select *, (select count(*) from us where is_active) as users, (select count(*) from pairs where co_like >= 3) as pairs, (select count(*) from impressions where shown_at >= (select max(ts) from events) - interval 10 days) as exposure,
    (select count(*) filter (action in ('clicked', 'liked', 'saved')) / count(*) from impressions where shown_at >= (select max(ts) from events) - interval 10 days) as ctr from stages),
d as (select *, coalesce(users >= cast(json_extract_string(thresholds, '$.stage' || (stage + 1) || '.users') as int) and pairs >= cast(json_extract_string(thresholds, '$.stage' || (stage + 1) || '.pairs') as int), false) as up,
  coalesce(stage > 0 and pre_ctr > 0 and exposure >= cast(json_extract_string(thresholds, '$.min_exposure') as int) and (ctr - pre_ctr) / pre_ctr < cast(json_extract_string(thresholds, '$.rollback_threshold') as double), false) as down from f)""")
        + "select id, stage, case when up then stage + 1 when down then stage - 1 else stage end as next_stage, case when up then 'auto_promote' when down then 'auto_rollback' end as reason, users, pairs, round(case when up then ctr when down then null else pre_ctr end, 6) as pre_ctr, round(case when down and not up then ctr end, 6) as post_ctr from d",
        "ag7_confidence": w("shelf items", _CONFIDENCE) + "select user_id, round(least(feedback_depth / 25 * 0.4 + div * 0.3 + var * 0.15 + least(book_count / 10, 1.0) * 0.15, 1.0), 3) as score, feedback_depth, book_count, round(div, 3) as genre_diversity, round(var, 3) as rating_variance from conf",
        "js1_confidence_json": w("shelf items", _CONFIDENCE) + "select user_id, '{\"book_count\":' || book_count || ',\"feedback_depth\":' || feedback_depth || '}' as result from conf",
        "js2_thresholds": f"with {THRESHOLDS.cte()} select id, cast(json_extract_string(thresholds, '$.stage1.users') as int) as users, json_extract(thresholds, '$.stage1') is not null as has_stage1, cast(json_extract_string(thresholds, '$.rollback_threshold') as double) as rollback from nations",
        "mt6_depth": w("shelf") + f"select user_id, book_id, {_DEPTH} as depth, case when rating = 'bad' then 0.0 else cast((case when length(review_text) >= 50 then 3.0 when len(emotion_tags) >= 1 then 2.0 when rating is not null then 1.5 else 1.0 end) * (case when book_id % 7 = 0 then 1.2 else 1.0 end) as double) end as weight from shelf",
        "ag14_recent_click_rate": w("impressions") + "select source, count(*) as shown, count(*) filter (action in ('clicked', 'liked')) as hits, round(count(*) filter (action in ('clicked', 'liked')) / count(*), 6) as ctr from impressions where shown_at >= (select max(ts) from events) - interval 7 days group by 1",
        "ag2_changed_users": w("shelf") + _STATE + " where user_id in (select user_id from shelf where updated_at >= (select max(ts) from events) - interval 2 days) group by 1",
        "tk8_theme_page": w("books", "k as (select unnest(library_keywords) as curation_id, book_id from books), p as (select *, row_number() over (partition by curation_id order by book_id) - 1 as pos, count(*) over (partition by curation_id) as total from k)")
        + "select curation_id, cast(total as integer) as total, cast(pos as integer) as pos, book_id, title from p join books using (book_id) where pos between 5 and 14 and book_id % 7 <> 0",
        "str30_theme_gates": w("books", "k as (select distinct unnest(library_keywords) as keyword from books), a as (select *, case when length(keyword) % 5 = 0 then 'missing' when length(keyword) % 3 = 0 then 'kill' when length(keyword) % 3 = 1 and length(keyword) % 2 <> 0 and length(keyword || ' 모음') between 4 and 30 then 'keep' else 'missing' end as action from k)")
        + "select keyword, action, case when action = 'keep' then keyword || ' 모음' end as title, case when action = 'keep' then 'd' end as description, length(keyword) % 2 = 0 as unrefined from a",
        "ag15_status": w("books items item_reasons item_vectors") + """select count(loan_count) as with_loan_count, count(*) filter (loan_count is not null and rich_description is null) as missing_rich_description, count(rich_description) as with_rich_description, (select count(*) from items) as with_v3_vectors,
(select count(*) from item_reasons) as with_reasons, (select count(distinct book_id) from item_reasons) as with_reasons_distinct_books, (select count(*) from item_vectors) as with_embeddings from books""",
        "ag23_distribution": w("shelf") + "select status as value, count(*) as n, 'status' as what from shelf group by 1 union all select coalesce(rating, '(none)'), count(*), 'rating' from shelf group by 1",
        "ag25_match_paths": w("books") + "select coalesce(loan_count_source, '(none)') as path, count(*) as n from books group by 1",
        "ag24_histogram": w("items", 'p as (select round(list_dot_product(a."desc", b."desc"), 6) as x from items a join items b on b.book_id = a.book_id + 1)')
        + "select round(min(x), 5) as least, round(max(x), 5) as greatest, round(avg(x), 5) as mean, " + ", ".join(f"count(*) filter (x >= {a} and x < {b}) as bin{k}" for k, (a, b) in enumerate(zip((0.0, 0.3, 0.5, 0.7, 0.9, 0.99), (0.3, 0.5, 0.7, 0.9, 0.99, 1.001)))) + ", round(count(*) filter (x >= 0.99) / count(*) * 100, 5) as saturation_pct from p",
        "ag20_shelf_summary": w("shelf books") + "select user_id, count(*) as total, count(*) filter (status = 'finished') as finished, count(*) filter (status = 'wishlist') as wishlist, count(rating) as rated, count(distinct case when strpos(genre, '>') = 0 then genre else split_part(genre, '>', 1) end) as genres from shelf left join (select book_id, genre from books) using (book_id) group by 1",
        "ag19_author_groups": w("shelf books", f"a as (select user_id, {pr} as author, book_id from shelf join (select book_id, author from books) using (book_id))") + "select user_id, author, count(*) as n, string_agg(book_id, ',' order by book_id) as book_ids from a where author is not null group by 1, 2 having count(*) >= 2",
        "ag26_composite": f"with {METRICS.cte()}, m as (select hypothesis, grp, avg(cov) * 0.25 + avg(div) * 0.2 + avg(auth) * 0.2 + avg(t5) * 0.2 + avg(ad) * 0.15 as v from metrics group by 1, 2) select hypothesis, count(*) as groups, round(avg(v), 6) as composite from m group by 1",
        "ag27_reason_checks": w("item_reasons", REASONS.cte(), "x as (select reason as r from item_reasons union all select reason from reason_rows where reason is not null)", f"t as (select avg(length(r)) as a, avg(case when length(r) < 15 then 1.0 else 0.0 end) as s, avg(case when {_GENERIC} then 1.0 else 0.0 end) as g, (select count(*) from (select r from x group by 1 having count(*) >= 3)) as repeated from x)")
        + "select round(a, 6) as avg_length, round(s, 6) as short_ratio, round(g, 6) as generic_ratio, repeated, a >= 15 and s <= 0.3 and g <= 0.05 and repeated = 0 as ok from t",
        "ag28_verification": w("books items item_reasons", genre_ids, """v as (select count(*) as n, count(*) filter ("desc" is null) as nulls, count(*) filter (len("desc") <> 64) as odd, count(*) filter (book_id % 9 <> 0 and not exists (select 1 from gs where level = 'l1' and genre_text = items.l1)) as orphans from items),
f as (select count(*) filter (n < 5) as few, count(*) as told from (select book_id, count(*) as n from item_reasons group by 1)), l as (select count(*) filter (level = 'l1') as l1, count(*) filter (level = 'l2') as l2 from gs), o as (select *, (select count(rich_description) from books) as rich from v, f, l)""")
        + """select 'vectors of rich books' as "check", n as value, n >= rich * 0.995 as ok from o union all select 'null vectors', nulls, nulls = 0 from o union all select 'odd dimensions', odd, odd = 0 from o union all select 'orphan genres', orphans, orphans = 0 from o
union all select 'books of few reasons', few, few <= 80 from o union all select 'books with reasons', told, told > 0 from o union all select 'first genres', l1, l1 between 15 and 30 from o union all select 'second genres', l2, l2 >= 100 from o""",
        "ag17_attribute_profile": w("shelf items", _ATTRS, _PROFILE) + "select * from prof",
        "ag18_attribute_match": w("shelf items", _ATTRS, _PROFILE) + "select s.user_id, s.book_id, round(coalesce(avg(p.score * a.score), 0), 6) as match from shelf s left join attrs a on a.book_id = s.book_id and a.score is not null left join prof p on p.user_id = s.user_id and p.attr = a.attr where s.status = 'wishlist' group by 1, 2",
        "flt16_reason_filter": f"{r}, x as (select coalesce(title, '') as t, trim(reason) as r from reason_rows) select t, coalesce(string_agg(r, '|' order by r) filter (length(r) between 10 and 60 and not list_contains(regexp_split_to_array(t, '\\s*[-–—:]\\s*'), r) and r <> t and (length(r) >= 15 or not ({_GENERIC}))), '') as kept from x group by 1",
        "flt17_phrase_filter": f"{r}, x as (select id, trim(reason) as r from reason_rows where reason is not null) select id, not (length(r) < 4 or " + " or ".join(f"contains(r, '{g}')" for g in curation.GENERIC_PHRASES) + " or r in (" + ", ".join(f"'{m}'" for m in curation.META_CATEGORIES) + ") or regexp_matches(r, '(\\?|할까|인가)$') or regexp_matches(r, '^.+(이다|한다|된다|있다|없다|했다|됐다|아니다)$') or (length(r) > 12 and regexp_matches(r, '[을를의에서로].*[냄함임음줌짐김됨봄럼침]$')) or length(r) > 25 or contains(r, ' vs ') or contains(r, ' VS ')) as kept from x",
        "flt18_verified": f"{r} select id, coalesce(contains({clean}, {told}) or (len({words}) > 0 and len(list_filter({words}, lambda x: contains({clean}, x))) / len({words}) >= 0.4), false) as kept from reason_rows where reason is not null",
        "dt_times": w("ev") + """select event_id, strftime(ts, '%Y-%m-%dT%H') as bucket, case when event_id % 10 = 0 then -1.0 else cast(epoch(timestamp '2024-02-01') - floor(epoch(ts)) as double) end as age, ts >= timestamp '2024-02-01' - interval 7 days as recent,
case when event_id % 10 = 0 then false else epoch(timestamp '2024-02-01') - floor(epoch(ts)) < 180 end as fresh, strftime(ts, 'v%Y%m') as version, sha256(strftime(ts, '%Y-%m-%d %H:%M:%S') || '|' || strftime(ts, '%Y-%m-%dT%H')) as hash from ev""",
    }
