"""Queries of user state, co-occurrence, click rates, popularity and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import activity
from ..sources import views
from . import text_queries


def ag1_user_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The newest event is the present; one number goes over the driver.
    as_of = views.events(spark, sf_dir).agg(F.max("ts")).first()[0]
    return activity.user_state(views.shelf(spark, sf_dir), F.lit(as_of))


def ag3_top_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.top_taste(views.shelf(spark, sf_dir), views.items(spark, sf_dir), "author", activity.TOP_AUTHORS)


def ag3_top_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.top_taste(views.shelf(spark, sf_dir), views.items(spark, sf_dir), "l1", activity.TOP_L1S)


def ag5_co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.co_occurrence(views.shelf(spark, sf_dir))


def ag14_click_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.click_rate(views.impressions(spark, sf_dir), ["source"]).withColumn("ctr", F.round("ctr", 6))


def ag21_top_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.top_reasons(views.item_reasons(spark, sf_dir))


def cu3_popular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.popular(views.items(spark, sf_dir))


def st2_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    e = views.events(spark, sf_dir).select("user_id", F.col("k").alias("book_id"), F.when(t == "purchase", "good").when(t == "error", "bad").alias("state"), F.col("ts").alias("at"), "event_id")
    return activity.transitions(e)


def flt8_open_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impressions of books that the user has not marked as not interesting, by source."""
    open_ = views.impressions(spark, sf_dir).join(views.signals(spark, sf_dir), ["user_id", "book_id"], "left_anti")
    return open_.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


FUNCTIONS = (ag1_user_state, ag3_top_authors, ag3_top_genres, ag5_co_occurrence, ag14_click_rate, ag21_top_reasons, cu3_popular, st2_transitions, flt8_open_impressions)


def queries() -> dict:
    return {f.__name__: f for f in FUNCTIONS}


def _taste(key: str, n: int) -> str:
    return views.with_views("items shelf", f"""liked as (select user_id, {key} as key, count(*) as n from shelf join items using (book_id) where rating = 'good' group by 1, 2),
ranked as (select *, row_number() over (partition by user_id order by n desc, key) as rank from liked where key is not null)""") + f"select user_id, key, n, cast(rank as integer) as rank from ranked where rank <= {n}"


def oracle_sql() -> dict[str, str]:
    w = views.with_views
    return {
        "ag1_user_state": w("shelf") + """select user_id, count(*) filter (rating = 'good') as total_likes, count(*) filter (status = 'wishlist') as total_saves, count(*) filter (status = 'finished') as total_finished,
max(updated_at) as last_active_at, case when count(*) filter (rating = 'good') >= 6 then 2 when count(*) filter (rating = 'good') >= 3 then 1 else 0 end as tier,
max(updated_at) >= (select max(ts) from events) - interval 30 days as is_active from shelf group by 1""",
        "ag3_top_authors": _taste(text_queries._PRIMARY, activity.TOP_AUTHORS),
        "ag3_top_genres": _taste("l1", activity.TOP_L1S),
        "ag5_co_occurrence": w("shelf") + """select x.book_id as a, y.book_id as b, count(*) filter (x.rating = 'good' and y.rating = 'good') as co_like, count(*) filter (x.status = 'wishlist' and y.status = 'wishlist') as co_save
from shelf x join shelf y on x.user_id = y.user_id and x.book_id < y.book_id group by 1, 2 having co_like >= 3 or co_save >= 3""",
        "ag14_click_rate": w("impressions") + "select source, count(*) as shown, count(*) filter (action in ('clicked', 'liked')) as hits, round(count(*) filter (action in ('clicked', 'liked')) / count(*), 6) as ctr from impressions group by 1",
        "ag21_top_reasons": w("item_reasons") + "select book_id, reason from (select *, row_number() over (partition by book_id order by user_mention_count desc, reason_pos) as k from item_reasons) where k = 1",
        "cu3_popular": w("items", """lib as (select book_id, title, loan_count_12mo as v, 1 as p from (select *, row_number() over (partition by title order by loan_count_12mo desc, book_id) as e from items where loan_count_12mo is not null) where e = 1 order by v desc, book_id limit 20),
store as (select book_id, title, sales_point as v, 2 as p from (select *, row_number() over (partition by title order by sales_point desc, book_id) as e from items where sales_point is not null) where e = 1 and title not in (select title from lib) order by v desc, book_id limit 10)""")
        + "select book_id, cast(row_number() over (order by p, v desc, book_id) as integer) as rank from (select * from lib union all select * from store)",
        "st2_transitions": w("ev") + """select user_id, book_id, event_id, old, state as new from (select user_id, k as book_id, event_id, case event_type when 'purchase' then 'good' when 'error' then 'bad' end as state,
lag(case event_type when 'purchase' then 'good' when 'error' then 'bad' end) over w as old, row_number() over w as n from ev window w as (partition by user_id, k order by ts, event_id)) where n > 1 and old is distinct from state""",
        "flt8_open_impressions": w("impressions shelf signals") + "select source, count(*) as n, count(distinct user_id) as users from impressions i where not exists (select 1 from signals s where s.user_id = i.user_id and s.book_id = i.book_id) group by 1",
    }
