"""Queries of similar items and of both recommendation stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import kernels, scoring, similar
from ..operators.blocks import top_per
from ..operators.saved import written
from ..sources import views
from . import text_queries

CANDIDATES = scoring.CANDIDATES


def tk1_similar_by_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector as a query, its own book excluded."""
    q = views.item_vectors(spark, sf_dir).where("book_id % 20 = 0")
    q = q.select(F.col("book_id").alias("query_id"), "vec", F.array("book_id").alias("exclude"))
    return similar.similar_to_vectors(q, views.items(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


def tk2_similar_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = views.items(spark, sf_dir)
    return similar.similar_items(i, i, 10).withColumn("score", F.round("score", 6))


def dd2_similar_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = views.items(spark, sf_dir)
    return similar.similar_works(i, i, 10).withColumn("score", F.round("score", 6))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = views.items(spark, sf_dir)
    return similar.similar_works(i, i.where("book_id = 0"), 10)


def ag13_union_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = views.items(spark, sf_dir)
    seeds = i.select((F.col("book_id") % 7).alias("query_id"), "book_id")
    return similar.union_vector(i, seeds).select("query_id", F.posexplode("vec").alias("pos", "x")).withColumn("x", F.round("x", 6))


def ag12_aggregate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = scoring.aggregate_reasons(views.items(spark, sf_dir), views.item_reasons(spark, sf_dir))
    return a.select("book_id", F.posexplode("agg").alias("pos", "x")).withColumn("x", F.round("x", 6))


def mt2_mt3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine and MaxSim of each item and the next."""
    r = views.item_reasons(spark, sf_dir).groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("reason_pos", "vec"))), lambda x: x["vec"]).alias("r"))
    i = views.items(spark, sf_dir).select("book_id", "desc").join(r, "book_id", "left").withColumn("r", F.coalesce("r", F.array().cast("array<array<double>>")))
    nxt = i.select((F.col("book_id") - 1).alias("book_id"), F.col("desc").alias("desc2"), F.col("r").alias("r2"))
    return i.join(nxt, "book_id").select("book_id", F.round(V.cosine("desc", "desc2"), 6).alias("cosine"), F.round(V.max_sim("r", "r2"), 6).alias("max_sim"))


def _parts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = {n: getattr(views, n)(spark, sf_dir) for n in ("items", "item_reasons", "item_vectors", "shelf", "feedback", "signal_lists")}
    t["agg"] = scoring.aggregate_reasons(t["items"], t["item_reasons"])
    # Both stages read the profiles; their signals, which grow with users times items, are held as differences.
    t["users"] = written(kernels.narrow(kernels.packed(scoring.profiles(t["shelf"], t["feedback"], t["signal_lists"], t["item_vectors"], t["agg"]), "avoid"), "own_vec", "fb_vec"))
    # The profiles hold what is taken: shelves and signals.
    t["taken"] = None
    return t


def _stage_one(*parts: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = _parts(spark, sf_dir)
        return scoring.stage_one(t["users"], t["items"], t["agg"], t["taken"], CANDIDATES, parts=parts).withColumn("score", F.round("score", 6))

    return run


def _candidates(t: dict[str, DataFrame], *carry: str) -> DataFrame:
    """The candidates of all users, and what else of an item a re-ranking reads, so that no candidate is shuffled to find it."""
    return scoring.stage_one(t["users"], t["items"], t["agg"], t["taken"], CANDIDATES, carry=carry)


def _asking(t: dict[str, DataFrame]) -> DataFrame:
    """Profiles with the candidates of stage one, as stage two reads them."""
    return scoring.stage_one(t["users"], t["items"], t["agg"], t["taken"], CANDIDATES, through=scoring.PROFILE)


def rc3_stage_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _parts(spark, sf_dir)
    scored = scoring.stage_two(_asking(t), t["users"], t["shelf"], t["feedback"], t["items"], t["item_reasons"], t["item_vectors"])
    return scored.withColumn("score", F.round("score", 6))


def rc10_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best of the candidates by stage two, those without a cover left out after the cut."""
    t = _parts(spark, sf_dir)
    scored = scoring.stage_two(_asking(t), t["users"], t["shelf"], t["feedback"], t["items"], t["item_reasons"], t["item_vectors"], n=50)
    best = top_per(scored, ["user_id"], [F.desc("score"), "book_id"], 50)
    shown = t["items"].where("cover_url <> ''").select("book_id", "title")
    return best.join(shown, "book_id").select("user_id", "rank", "book_id", "title", F.round("score", 4).alias("score"))


def rc19_static_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _parts(spark, sf_dir)
    return scoring.cap_per_group(_candidates(t), t["items"], 6, 20).select("user_id", "rank", "book_id", "l1")


QUERIES = {f.__name__: f for f in (tk1_similar_by_vector, tk2_similar_items, dd2_similar_works, ag12_aggregate_reasons, ag13_union_vector, mt2_mt3_pairs)} | {
    "rc1_stage_one": _stage_one("single", "per_book"), "rc7_single_query": _stage_one("single"), "rc8_per_book": _stage_one("per_book"),
} | {f.__name__: f for f in (rc3_stage_two, rc10_recommendations, rc19_static_cap)}

_DOT = "list_dot_product"
_FACTOR = "case source_tier when 'kakao_desc' then 0.95 when 'minimal' then 0.85 else 1.0 end"
_KEY = f"case when {text_queries._WORK_T} <> '' then {text_queries._WORK_T} || '|' || {text_queries._WORK_A} end"


def _ranked(pairs: str) -> str:
    return f"""scored as (select query_id, book_id, case when s > 0 then s * {_FACTOR} else s end as score from ({pairs})),
ranked as (select *, row_number() over (partition by query_id order by score desc, book_id) as rank from scored)"""


_ITEM_PAIRS = f'select q.book_id as query_id, i.book_id, i.source_tier, {_DOT}(q."desc", i."desc") as s from items q join items i on q.book_id <> i.book_id'
_MEAN = """{name} as (
  select {key}, list(x / case when n > 0 then n else 1 end order by pos) as v
  from (select *, sqrt(sum(x * x) over (partition by {key})) as n from (select {key}, pos, avg(x) as x from (select {key}, unnest({vec}) as x, generate_subscripts({vec}, 1) as pos from {rows}) group by 1, 2))
  group by 1)"""
_AGG = _MEAN.format(name="mean_reason", key="book_id", vec="vec", rows="item_reasons") + ', agg as (select i.book_id, coalesce(m.v, list_transform(i."desc", lambda x: 0.0::double)) as a from items i left join mean_reason m using (book_id))'
_PROFILE = _AGG + f""", roles as (
  select user_id, book_id, case when rating = 'good' then 'good' when rating = 'bad' then 'bad' when status = 'wishlist' then 'wish' end as role from shelf
  union all select user_id, book_id, 'avoid' from signals
), r as (select user_id, roles.book_id, role, vec, coalesce(a, list_transform(vec, lambda x: 0.0::double)) as a from roles join item_vectors using (book_id) left join agg using (book_id) where role is not null),
fb as (select user_id, book_id, vec, case when rating = 'bad' then -1.0 else 1.0 end as sign from feedback where rating is null or rating <> 'neutral'),
hit as (
  select r.user_id, i.book_id, max({_DOT}(i."desc", r.vec)) filter (role = 'good') as gd, max({_DOT}(g.a, r.a)) filter (role = 'good') as ga,
         coalesce(sum({_DOT}(i."desc", r.vec)) filter (role = 'good'), 0) as sd, coalesce(sum({_DOT}(g.a, r.a)) filter (role = 'good'), 0) as sa,
         coalesce(sum({_DOT}(i."desc", r.vec)) filter (role = 'bad'), 0) as bd, coalesce(sum({_DOT}(i."desc", r.vec)) filter (role = 'wish'), 0) as wd,
         coalesce(sum({_DOT}(i."desc", r.vec)) filter (role = 'avoid'), 0) as nd,
         max({_DOT}(i."desc", r.vec)) filter (role = 'wish') as wm, max({_DOT}(i."desc", r.vec)) filter (role = 'avoid') as nm
  from r, items i join agg g using (book_id) group by 1, 2
), heard as (select user_id, i.book_id, sum(sign * {_DOT}(i."desc", fb.vec)) as f, avg(sign * {_DOT}(i."desc", fb.vec)) as fm from fb, items i group by 1, 2),
rated as (
  select hit.*, coalesce(f, 0) as f, coalesce(fm, 0) as fm, 3 * gd + 2 * ga + 2 * coalesce(f, 0) as single,
         3 * sd - 1.5 * bd + 2 * sa + 2 * coalesce(f, 0) + wd - 0.75 * nd as per_book
  from hit left join heard using (user_id, book_id)
), taken as (select user_id, book_id from shelf union select user_id, book_id from signals)"""


def _stage_one_sql(*parts: str, n: int = CANDIDATES) -> str:
    score = " + ".join(f"({p} - min({p}) over w) / (max({p}) over w - min({p}) over w + 1e-9)" for p in parts)
    return f"""{_PROFILE}, one as (
  select *, row_number() over (partition by user_id order by score desc, book_id) as rank
  from (select user_id, book_id, {score} as score from rated where gd is not null window w as (partition by user_id)) anti join taken using (user_id, book_id)
), cand as (select * from one where rank <= {n})"""


_STAGE_TWO = f"""{_stage_one_sql("single", "per_book")}, pair as (
  select c.user_id, c.book_id, s.book_id as g, case s.rating when 'good' then 1.0 else -1.0 end as sign, fb.vec as e
  from cand c join shelf s on s.user_id = c.user_id and s.rating in ('good', 'bad') and s.book_id in (select book_id from item_vectors)
  left join fb on fb.user_id = s.user_id and fb.book_id = s.book_id
), needed as (select distinct g, book_id from pair),
ms as (select g, book_id, avg(best) as ms from (
  select n.g, n.book_id, q.reason_pos, max({_DOT}(q.vec, k.vec)) as best from needed n join item_reasons q on q.book_id = n.g join item_reasons k on k.book_id = n.book_id group by 1, 2, 3) group by 1, 2),
fs as (select p.user_id, p.g, p.book_id, max({_DOT}(p.e, k.vec)) as fs from pair p join item_reasons k on k.book_id = p.book_id where p.e is not null group by 1, 2, 3),
mean as (
  select user_id, book_id, avg(sign * case when e is not null then 3 * coalesce(fs, 0) + 0.5 * coalesce(ms, 0) else coalesce(ms, 0) end) as m
  from pair left join ms using (g, book_id) left join fs using (user_id, g, book_id) group by 1, 2
), two as (
  select user_id, book_id, case when t > 0 then t * {_FACTOR} else t end as score
  from (select user_id, book_id, source_tier, 2 * m + 3 * coalesce(gd, 0) + 2 * fm + coalesce(wm, 0) - 0.75 * coalesce(nm, 0) as t
        from mean join rated using (user_id, book_id) join items using (book_id)))"""
_NEEDED = "items item_reasons item_vectors shelf feedback signals"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    w = views.with_views
    vec = 'select {k}, cast(pos - 1 as integer) as pos, round(x, 6) as x from (select {k}, unnest({v}) as x, generate_subscripts({v}, 1) as pos from {t})'
    one = "select user_id, cast(rank as integer) as rank, book_id, round(score, 6) as score from cand"
    return {
        "tk1_similar_by_vector": w("items item_vectors", _ranked(f'select q.book_id as query_id, i.book_id, i.source_tier, {_DOT}(q.vec, i."desc") as s from item_vectors q join items i on q.book_id <> i.book_id where q.book_id % 20 = 0'))
        + "select query_id, cast(rank as integer) as rank, book_id, round(score, 6) as score from ranked where rank <= 10",
        "tk2_similar_items": w("items", _ranked(_ITEM_PAIRS)) + "select query_id, cast(rank as integer) as rank, book_id, round(score, 6) as score from ranked where rank <= 10",
        "dd2_similar_works": w("items", f"keys as (select book_id, {_KEY} as k from items)", _ranked(_ITEM_PAIRS), """other as (
  select r.*, row_number() over (partition by r.query_id, coalesce(k.k, '#' || r.book_id) order by r.rank) as edition
  from ranked r join keys k on k.book_id = r.book_id join keys q on q.book_id = r.query_id where r.rank <= 25 and coalesce(k.k <> q.k, true)
), work as (select query_id, book_id, score, row_number() over (partition by query_id order by score desc, book_id) as rank from other where edition = 1)""")
        + "select query_id, cast(rank as integer) as rank, book_id, round(score, 6) as score from work where rank <= 10",
        "ag12_aggregate_reasons": w("items item_reasons", _AGG) + vec.format(k="book_id", v="a", t="agg"),
        "ag13_union_vector": w("items", 'seeds as (select book_id % 7 as query_id, "desc" as vec from items)', _MEAN.format(name="mean", key="query_id", vec="vec", rows="seeds")) + vec.format(k="query_id", v="v", t="mean"),
        "mt2_mt3_pairs": w("items item_reasons", f"""best as (select q.book_id, q.reason_pos, max({_DOT}(q.vec, k.vec)) as b from item_reasons q join item_reasons k on k.book_id = q.book_id + 1 group by 1, 2),
ms as (select book_id, avg(b) as m from best group by 1)""")
        + f"""select a.book_id, round({_DOT}(a."desc", b."desc") / sqrt({_DOT}(a."desc", a."desc")) / sqrt({_DOT}(b."desc", b."desc")), 6) as cosine, round(coalesce(m, 0), 6) as max_sim
from items a join items b on b.book_id = a.book_id + 1 left join ms on ms.book_id = a.book_id""",
        "rc1_stage_one": w(_NEEDED, _stage_one_sql("single", "per_book")) + one,
        "rc7_single_query": w(_NEEDED, _stage_one_sql("single")) + one,
        "rc8_per_book": w(_NEEDED, _stage_one_sql("per_book")) + one,
        "rc3_stage_two": w(_NEEDED, _STAGE_TWO) + "select user_id, book_id, round(score, 6) as score from two",
        "rc10_recommendations": w(_NEEDED, _STAGE_TWO, "best as (select *, row_number() over (partition by user_id order by score desc, book_id) as rank from two)")
        + "select user_id, cast(rank as integer) as rank, book_id, title, round(score, 4) as score from best join items using (book_id) where rank <= 50 and cover_url <> ''",
        "rc19_static_cap": w(_NEEDED, _stage_one_sql("single", "per_book"), """capped as (select *, row_number() over (partition by user_id, l1 order by rank) as k from cand join items using (book_id)),
fin as (select user_id, book_id, l1, row_number() over (partition by user_id order by rank) as place from capped where k <= 6)""")
        + "select user_id, cast(place as integer) as rank, book_id, l1 from fin where place <= 20",
    }
