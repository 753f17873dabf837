"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_kmeans, exact_dedup, fingerprint_lsm, hilbert, langid, maxscore, minhash, mixing, packing, partition_join, run_length_index, runs, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).drop("n_chunks")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op4_run_length_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_length_index.remove_repeats(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_lsm.remove_repeated_windows(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op7_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.hilbert_shards(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(table(spark, sf_dir, "documents"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify_languages(docs, langid.fit_language_model(docs))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(runs.periodic_runs(runs.with_planted_periods(table(spark, sf_dir, "documents"))))


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.ball_kmeans(table(spark, sf_dir, "embeddings"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition_join.similar_sets(table(spark, sf_dir, "documents"), percent=85, shingle=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_exact_top_k, op3_source_mixing, op4_run_length_dedup, op5_substring_dedup, op6_toxicity, op7_hilbert_sharding, op8_packing, op9_minhash_dedup, op10_language_id, op11_periodic_runs, op12_ball_kmeans, op13_jaccard_join)}


OP1_SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(body) as text_sha256
from (select doc_id, coalesce(text, '') as body from documents)
window w as (partition by body)
"""

OP2_SQL = """
with c as (
  select vec_id, unnest(list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint))) as x,
         generate_subscripts(embedding, 1) as i
  from embeddings
), s as (
  select q.vec_id as query_id, d.vec_id, cast(sum(q.x * d.x) as bigint) as score
  from c q join c d on q.i = d.i and q.vec_id <> d.vec_id
  where q.vec_id % 50 = 0
  group by 1, 2
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
where rank <= 5
"""

OP5_SQL = r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), p as (
  select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h
  from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from w where len(w) >= 50)
), hit as (
  select doc_id, i from (select doc_id, i, min(doc_id) over (partition by h) as earliest from p) where earliest < doc_id
), gone as (select distinct doc_id, i + j as i from hit, (select unnest(range(0, 50)) as j)),
kept as (
  select w.doc_id, string_agg(w.word, ' ' order by w.i) as body
  from (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from w) w
  anti join gone g on g.doc_id = w.doc_id and g.i = w.i
  group by 1
), cut as (select doc_id, count(*) as n from gone group by 1)
select w.doc_id, cast(len(w.w) as bigint) as n_words, coalesce(cut.n, 0) as n_removed, sha256(coalesce(kept.body, '')) as kept_sha256
from w left join cut using (doc_id) left join kept using (doc_id)
"""

OP9_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), s as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as shingle
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)
), n as (select doc_id, count(*) as n from s group by 1),
common as (
  select a.doc_id as a, b.doc_id as b, count(*) as c
  from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id
  group by 1, 2
), link as (
  select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b
  where 100 * c >= 85 * (x.n + y.n - c)
), both_ways as (select a, b from link union all select b, a from link),
reach as (
  select doc_id, doc_id as other from w
  union
  select r.doc_id, l.b from reach r join both_ways l on r.other = l.a
), least as (select doc_id, min(other) as component_id from reach group by 1)
select doc_id, coalesce(n.n, 0) as n_shingles, component_id, doc_id = component_id as kept
from least left join n using (doc_id)
"""


OP13_SQL = OP9_SQL.replace("w[i:i + 4]", "w[i:i + 3]").replace("len(w) - 4", "len(w) - 3").replace(", doc_id = component_id as kept", "")

#: crc32 of the decimal doc_id bit by bit (DuckDB has no such function); runs are islands of equal distance between equal 6-grams.
OP11_SQL = r"""
with t as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         xor(4294967295, list_reduce(
           list_concat([4294967295::bigint], flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda ch: [ascii(ch)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
           lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)))) as h
  from documents
), a as (
  select doc_id, w, len(w) as n, h % 10 = 0 and len(w) > 0 as hit, case when len(w) > 0 then (h // 10) % len(w) else 0 end as a, (h // 10) % 8 as e from t
), r as (select *, 1 + (n - a) // (3 + e) as p from a),
d as (
  select doc_id, case when hit then list_transform(range(0, n), lambda i: w[case when i < a then i else a + (i - a) % p end + 1]) else w end as w from r
), g as (
  select doc_id, i, array_to_string(w[i + 1:i + 6], ' ') as g from (select doc_id, w, unnest(range(0, len(w) - 5)) as i from d where len(w) >= 6)
), same as (
  select x.doc_id, x.i, y.i - x.i as q from g x join g y on x.doc_id = y.doc_id and x.g = y.g and x.i < y.i
), island as (
  select doc_id, q, min(i) as s, max(i) - min(i) + 6 + q as l
  from (select *, i - row_number() over (partition by doc_id, q order by i) as k from same) group by doc_id, q, k
), runs as (select doc_id, s, l, min(q) as q from island where l >= greatest(12, 2 * q) group by doc_id, s, l),
listed as (
  select doc_id, count(*) as n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) as body,
         arg_min({'s': s, 'l': l, 'q': q}, {'l': -l, 's': s, 'q': q}) as best
  from runs group by doc_id
), gone as (select distinct doc_id, unnest(range(s + q, s + l)) as i from runs),
kept as (
  select x.doc_id, string_agg(x.word, ' ' order by x.i) as body
  from (select doc_id, unnest(w) as word, generate_subscripts(w, 1) - 1 as i from d) x anti join gone using (doc_id, i) group by 1
)
select d.doc_id, coalesce(n_runs, 0) as n_runs, best.s as start, best.l as length, best.q as period, 1000 * best.l // best.q as exponent_milli,
       sha256(coalesce(listed.body, '')) as runs_sha256, sha256(coalesce(kept.body, '')) as collapsed_sha256
from d left join listed using (doc_id) left join kept using (doc_id)
"""


def _op12_sql(rounds: int = 10) -> str:
    """Rounds of assignment written out one after another."""
    parts = ["""
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as x
  from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), c0 as (select row_number() over (order by key) - 1 as c, x from (select sha256('3:' || vec_id) as key, x from v order by key limit 8))"""]
    nearest = "select vec_id, v.x, unnest([min({'d': d, 'c': c})]) as best from (select vec_id, v.x, c, cast(list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) as bigint) as d from v, %s c) v group by vec_id, v.x"
    for r in range(rounds + 1):
        parts.append(f", a{r} as materialized ({nearest % f'c{r}'})")
        if r < rounds:
            parts.append(f""", m{r} as (
  select c, list(m order by i) as x from (
    select best.c as c, i, cast(floor(sum(x[i]) / count(*)) as bigint) as m from a{r}, (select unnest(range(1, 65)) as i) group by 1, 2) group by c
), c{r + 1} as materialized (select c{r}.c, coalesce(m{r}.x, c{r}.x) as x from c{r} left join m{r} on m{r}.c = c{r}.c)""")
    return "".join(parts) + f"""
select vec_id, cast(best.c as integer) as cluster, best.d as distance, cast(sum(best.d) over (partition by best.c) as bigint) as cluster_inertia,
       cast(sum(best.d) over () as bigint) as inertia, sha256(array_to_string(c{rounds}.x, ',')) as centroid_sha256
from a{rounds} a join c{rounds} on c{rounds}.c = a.best.c
"""


OP12_SQL = _op12_sql()


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op2_exact_top_k": OP2_SQL, "op5_substring_dedup": OP5_SQL, "op9_minhash_dedup": OP9_SQL, "op11_periodic_runs": OP11_SQL, "op12_ball_kmeans": OP12_SQL, "op13_jaccard_join": OP13_SQL}
