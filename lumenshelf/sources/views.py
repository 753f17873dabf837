"""The recommendation tables, derived from the generic star-schema tables.

Each view exists twice: as a DataFrame and as a SQL text of the same rows, so
that every query can be stated in either engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A book that has a vector and no place in the catalogue: (its id, the row its vector is taken from).
OUTSIDE = (2000000, 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue items with a description vector; titles repeat, so editions of one work occur."""
    e = table(spark, sf_dir, "embeddings")
    p = table(spark, sf_dir, "part")
    b = F.col("vec_id")
    l1 = F.concat(F.lit("L"), F.col("label").cast("string"))
    return e.join(p, e["vec_id"] == p["p_partkey"], "left").select(
        b.alias("book_id"),
        F.col("p_name").alias("title"),
        F.when(b % 3 == 0, F.concat("p_brand", F.lit(" (지은이), "), F.lit("X (옮긴이)"))).when(b % 3 == 1, F.concat("p_brand", F.lit(" 지음"))).otherwise(F.col("p_brand")).alias("author"),
        F.when(b % 13 == 0, F.lit(None)).when(b % 17 == 0, F.lit("")).otherwise(F.concat(F.lit("http://c/"), b.cast("string"))).alias("cover_url"),
        F.concat(F.lit("국내도서>"), l1, F.lit(">"), F.split_part("p_type", F.lit(" "), F.lit(1))).alias("genre"),
        l1.alias("l1"),
        F.split_part("p_type", F.lit(" "), F.lit(1)).alias("l2"),
        (F.col("p_size") * 13 % 97).alias("loan_count"),
        F.when(b % 5 != 0, F.col("p_size") % 31).alias("loan_count_12mo"),
        F.when(b % 4 != 0, F.col("p_size") * 37).alias("sales_point"),
        F.split("p_name", " ").alias("library_keywords"),
        F.when(b % 7 == 0, "kakao_desc").when(b % 11 == 0, "minimal").otherwise("rich").alias("source_tier"),
        F.transform("embedding", lambda x: x.cast("double")).alias("desc"),
    )


#: Catalogue rows with all columns that ingest, merging and the work queues read. Both engines take this text.
BOOKS = """
select p_partkey as book_id,
  case when p_partkey % 11 = 0 then null when p_partkey % 13 = 0 then concat('K', cast(p_partkey as varchar(20))) else concat('978', lpad(cast(p_partkey as varchar(20)), 10, '0')) end as isbn,
  case when p_partkey % 97 = 0 then '' when p_partkey % 101 = 0 then concat('토익 ', p_name) when p_partkey % 6 = 1 then concat(p_name, ' (양장)') when p_partkey % 6 = 2 then concat(p_name, ': ', lower(p_type))
    when p_partkey % 6 = 3 then concat(p_name, ' (개정판)') when p_partkey % 6 = 4 then concat(p_name, ' : ', cast(p_partkey % 9 as varchar(20)), '권') else p_name end as title,
  case when p_partkey % 17 = 0 then null when p_partkey % 3 = 0 then concat(p_brand, ' (지은이), X (옮긴이)') when p_partkey % 3 = 1 then concat(p_brand, ' 지음') else p_brand end as author,
  case when p_partkey % 19 = 0 then null when p_partkey % 23 = 0 then '국내도서>유아>그림책' else concat('국내도서>L', cast(p_size % 7 as varchar(20)), '>', p_type) end as genre,
  case when p_partkey % 5 <> 0 then repeat(concat(p_name, ' '), p_size % 7 + 1) end as description,
  case when p_partkey % 4 = 1 then '' when p_partkey % 4 <> 0 then repeat(concat(p_name, '. '), 10 + p_size % 30) end as rich_description,
  case when p_partkey % 7 <> 0 then p_brand end as publisher,
  case when p_partkey % 4 <> 0 then p_size * 370 end as sales_point,
  case when p_partkey % 6 <> 5 then p_size * 13 % 97 end as loan_count,
  case when p_partkey % 5 <> 0 then p_size % 31 end as loan_count_12mo,
  case when p_partkey % 3 = 1 then 'usage' when p_partkey % 3 = 2 then 'list' end as loan_count_source,
  case when p_partkey % 4 = 0 then 'aladin' when p_partkey % 4 = 1 then 'data4library' when p_partkey % 4 = 2 then 'kakao' end as source,
  case when p_partkey % 5 <> 1 then 100 + p_size end as page_count,
  case when p_partkey % 3 = 0 then split('calm,dark', ',') end as mood_tags,
  case when p_partkey % 8 <> 0 then split(p_name, ' ') end as library_keywords,
  case when p_partkey % 2 = 0 then split('#fff', ',') end as dominant_colors,
  case when p_partkey % 10 <> 0 then 'Jua' end as spine_font,
  case when p_partkey % 13 = 0 then null when p_partkey % 16 = 0 then '' else concat('http://c/', cast(p_partkey as varchar(20))) end as cover_url,
  date '2024-01-01' + cast(p_partkey % 400 as int) as created_at,
  case when p_partkey % 9 <> 0 then date '2024-01-01' + cast(p_partkey * 7 % 400 as int) end as updated_at,
  case when p_partkey % 3 = 1 then '03' when p_partkey % 3 = 2 then '73' else '' end as addition_symbol,
  case when p_partkey % 7 = 0 then 'kakao_desc' when p_partkey % 11 = 0 then 'minimal' else 'rich' end as source_tier
from {part}"""
#: The day that interval rules of the catalogue count from.
TODAY = "2025-02-04"


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BOOKS, part=table(spark, sf_dir, "part"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def item_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three reason vectors of each item, those of other rows; items ending in 9 have none."""
    v = _vectors(spark, sf_dir)
    b = F.col("book_id")
    places = v.select(F.col("vec_id").alias("book_id"), F.explode(F.array(*map(F.lit, range(3)))).alias("j")).where(b % 10 != 9)
    places = places.withColumn("vec_id", (b * 7 + F.col("j") * 13 + 1) % F.lit(v.count()))
    return places.join(v, "vec_id").select(
        "book_id", (b * 10 + F.col("j")).alias("reason_pos"), F.concat(F.lit("reason "), F.col("vec_id").cast("string")).alias("reason"), (F.col("vec_id") % 7).cast("int").alias("user_mention_count"), "vec"
    )


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, vec of every embedding row, and of one book outside the index."""
    v = _vectors(spark, sf_dir)
    return v.select(F.col("vec_id").alias("book_id"), "vec").unionByName(v.where(F.col("vec_id") == OUTSIDE[1]).select(F.lit(OUTSIDE[0]).cast("long").alias("book_id"), "vec"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the catalogue item k that each is about, spread over the whole catalogue by user."""
    hundreds = F.lit(max(1, table(spark, sf_dir, "embeddings").count() // 100))
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", (k + 100 * ((F.col("user_id") + k) % hundreds)).alias("k"))


#: Shelf rows that the events do not give: (user, book, rating, status). -1 only dislikes, -2 has no rows,
#: -3 is neutral with feedback, -4 unrated with feedback, -5 likes a book that exists nowhere, -6 one outside the index.
EDGE_SHELF = [
    (-1, 3, "bad", "finished"), (-1, 5, "bad", "finished"),
    (-3, 6, "neutral", "finished"), (-3, 8, "good", "finished"),
    (-4, 9, None, "finished"), (-4, 10, "good", "finished"),
    (-5, 1000000, "good", "finished"), (-5, 11, "good", "finished"),
    (-6, 2000000, "good", "finished"), (-6, 12, "good", "finished"), (-6, 14, None, "wishlist"),
]


def shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each (user, book) as a shelf row, and the edge rows."""
    latest = Window.partitionBy("user_id", "k").orderBy(F.desc("ts"), F.desc("event_id"))
    e = events(spark, sf_dir).withColumn("rn", F.row_number().over(latest)).where("rn = 1")
    t = F.col("event_type")
    rows = e.select(
        "user_id",
        F.col("k").alias("book_id"),
        F.when(t == "purchase", "good").when(t == "error", "bad").alias("rating"),
        F.when(t == "view", "wishlist").otherwise("finished").alias("status"),
        F.col("ts").alias("updated_at"),
    )
    edge = spark.createDataFrame(EDGE_SHELF, "user_id long, book_id long, rating string, status string").withColumn("updated_at", F.lit("2020-01-01 00:00:00").cast("timestamp"))
    out = rows.unionByName(edge.withColumn("updated_at", F.col("updated_at").cast(rows.schema["updated_at"].dataType)))
    n = F.col("book_id") % 6
    tags = F.when(n == 0, F.array(F.lit("감동"), F.lit("위로"), F.lit("성장"))).when(n == 1, F.array(F.lit("감동"))).otherwise(F.array().cast("array<string>"))
    return out.withColumns({"emotion_tags": tags, "review_text": F.when(F.col("book_id") % 8 == 0, F.repeat(F.lit("r"), 60)).when(F.col("book_id") % 8 == 1, F.lit("short"))})


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, book_id, rating, vec of shelf rows with written feedback: the vector of the next book."""
    s = shelf(spark, sf_dir).where((F.col("rating").isin("good", "bad") & (F.col("book_id") % 3 == 0)) | ((F.col("user_id") < 0) & F.col("book_id").isin(6, 9)))
    v = _vectors(spark, sf_dir).withColumnRenamed("vec_id", "fb_id")
    return s.join(v, (s["book_id"] + 1) % F.lit(v.count()) == v["fb_id"]).select("user_id", "book_id", "rating", "fb_id", "vec")


def signal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, book_ids) marked not interesting: books absent from the shelf, by a fixed rule."""
    users = events(spark, sf_dir).select("user_id").distinct()
    last = table(spark, sf_dir, "embeddings").count() - 1
    first = (37 - F.col("user_id") % 37) % 37
    # A user's shelf comes to the user, so that no pair is shuffled.
    own = shelf(spark, sf_dir).groupBy("user_id").agg(F.collect_set("book_id").alias("_own"))
    rows = users.where(first <= last).join(own, "user_id", "left").withColumn("_own", F.coalesce("_own", F.array().cast("array<bigint>")))
    return rows.select("user_id", F.array_except(F.sequence(first, F.lit(last), F.lit(37).cast("long")), "_own").alias("book_ids"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signal_lists as rows (user_id, book_id, signal)."""
    return signal_lists(spark, sf_dir).select("user_id", F.explode("book_ids").alias("book_id"), F.lit("not_interested").alias("signal"))


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    return events(spark, sf_dir).select(
        "user_id",
        F.col("k").alias("book_id"),
        (F.col("event_id") % 10).cast("int").alias("position"),
        F.when(t == "signup", "trending").when(t == "view", "curation").otherwise("personal").alias("source"),
        F.when(t == "click", "clicked").when(t == "purchase", "liked").when(t == "error", "disliked").alias("action"),
        F.col("ts").alias("shown_at"),
        "event_id",
    )


SQL = {
    "books": "books as (" + BOOKS.format(part="part") + ")",
    "items": """items as (
  select vec_id as book_id, p_name as title,
         case when vec_id % 3 = 0 then p_brand || ' (지은이), X (옮긴이)' when vec_id % 3 = 1 then p_brand || ' 지음' else p_brand end as author,
         case when vec_id % 13 = 0 then null when vec_id % 17 = 0 then '' else 'http://c/' || vec_id end as cover_url,
         '국내도서>L' || label || '>' || split_part(p_type, ' ', 1) as genre, 'L' || label as l1, split_part(p_type, ' ', 1) as l2,
         p_size * 13 % 97 as loan_count,
         case when vec_id % 5 <> 0 then p_size % 31 end as loan_count_12mo,
         case when vec_id % 4 <> 0 then p_size * 37 end as sales_point,
         string_split(p_name, ' ') as library_keywords,
         case when vec_id % 7 = 0 then 'kakao_desc' when vec_id % 11 = 0 then 'minimal' else 'rich' end as source_tier,
         cast(embedding as double[]) as "desc"
  from embeddings left join part on p_partkey = vec_id)""",
    "item_reasons": """item_reasons as (
  select b.vec_id as book_id, b.vec_id * 10 + j as reason_pos, 'reason ' || v.vec_id as reason, v.vec_id % 7 as user_mention_count, cast(v.embedding as double[]) as vec
  from embeddings b, (select unnest(range(0, 3)) as j) j, embeddings v where b.vec_id % 10 <> 9 and v.vec_id = (b.vec_id * 7 + j * 13 + 1) % (select count(*) from embeddings))""",
    "item_vectors": "item_vectors as (select vec_id as book_id, cast(embedding as double[]) as vec from embeddings union all select 2000000, cast(embedding as double[]) from embeddings where vec_id = 20)",
    "ev": """ev as (
  select event_id, ts, user_id, event_type, k + 100 * ((user_id + k) % greatest(1, (select count(*) from embeddings) // 100)) as k
  from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events))""",
    "shelf": """shelf_rows as (
  select user_id, k as book_id, case event_type when 'purchase' then 'good' when 'error' then 'bad' end as rating,
         case event_type when 'view' then 'wishlist' else 'finished' end as status, ts as updated_at
  from (select *, row_number() over (partition by user_id, k order by ts desc, event_id desc) as rn from ev) where rn = 1
  union all
  select user_id, book_id, rating, status, timestamp '2020-01-01' from (values """
    + ", ".join(f"({u}, {b}, {'null' if r is None else repr(r)}, {s!r})" for u, b, r, s in EDGE_SHELF)
    + """) v(user_id, book_id, rating, status)
), shelf as (
  select *, case book_id % 6 when 0 then ['감동', '위로', '성장'] when 1 then ['감동'] else [] end as emotion_tags,
         case book_id % 8 when 0 then repeat('r', 60) when 1 then 'short' end as review_text
  from shelf_rows)""",
    "feedback": """feedback as (
  select s.user_id, s.book_id, s.rating, v.vec_id as fb_id, cast(v.embedding as double[]) as vec
  from shelf s join embeddings v on v.vec_id = (s.book_id + 1) % (select count(*) from embeddings)
  where (s.rating in ('good', 'bad') and s.book_id % 3 = 0) or (s.user_id < 0 and s.book_id in (6, 9)))""",
    "signals": """signals as (
  select u.user_id, b.book_id, 'not_interested' as signal
  from (select distinct user_id from ev) u, (select vec_id as book_id from embeddings) b
  where (u.user_id + b.book_id) % 37 = 0 and not exists (select 1 from shelf s where s.user_id = u.user_id and s.book_id = b.book_id))""",
    "impressions": """impressions as (
  select user_id, k as book_id, event_id % 10 as position,
         case event_type when 'signup' then 'trending' when 'view' then 'curation' else 'personal' end as source,
         case event_type when 'click' then 'clicked' when 'purchase' then 'liked' when 'error' then 'disliked' end as action, ts as shown_at, event_id
  from ev)""",
}
_NEEDS = {"shelf": ["ev"], "feedback": ["ev", "shelf"], "signals": ["ev", "shelf"], "impressions": ["ev"]}


def with_views(names: str, *more: str) -> str:
    """A WITH clause that holds the named views, then further table expressions."""
    order: list[str] = []
    for n in names.split():
        for x in [*_NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    return "with " + ",\n".join([*(SQL[n] for n in order), *more]) + "\n"
