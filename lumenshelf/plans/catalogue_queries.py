"""Queries of work queues, ingest, merging and repair over the whole catalogue, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalogue, ingest, queues
from ..sources import views
from . import text_queries as X
from .literals import Derived

CURSORS = Derived("cursors", "part", """select case p_partkey % 3 when 0 then 'item_list' when 1 then 'search' else 'author' end as source_type, case when p_partkey % 3 <> 0 then p_brand end as search_keyword,
  p_partkey % 4 <> 0 as completed, p_size as unique_items_saved, cast(p_partkey % 60 as int) as age from {source}""")
#: How a new arrival differs from the catalogue row it is made of.
ARRIVALS = """select case when book_id % 3 = 0 then isbn when book_id % 7 = 1 then '' else concat('979', lpad(cast(book_id as varchar(20)), 10, '0')) end as isbn,
  case when book_id % 5 = 0 then concat('new ', title) else title end as title, author, genre, loan_count * 2 - 40 as loan_count, addition_symbol, book_id as pos
from {books} where book_id % 2 = 0"""


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.books(spark, sf_dir)


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ARRIVALS, books=_books(spark, sf_dir))


def _genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genre rows with ids; one in eleven is missing."""
    g = ingest.genre_set(_books(spark, sf_dir)).withColumn("genre_id", F.concat_ws(":", "level", "genre_text"))
    return g.where(F.length("genre_text") % 11 != 0)


def _shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.shelf(spark, sf_dir).withColumn("has_feedback_vector", F.col("book_id") % 12 == 0)


def _ids(df: DataFrame) -> DataFrame:
    return df.select("book_id", *[c for c in ("place",) if c in df.columns])


def src1_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.page(_books(spark, sf_dir), ["title", "book_id"], 20, 50, F.col("source") == "aladin").select("book_id", "title")


def src2_next_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.after_key(_books(spark, sf_dir), "book_id", 57, 40).select("book_id", "title")


def src5_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.changed_since(_books(spark, sf_dir), F.lit("2024-06-01").cast("date")).select("book_id", "updated_at")


def flt10_users_to_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.users_to_embed(_shelf(spark, sf_dir), views.items(spark, sf_dir))


def flt11_needs_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.needs_feedback_vector(_shelf(spark, sf_dir)).select("user_id", "book_id")


def flt12_needs_scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(queues.needs_scrape(_books(spark, sf_dir)))


def flt13_needs_loan_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(queues.needs_loan_count(_books(spark, sf_dir), "usage", 30))


def flt14_needs_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(queues.needs_looks(_books(spark, sf_dir)))


def flt19_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.pool(_books(spark, sf_dir).withColumn("rank", F.col("book_id"))).select("book_id", "title")


def flt20_unreviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.unreviewed(views.shelf(spark, sf_dir), _books(spark, sf_dir)).select("user_id", "book_id")


def flt22_needs_tier2(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _books(spark, sf_dir)
    sources = F.when(F.col("book_id") % 6 == 0, F.array(F.lit("rich"), F.lit("library_keywords"))).when(F.col("book_id") % 6 == 2, F.array(F.lit("rich")))
    embedded = b.where("book_id % 2 = 0").select("book_id", F.when(F.col("book_id") % 10 == 0, 1).otherwise(2).alias("tier"), sources.alias("data_sources"))
    return _ids(queues.needs_tier2(b, embedded))


def flt23_needs_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(queues.needs_keywords(_books(spark, sf_dir)))


def flt24_pending_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(queues.pending_vectors(_books(spark, sf_dir), _books(spark, sf_dir).where("book_id % 3 <> 0"), 40))


def flt25_pending_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(queues.pending_reasons(_books(spark, sf_dir), views.item_reasons(spark, sf_dir)))


def flt26_provisional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(queues.provisional(_books(spark, sf_dir)))


def flt28_needs_genre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(queues.needs_genre(_books(spark, sf_dir)))


def tk10_stale_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(queues.stale_counts(_books(spark, sf_dir), 100))


def tk11_shelf_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shelves in their owners' order, rows without one last, the newest first."""
    from ..operators.blocks import top_per

    s = views.shelf(spark, sf_dir).withColumn("shelf_order", F.when(F.col("book_id") % 4 == 0, F.col("book_id") % 9))
    return top_per(s, ["user_id"], [F.asc_nulls_last("shelf_order"), F.desc("updated_at"), "book_id"], 20, "place").select("user_id", "place", "book_id")


def cu8_reembed_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, tier = T.source_choice("rich_description", "description", "title", "author", "genre")
    b = _books(spark, sf_dir)
    rows = b.select("book_id", F.col("source_tier").alias("stored_tier"), F.when(F.col("book_id") % 3 == 0, text).otherwise(F.col("title")).alias("stored_text"), F.when(F.col("book_id") % 10 != 0, text).alias("new_text"), tier.alias("new_tier"))
    return queues.reembed_plan(rows).select("book_id", "reembed", "update_tier", "new_tier")


def dd4_ingest_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ingest_actions(_arrivals(spark, sf_dir), _books(spark, sf_dir)).select("pos", "action", "target_id")


def dd5_edition_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.edition_duplicates(_arrivals(spark, sf_dir), _books(spark, sf_dir)).select("pos", "duplicate")


def dd6_canonical_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _books(spark, sf_dir)
    groups = b.select("book_id", T.core_title(T.edition_title("title")).alias("core"), T.plain_author("author").alias("writer")).where("length(core) >= 2")
    return ingest.canonical_picks(b, groups, ["core", "writer"]).where("others > 0")


def dd3_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal core title and author, and whether they are series; those that are not hold duplicates."""
    b = _books(spark, sf_dir)
    keyed = b.withColumns({"core": T.core_title(T.edition_title("title")), "writer": T.plain_author("author")}).where("length(core) >= 2")
    return ingest.is_series(keyed, ["core", "writer"])


def dd8_rich_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue after an upsert by ISBN that keeps the richer of each field and the newest source."""
    b = _books(spark, sf_dir).where("isbn is not null")
    new = b.where("book_id % 3 = 0").select("isbn", F.concat(F.coalesce("title", F.lit("")), F.lit("+")).alias("title"), F.lit(None).cast("string").alias("author"), (F.col("loan_count") - 5 + F.col("book_id") % 11).alias("loan_count"), F.when(F.col("book_id") % 2 == 0, "data4library").otherwise("").alias("source"))
    return catalogue.merge_records(b.select("isbn", "title", "author", "loan_count", "source"), new, "isbn", ["title", "author"], ["loan_count"], ["source"])


def dd9_repointed_shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shelves without copies that lack ISBN and source; titles are those of the first words, so that copies have twins."""
    b = _books(spark, sf_dir).withColumns({"title": F.split_part("title", F.lit(" "), F.lit(1)), "author": F.lit(None).cast("string"), "source": F.when(F.col("isbn").isNotNull(), F.col("source"))})
    return ingest.repoint(views.shelf(spark, sf_dir).select("user_id", "book_id", "status", "updated_at"), b).select("user_id", "book_id", "status")


def dd10_shelf_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a request: purchases and sign-ups as finished, all else for the wish list; one in nine without the book's id."""
    e, b = views.events(spark, sf_dir), _books(spark, sf_dir).select(F.col("book_id").alias("k"), "isbn")
    status = F.when(F.col("event_type").isin("purchase", "signup"), "finished").otherwise("wishlist")
    ask = e.join(b, "k", "left").select("user_id", F.when(F.col("k") % 9 != 0, F.col("k")).alias("book_id"), "isbn", status.alias("status"), F.col("event_id").alias("pos"))
    return ingest.shelf_writes(ask, views.shelf(spark, sf_dir)).select("user_id", "pos", "book_ref", "write")


def dd11_popular_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.popular_titles(_books(spark, sf_dir))


def dd12_ingest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ingest_items(_arrivals(spark, sf_dir), _books(spark, sf_dir).where("book_id % 4 <> 0"), ["pos"]).select("pos", "outcome")


def dd13_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _arrivals(spark, sf_dir).withColumnRenamed("isbn", "isbn13")
    return ingest.discovery(rows, _books(spark, sf_dir)).select("isbn", "pos", "action", "target_id")


def ag22_best_of_isbn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _arrivals(spark, sf_dir).withColumn("isbn13", F.right("isbn", F.lit(2)))
    return ingest.best_of_isbn(rows).select("isbn13", "pos")


def tk9_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.seeds(_arrivals(spark, sf_dir).withColumnRenamed("isbn", "isbn13"))


def prj3_book_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _books(spark, sf_dir).select("isbn", "title", "author", "publisher", F.col("cover_url").alias("cover"), "description", F.col("genre").alias("category_name"), F.col("book_id").alias("item_id"), "sales_point")
    return ingest.insertable(ingest.book_rows(rows).withColumn("created_at", F.lit(1)))


def prj5_onboarding(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.shelf(spark, sf_dir)
    fav = s.groupBy("user_id").agg(F.min("book_id").alias("favourite_id"))
    rows = ingest.onboarding_rows(s.join(fav, "user_id").select("user_id", "book_id", "favourite_id", F.col("emotion_tags").alias("tags")))
    return rows.withColumn("emotion_tags", F.array_join("emotion_tags", ","))


def prj8_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.when(F.col("user_id") % 5 == 0, "read").when(F.col("user_id") % 5 == 1, "want_to_read").when(F.col("user_id") % 5 == 2, "?").otherwise(F.col("status"))
    return views.shelf(spark, sf_dir).select("user_id", "book_id", T.status(old).alias("status"))


def prj9_search_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.search_authors(_books(spark, sf_dir), spark.createDataFrame([("한강",), ("김",), ("X",)], "author string"))


def prj10_vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.vector_rows(_books(spark, sf_dir), _genres(spark, sf_dir)).select("book_id", F.md5("source_text").alias("source_md5"), "source_tier", "l1_text", "l2_text", "l1_genre_id", "l2_genre_id")


def prj7_remap_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _books(spark, sf_dir).select("book_id", F.when(F.col("book_id") % 2 == 0, "kept").alias("l1_genre_id"), F.lit(None).cast("string").alias("l2_genre_id"))
    return ingest.remap_genres(old, _books(spark, sf_dir), _genres(spark, sf_dir))


def prj11_genre_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.genre_set(_books(spark, sf_dir))


def flt3_adult_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _books(spark, sf_dir).where(T.adult_general("addition_symbol")).select("book_id")


def snk4_update_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _books(spark, sf_dir).select("book_id", "loan_count", "loan_count_12mo", "loan_count_source")
    new = b.where("book_id % 5 = 0").select("book_id", (F.col("book_id") * 3).cast("int").alias("loan_count"), F.lit(None).cast("int").alias("loan_count_12mo"), F.lit("usage").alias("loan_count_source"))
    return ingest.update_columns(b, new, "book_id", ["loan_count", "loan_count_12mo", "loan_count_source"])


def snk9_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = CURSORS.frame(spark, sf_dir).withColumn("updated_at", F.date_sub(F.lit(views.TODAY).cast("date"), F.col("age")))
    return ingest.cursor_summary(ingest.cursor_states(c, F.lit(views.TODAY).cast("date")))


QUERIES = [
    src1_page, src2_next_keys, src5_changed, flt3_adult_general, flt10_users_to_embed, flt11_needs_vector, flt12_needs_scrape, flt13_needs_loan_count, flt14_needs_looks, flt19_pool, flt20_unreviewed, flt22_needs_tier2,
    flt23_needs_keywords, flt24_pending_vectors, flt25_pending_reasons, flt26_provisional, flt28_needs_genre, tk9_seeds, tk10_stale_counts, tk11_shelf_order, cu8_reembed_plan, dd3_series, dd4_ingest_actions, dd5_edition_duplicates,
    dd6_canonical_picks, dd8_rich_merge, dd9_repointed_shelf, dd10_shelf_writes, dd11_popular_titles, dd12_ingest_items, dd13_discovery, ag22_best_of_isbn, prj3_book_rows, prj5_onboarding, prj7_remap_genres, prj8_status,
    prj9_search_authors, prj10_vector_rows, prj11_genre_set, snk4_update_columns, snk9_cursors,
]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


_DISPLAY = X._spaces(X._chain(X._T, *T.DISPLAY_PAREN, *T.DISPLAY_TAIL))
_EDITION = X._spaces(X._chain(X._T, *X._editions(T.EDITION_WORDS)))
_CORE = f"trim({X._chain('edition', r'\s*[:：]\s*.+$', r'\s+[-—]\s+.+$')})"
_WRITER = f"trim(split_part({X._sub(X._A, r'\s*\([^)]*\)')}, ',', 1))"
_GENRE = f"case when trim({X._G}) <> '' then {X._BODY}[1] end as l1, case when trim({X._G}) <> '' and len({X._BODY}) >= 2 then array_to_string({X._BODY}[2:], ' ') end as l2"
_CLEAN = "trim(regexp_replace(coalesce({0}, ''), '<[^>]+>', '', 'g'))"
_META = "trim(concat_ws(' ', nullif(coalesce(title, ''), ''), nullif(coalesce(author, ''), ''), nullif(coalesce(genre, ''), '')))"
_SOURCE = f"""left(case when length({_CLEAN.format('rich_description')}) >= 200 then {_CLEAN.format('rich_description')} when {_CLEAN.format('description')} <> '' then {_CLEAN.format('description')} when {_META} <> '' then {_META} end, 2000) as source_text,
case when length({_CLEAN.format('rich_description')}) >= 200 then 'rich' when {_CLEAN.format('description')} <> '' then 'kakao_desc' when {_META} <> '' then 'minimal' end as tier"""
_ARRIVALS = "arrivals as (" + ARRIVALS.format(books="books") + ")"


def _keyed(name: str, rows: str, *more: str) -> str:
    """CTEs that add ingest's edition key (t, a) to rows."""
    return f"{name}_d as (select * replace ({_DISPLAY} as title) from {rows}), {name} as (select *, {X._spaces(X._INGEST)} as t, {_WRITER} as a from {name}_d)"


_ACTION = _keyed("kn", "books") + ", " + _keyed("nw", "arrivals") + """, best as (select t, a, max(coalesce(loan_count, 0)) as most, arg_min(book_id, {'x': -coalesce(loan_count, 0), 'y': book_id}) as id from kn group by 1, 2),
acted as (select nw.*, case when b.id is null or exists (select 1 from kn where kn.t = nw.t and kn.a = nw.a and kn.isbn = nw.isbn and kn.isbn <> '') then 'NEW' when coalesce(nw.loan_count, 0) > b.most then 'UPDATE_LOAN_COUNT' else 'SKIP' end as action, b.id
  from nw left join best b on b.t = nw.t and b.a = nw.a)"""
_TARGET = "case when action = 'UPDATE_LOAN_COUNT' then id end as target_id"


def _queue(where: str, by: str | None = None, limit: int | None = None) -> str:
    if by is None:
        return views.with_views("books") + f"select book_id from books where {where}"
    return views.with_views("books") + f"select book_id, cast(row_number() over (order by {by}) as integer) as place from books where {where}" + (f" order by {by} limit {limit}" if limit else "")


def oracle_sql() -> dict[str, str]:
    w = views.with_views
    genres = f"parsed as (select *, {_GENRE} from books), gs as (select distinct genre_text, level from (select l1 as genre_text, 'l1' as level from parsed union all select l2, 'l2' from parsed) where coalesce(genre_text, '') <> '')"
    vectors = genres + f""", g as (select genre_text, level, level || ':' || genre_text as genre_id from gs where length(genre_text) % 11 <> 0),
vr as (select book_id, source_text, tier as source_tier, p.l1 as l1_text, p.l2 as l2_text, a.genre_id as l1_genre_id, b.genre_id as l2_genre_id
  from (select *, {_SOURCE} from parsed) p left join g a on a.level = 'l1' and a.genre_text = p.l1 left join g b on b.level = 'l2' and b.genre_text = p.l2 where source_text is not null)"""
    series = "rows as (select *, trim(regexp_extract(edition, '(?:\\s*[:：]\\s*|\\s+[-—]\\s+)(.+)$', 1)) as s0, " + f"{_CORE} as core, {_WRITER} as writer from (select *, {_EDITION} as edition from books)), named as (select *, nullif(s0, '') as sub from rows where length(core) >= 2)"
    pattern = " or ".join(f"regexp_matches(sub, '{p}')" for p in T.SERIES_SUBTITLE)
    words = " or ".join(f"contains(lower(arg_min(title, book_id)), '{x}')" for x in T.SERIES_WORDS)
    rich = """least(length(coalesce(description, '')), 500) * 0.4 + case when coalesce(rich_description, '') <> '' then 100 else 0 end + least(coalesce(sales_point, 0) / 1000, 100.0) + case when coalesce(page_count, 0) > 0 then 30 else 0 end
+ case when len(mood_tags) > 0 then 30 else 0 end + case when len(library_keywords) > 0 then 30 else 0 end + case when len(dominant_colors) > 0 then 20 else 0 end"""
    return {
        "src1_page": w("books") + "select book_id, title from books where source = 'aladin' order by title, book_id limit 50 offset 20",
        "src2_next_keys": w("books") + "select book_id, title from books where book_id > 57 order by book_id limit 40",
        "src5_changed": w("books") + "select book_id, updated_at from books where updated_at > date '2024-06-01'",
        "flt3_adult_general": _queue("trim(addition_symbol) = '' or addition_symbol like '0%'"),
        "flt10_users_to_embed": w("shelf items") + """select user_id, coalesce(bool_or(rating in ('good', 'bad') and (book_id not in (select book_id from items) or ((len(emotion_tags) > 0 or coalesce(review_text, '') <> '') and book_id % 12 <> 0))), false) as needed from shelf group by 1""",
        "flt11_needs_vector": w("shelf") + "select user_id, book_id from shelf where (len(emotion_tags) > 0 or coalesce(review_text, '') <> '') and book_id % 12 <> 0",
        "flt12_needs_scrape": _queue("isbn is not null and coalesce(rich_description, '') = '' and not (coalesce(genre, '') like '%유아%' or coalesce(genre, '') like '%어린이%' or coalesce(genre, '') like '%만화%')", "sales_point desc nulls last, book_id"),
        "flt13_needs_loan_count": _queue("isbn is not null and loan_count_source is distinct from 'usage' and loan_count >= 30"),
        "flt14_needs_looks": _queue("coalesce(cover_url, '') <> '' and (dominant_colors is null or spine_font is null)"),
        "flt19_pool": w("books") + "select book_id, title from (select *, row_number() over (partition by trim(title) order by book_id) as k from books where coalesce(cover_url, '') <> '' and trim(title) <> '') where k = 1",
        "flt20_unreviewed": w("shelf books") + "select user_id, book_id from shelf where status = 'finished' and rating is null and book_id in (select book_id from books)",
        "flt22_needs_tier2": w("books") + """select b.book_id from books b left join (select book_id, case book_id % 6 when 0 then ['rich', 'library_keywords'] when 2 then ['rich'] end as src from books where book_id % 2 = 0 and book_id % 10 <> 0) e using (book_id)
where rich_description is not null and (e.book_id is null or (len(library_keywords) > 0 and not coalesce(list_contains(src, 'library_keywords'), false)))""",
        "flt23_needs_keywords": _queue("library_keywords is null and isbn is not null", "sales_point desc nulls last, book_id"),
        "flt24_pending_vectors": _queue("book_id % 3 = 0", "book_id", 40),
        "flt25_pending_reasons": w("books item_reasons") + "select book_id, cast(row_number() over (order by sales_point desc nulls last, book_id) as integer) as place from books where coalesce(rich_description, '') <> '' and book_id not in (select book_id from item_reasons)",
        "flt26_provisional": _queue("source_tier <> 'rich'"),
        "flt28_needs_genre": _queue("genre is null and isbn is not null", "loan_count desc nulls last, book_id"),
        "tk9_seeds": w("books", _ARRIVALS) + "select isbn as isbn13, cast(row_number() over (order by lc desc, pos) as integer) as rank from (select isbn, arg_min(pos, {'x': -coalesce(loan_count, 0), 'y': pos}) as pos, max(coalesce(loan_count, 0)) as lc from arrivals where coalesce(isbn, '') <> '' group by 1) order by lc desc, pos limit 50",
        "tk10_stale_counts": _queue("isbn is not null", "updated_at nulls first, book_id", 100),
        "tk11_shelf_order": w("shelf") + "select user_id, cast(place as integer) as place, book_id from (select *, row_number() over (partition by user_id order by case when book_id % 4 = 0 then book_id % 9 end nulls last, updated_at desc, book_id) as place from shelf) where place <= 20",
        "cu8_reembed_plan": w("books", f"src as (select *, case when book_id % 3 = 0 then source_text else title end as st, case when book_id % 10 <> 0 then source_text end as nt from (select *, {_SOURCE} from books))")
        + "select book_id, coalesce(nt, '') <> '' and tier is not null and nt is distinct from st as reembed, coalesce(nt, '') <> '' and tier is not null and tier is distinct from source_tier as update_tier, case when coalesce(nt, '') = '' or tier is null then source_tier else tier end as new_tier from src",
        "dd3_series": w("books", series, f"""subs as (select core, writer, count(*) as n, count(sub) as subs, count(distinct sub) as different, count(*) filter ({pattern}) as numbered, count(*) filter (length(sub) <= 10 and regexp_matches(sub, '^[가-힣\\s]+$')) as short, {words} as word from named group by 1, 2)""")
        + "select core, writer, n >= 2 and (coalesce(word, false) or (subs >= 2 and subs = different and (numbered >= subs * 0.5 or short = subs))) as series from subs",
        "dd4_ingest_actions": w("books", _ARRIVALS, _ACTION) + f"select pos, action, {_TARGET} from acted",
        "dd5_edition_duplicates": w("books", _ARRIVALS, _ACTION) + "select pos, action <> 'NEW' as duplicate from acted",
        "dd6_canonical_picks": w("books", f"g as (select *, {_CORE} as core, {_WRITER} as writer, {rich} as r from (select *, {_EDITION} as edition from books))")
        + "select core, writer, arg_min(book_id, {'x': -r, 'y': book_id}) as canonical_id, count(*) - 1 as others from g where length(core) >= 2 group by 1, 2 having count(*) > 1",
        "dd8_rich_merge": w("books", "o as (select isbn, title, author, loan_count, source from books where isbn is not null)", "n as (select isbn, coalesce(title, '') || '+' as title, loan_count - 5 + book_id % 11 as loan_count, case when book_id % 2 = 0 then 'data4library' else '' end as source from books where isbn is not null and book_id % 3 = 0)")
        + "select o.isbn, coalesce(n.title, o.title) as title, author, greatest(o.loan_count, n.loan_count) as loan_count, coalesce(nullif(n.source, ''), o.source) as source from o left join n using (isbn)",
        "dd9_repointed_shelf": w("books shelf", "bb as (select book_id, isbn, split_part(title, ' ', 1) as title, case when isbn is not null then source end as source, created_at from books)", """tw as (
  select y.book_id, x.book_id as twin_id, row_number() over (partition by y.book_id order by case x.source when 'aladin' then 0 when 'data4library' then 1 when 'kakao' then 2 else 3 end, x.created_at, x.book_id) as k
  from bb y join bb x on trim(x.title) = trim(y.title) where y.isbn is null and x.isbn is not null),
moved as (select s.user_id, coalesce(t.twin_id, s.book_id) as book_id, s.status, t.twin_id, row_number() over (partition by s.user_id, t.twin_id order by s.updated_at) as k
  from shelf s left join tw t on t.book_id = s.book_id and t.k = 1 where not exists (select 1 from shelf u where u.user_id = s.user_id and u.book_id = t.twin_id))""")
        + "select user_id, book_id, status from moved where twin_id is null or k = 1",
        "dd10_shelf_writes": w("books shelf", "ask as (select user_id, case when k % 9 <> 0 then k end as book_id, isbn, case when event_type in ('purchase', 'signup') then 'finished' else 'wishlist' end as status, event_id as pos from ev left join books on books.book_id = k)")
        + """select a.user_id, a.pos, case when a.book_id is not null then 'reuse_id' when coalesce(isbn, '') <> '' then 'upsert_by_isbn' else 'insert_new' end as book_ref,
case when s.status is null then 'insert_new' when a.status = 'wishlist' or a.status = s.status then 'keep_existing' else 'update_status' end as write from ask a left join shelf s on s.user_id = a.user_id and s.book_id = a.book_id""",
        "dd11_popular_titles": w("books") + """select cast(row_number() over (order by loan_count desc, book_id) as integer) as rank, book_id, loan_count from (select *, row_number() over (partition by case when trim(title) <> '' then trim(title) else '#' || book_id end order by loan_count desc, book_id) as k from books where loan_count is not null)
where k = 1 order by loan_count desc, book_id limit 30""",
        "dd12_ingest_items": w("books", _ARRIVALS, "part_of as (select * from books where book_id % 4 <> 0)", _keyed("kn", "part_of"), f"""staged as (select *, case when coalesce(isbn, '') = '' then 'no_isbn' when isbn in (select isbn from part_of where isbn is not null) then 'known' when {X._STOP} is not null then 'non_book' end as outcome from arrivals)""", _keyed("op", "(select * from staged where outcome is null)"), """fresh as (
  select * from op where not exists (select 1 from kn where kn.t = op.t and kn.a = op.a)),
once as (select * from fresh qualify row_number() over (partition by isbn order by pos) = 1), saved as (select pos from once qualify row_number() over (partition by t, a order by pos) = 1)""")
        + "select pos, coalesce(outcome, case when pos in (select pos from saved) then 'saved' else 'edition' end) as outcome from staged",
        "dd13_discovery": w("books", _ARRIVALS.replace("arrivals as", "arr as"), f"arrivals as (select * from arr where (trim(addition_symbol) = '' or addition_symbol like '0%') and {X._STOP} is null and coalesce(isbn, '') <> '' qualify row_number() over (partition by isbn order by coalesce(loan_count, 0) desc, pos) = 1)", _ACTION)
        + f"select isbn, pos, action, {_TARGET} from acted",
        "ag22_best_of_isbn": w("books", _ARRIVALS) + "select isbn13, pos from (select right(isbn, 2) as isbn13, pos, loan_count from arrivals) where coalesce(isbn13, '') <> '' qualify row_number() over (partition by isbn13 order by coalesce(loan_count, 0) desc, pos) = 1",
        "prj3_book_rows": w("books") + f"select isbn, {_DISPLAY} as title, coalesce(author, '') as author, coalesce(publisher, '') as publisher, coalesce(cover_url, '') as cover_url, coalesce(description, '') as description, coalesce(genre, '') as genre, 'aladin' as source, cast(book_id as varchar) as source_id, sales_point from books",
        "prj5_onboarding": w("shelf") + """select user_id, book_id, 'finished' as status, case when book_id = f then 'good' end as rating, case when book_id = f and len(emotion_tags) > 0 then array_to_string(emotion_tags, ',') end as emotion_tags
from (select *, min(book_id) over (partition by user_id) as f from shelf)""",
        "prj8_status": w("shelf") + "select user_id, book_id, case when user_id % 5 in (0, 2) then 'finished' when user_id % 5 = 1 then 'wishlist' else status end as status from shelf",
        "prj9_search_authors": w("books") + r"select distinct author from (select trim(unnest(string_split(regexp_replace(author, '\([^)]*\)', '', 'g'), ','))) as author from books union all select unnest(['한강', '김', 'X'])) where length(author) >= 2",
        "prj10_vector_rows": w("books", vectors) + "select book_id, md5(source_text) as source_md5, source_tier, l1_text, l2_text, l1_genre_id, l2_genre_id from vr",
        "prj7_remap_genres": w("books", vectors) + "select b.book_id, case when b.book_id % 2 = 0 then 'kept' else l1_genre_id end as l1_genre_id, l2_genre_id from books b left join vr using (book_id)",
        "prj11_genre_set": w("books", genres) + "select * from gs",
        "snk4_update_columns": w("books") + "select book_id, case when book_id % 5 = 0 then book_id * 3 else loan_count end as loan_count, loan_count_12mo, case when book_id % 5 = 0 then 'usage' else loan_count_source end as loan_count_source from books",
        "snk9_cursors": f"with {CURSORS.cte()} select source_type, count(*) as total, count(*) filter (completed and not (source_type <> 'item_list' and age > 30)) as completed, cast(sum(unique_items_saved) as bigint) as unique_saved from cursors group by 1",
    }
