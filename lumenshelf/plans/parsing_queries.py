"""Queries of captured responses and product pages, made of the part and page tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest
from ..sources import views
from .literals import Derived

#: Responses of the library's listing, one a part: two wrappings, blank and bad fields, and none at all.
BOOKS = Derived("book_responses", "part", """select p_partkey as id, case when p_partkey % 17 = 0 then null when p_partkey % 19 = 0 then '{{}}' when p_partkey % 13 = 0 then '{{"response": {{"docs": []}}}}'
  else concat('{{"response": {{"docs": [{{"doc": {{"isbn13": "978', cast(p_partkey as varchar(20)), '", "bookname": " ', p_name, '   x ", "authors": "', p_brand, '", "publisher": "', case when p_partkey % 4 = 0 then '' else p_brand end,
    '", "publication_year": "', case when p_partkey % 5 = 0 then ' ' else '1998' end, '", "addition_symbol": "0', cast(p_partkey % 10 as varchar(20)), '", "class_no": "843", "bookImageURL": "http://c/1", "loan_count": "', case when p_partkey % 7 = 0 then 'many' else cast(p_size as varchar(20)) end,
    '"}}}}, {{"book": {{"isbn13": " ', cast(p_partkey as varchar(20)), ' ", "bookname": "', p_type, '", "loan_count": "7"}}}}, {{"doc": {{"isbn13": "", "bookname": "none"}}}}]}}}}') end as body
from {source}""")
#: Responses of the library's usage service.
USAGE = Derived("usage_responses", "part", """select p_partkey as id, case when p_partkey % 11 = 0 then null when p_partkey % 7 = 0 then '{{"response": {{"book": {{"loanCnt": "0"}}}}}}'
  else concat('{{"response": {{"book": {{"loanCnt": "', cast(p_size * 3 as varchar(20)), '"}}, "loanHistory": [{{"loan": {{"loanCnt": "', cast(p_size as varchar(20)), '"}}}}, {{"loan": {{"loanCnt": "x"}}}}, {{"loan": {{"loanCnt": "4"}}}}], "keywords": [{{"keyword": {{"word": "', split_part(p_name, ' ', 1),
    '", "weight": "2.5"}}}}, {{"keyword": {{"word": ""}}}}, {{"keyword": {{"word": "', p_type, '", "weight": "1"}}}}, {{"keyword": {{"word": "', split_part(p_name, ' ', 2), '", "weight": "', cast(p_size as varchar(20)), '"}}}}, {{"keyword": {{"word": "', split_part(p_name, ' ', 1), '", "weight": "bad"}}}}, {{"keyword": {{"word": "x"}}}}], "coLoanBooks": [',
    case when p_partkey % 3 = 0 then '' else concat('{{"book": {{"isbn13": "', cast(p_partkey + 1 as varchar(20)), '"}}}}, {{"book": {{"isbn13": ""}}}}, {{"book": {{"isbn13": "', cast(p_partkey + 2 as varchar(20)), '"}}}}') end, ']}}}}') end as body
from {source}""")


def src13_book_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.book_docs(BOOKS.frame(spark, sf_dir), "body")


def src14_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = ingest.usage(USAGE.frame(spark, sf_dir), "body")
    return u.withColumns({"library_keywords": F.array_join("library_keywords", ","), "co_loan_isbns": F.array_join("co_loan_isbns", ",")})


def src15_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.monthly_keywords(USAGE.frame(spark, sf_dir), "body")


def flt15_single_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.single_tokens(ingest.monthly_keywords(USAGE.frame(spark, sf_dir), "body"), ["id"])


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page table, each page with the JSON-LD block and sections of a product."""
    p = views.table(spark, sf_dir, "pages")
    n = F.col("page_id")
    author = F.when(n % 3 == 0, F.lit('{"name": "조지 오웰"}')).when(n % 3 == 1, F.lit('[{"name": "한강"}]')).otherwise(F.lit("null"))
    ld = F.concat(F.lit('<script type="application/ld+json">{"name": "책 '), n.cast("string"), F.lit('", "author": '), author, F.lit(', "isbn": "'), n.cast("string"), F.lit('"}</script>'))
    body = F.concat(F.lit('<div id="infoset_introduce"><b>책소개</b><p>'), F.lit("소개 글 "), n.cast("string"), F.lit('</p></div><div id="infoset_inBook">짧다</div>'))
    return p.select("page_id", F.concat(F.col("html"), F.when(n % 5 != 4, ld).otherwise(F.lit("")), body).alias("html"))


def src10_page_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC10 and JS3: title, author, ISBN and sections of every page."""
    return _pages(spark, sf_dir).select("page_id", *(c.alias(n) for n, c in ingest.page_data("html").items()))


def dd14_match_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of each wanted book among its five search results."""
    b = views.books(spark, sf_dir).where("isbn is not null and book_id % 5 = 0")
    n = F.col("book_id")
    found = b.select("book_id", F.explode(F.array(*map(F.lit, range(5)))).alias("pos"), "isbn", "title", "author").withColumn("page_id", n * 10 + F.col("pos"))
    pages = found.select(
        "book_id", "pos", "page_id", F.when((n % 2 == 0) & (F.col("pos") == n % 5 + 1), F.col("isbn")).otherwise(F.lit("0000000000000")).alias("isbn"),
        F.when(F.col("pos") >= n % 4, F.col("title")).otherwise(F.lit("other")).alias("title"), F.when(n % 3 != 0, F.col("author")).otherwise(F.lit("nobody else")).alias("author"),
    )
    return ingest.match_pages(pages, b)


QUERIES = [src13_book_docs, src14_usage, src15_keywords, flt15_single_tokens, src10_page_data, dd14_match_pages]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    kw = f"with {USAGE.cte()}, k as (select id, cast(unnest(range(len(from_json(json_extract(body, '$.response.keywords'), '[\"json\"]')))) as integer) as pos, unnest(from_json(json_extract(body, '$.response.keywords'), '[\"json\"]')) as j from usage_responses), w as (select id, pos, json_extract_string(j, '$.keyword.word') as word, coalesce(try_cast(json_extract_string(j, '$.keyword.weight') as double), 0) as weight from k) "
    return {
        "src13_book_docs": f"with {BOOKS.cte()}, d as (select id, unnest(from_json(json_extract(body, '$.response.docs'), '[\"json\"]')) as j from book_responses), b as (select id, coalesce(json_extract(j, '$.doc'), json_extract(j, '$.book')) as b from d) "
        + r"""select id, trim(b->>'isbn13') as isbn13, trim(regexp_replace(coalesce(b->>'bookname', ''), '\s+', ' ', 'g')) as title, trim(coalesce(b->>'authors', '')) as author_raw, nullif(trim(b->>'publisher'), '') as publisher, nullif(trim(b->>'publication_year'), '') as publication_year, trim(coalesce(b->>'addition_symbol', '')) as addition_symbol,
nullif(trim(b->>'class_no'), '') as kdc, nullif(trim(b->>'bookImageURL'), '') as cover_url, coalesce(try_cast(b->>'loan_count' as integer), 0) as loan_count from b where coalesce(trim(b->>'isbn13'), '') <> ''""",
        "src14_usage": f"with {USAGE.cte()}, u as (select id, coalesce(try_cast(json_extract_string(body, '$.response.book.loanCnt') as integer), 0) as loan_count, "
        + """coalesce(list_sum(list_transform(from_json(json_extract(body, '$.response.loanHistory'), '["json"]'), lambda j: coalesce(try_cast(json_extract_string(j, '$.loan.loanCnt') as integer), 0))), 0) as months,
array_to_string(list_filter(list_transform(coalesce(from_json(json_extract(body, '$.response.keywords'), '["json"]'), []), lambda j: json_extract_string(j, '$.keyword.word')), lambda x: coalesce(x, '') <> ''), ',') as words,
array_to_string(list_filter(list_transform(coalesce(from_json(json_extract(body, '$.response.coLoanBooks'), '["json"]'), []), lambda j: json_extract_string(j, '$.book.isbn13')), lambda x: coalesce(x, '') <> '')[:50], ',') as isbns from usage_responses)
select id, loan_count, cast(months as integer) as loan_count_12mo, words as library_keywords, isbns as co_loan_isbns, loan_count = 0 and months = 0 and words = '' and isbns = '' as is_empty from u""",
        "src15_keywords": kw + "select id, pos, word, weight from w where coalesce(word, '') <> ''",
        "flt15_single_tokens": kw + "select id, pos, word, weight from w where length(word) >= 2 and not contains(word, ' ') qualify row_number() over (partition by id, word order by pos) = 1",
        "src10_page_data": """select page_id, case when page_id % 5 <> 4 then '책 ' || page_id end as title, case when page_id % 5 <> 4 then case page_id % 3 when 0 then '조지 오웰' when 1 then '한강' end end as author, case when page_id % 5 <> 4 then cast(page_id as varchar) end as isbn,
'소개 글 ' || page_id as intro, cast(null as varchar) as review, cast(null as varchar) as excerpt from pages""",
    }
