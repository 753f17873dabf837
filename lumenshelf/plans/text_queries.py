"""Queries of the text normalisers and filters, over literal titles and the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import views
from .literals import Derived, Literal

TITLES = Literal(
    "titles",
    "id long, title string, author string, genre string, description string, isbn string",
    [
        (-1, "동물농장", "조지 오웰 (지은이), 도정일 (옮긴이)", "국내도서>소설>영미소설", "고전 소설", "9788937460050"),
        (-2, "동물농장 (양장)", "조지 오웰", "국내도서> 소설 > 영미소설 > 고전", "", "9788937460051"),
        (-3, "동물농장 [세트]", "조지 오웰 지음", "eBook>소설", None, "K123"),
        (-4, "1984 (오리지널 초판본 표지 디자인)", "조지 오웰", "소설", "시와 에세이", "8937460050"),
        (-5, "해리 포터: 비밀의 방", "J.K. 롤링", "외국도서", "판타지", None),
        (-6, "스티커북 : 동물", "편집부", "국내도서>유아학습", "동화", ""),
        (-7, "명상록 - 천년의 고전", "마르쿠스 아우렐리우스", None, "역사", "9788937460059"),
        (-8, "코스모스：가능한 세계들", "요한 하리 지음", "국내도서>과학>천문", "SF 과학", "9788937460058"),
        (-9, "큰글자책 소년이 온다 (2014)", "한강", "국내도서>소설/시/희곡>한국소설", "", None),
        (-10, "토익 기출 500", "지은이: 유발 하라리 ;옮긴이: 조현욱", "국내도서>수험서", "", "1"),
        (-11, "파친코 1 - 전2권 세트", "이민진 (지은이)", "국내도서>만화", "", "2"),
        (-12, "", "애거서 크리스티 (지은이), 공경희 (옮긴이)", "", "", "3"),
        (-13, None, None, None, None, None),
        (-14, "여름 (한정판) - 포토카드 증정, 완결", "글: 김애란", "국내도서>웹툰>로맨스", "힐링 여행", "4"),
        (-15, "A - B ( ) c", "  한강  ", "국내도서>컴퓨터/IT > 프로그래밍", "IT", "5"),
    ],
)
CATALOGUE = "book_id as id, title, author, genre, cast(null as varchar) as description, cast(null as varchar) as isbn"


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = views.items(spark, sf_dir)
    null = F.lit(None).cast("string")
    return TITLES.frame(spark).unionByName(i.select(F.col("book_id").alias("id"), "title", "author", "genre", null.alias("description"), null.alias("isbn")))


def _sub(x: str, p: str, flags: str = "g") -> str:
    return f"regexp_replace({x}, '{p}', '', '{flags}')"


def _chain(x: str, *patterns: str) -> str:
    for p in patterns:
        x = _sub(x, p)
    return x


def _spaces(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


_T, _A, _G, _D = "coalesce(title, '')", "coalesce(author, '')", "coalesce(genre, '')", "coalesce(description, '')"
_WORK_T = f"lower({_sub(f'''split_part({_sub(_T, '[(\\[].*?[)\\]]')}, ':', 1)''', '\\s+')})"
_WORK_A = f"lower({_chain(f'''split_part({_A}, ',', 1)''', '[(\\[].*?[)\\]]', '\\s+')})"


def _editions(words: str) -> list[str]:
    return [rf"(?i)\s*\(.*?(?:{words}).*?\)", r"\s*\(\d{4}\)", r"\s*\(\s*\)"]


def _cut_if_long(x: str, p: str) -> str:
    return f"case when length(trim({_sub(x, p)})) > 3 then {_sub(x, p)} else {x} end"


_INGEST = _chain(_T, "(?i)" + T.FORMAT_PREFIX, *_editions(f"{T.EDITION_WORDS}|{T.FORMAT_WORDS}"))
_INGEST = _cut_if_long(_cut_if_long(_INGEST, r"\s*[:：]\s*.+$"), r"\s+[-—]\s+.+$")
_PRIMARY = f"nullif(trim({_chain('''split_part(author, ',', 1)''', r'\s*\([^)]*\)', rf'\s+({T.PRIMARY_ROLES})\s*$')}), '')"
_PARTS = f"list_transform(string_split({_G}, '>'), lambda p: trim(p))"
_BODY = f"(case when {_PARTS}[1] in ('국내도서', '외국도서', 'eBook') then {_PARTS}[2:] else {_PARTS} end)"
_FONT_TEXT = f"lower({_G} || ' ' || {_D})"
_FONT = "case " + " ".join("when " + " or ".join(f"contains({_FONT_TEXT}, '{k}')" for k in keys) + f" then '{name}'" for name, keys in T.FONTS.items()) + f" else '{T.DEFAULT_FONT}' end"
_STOP = "coalesce(" + ", ".join([f"case when contains({_T}, '{k}') then '{k}' end" for k in T.TITLE_STOP_WORDS] + [f"case when contains({_G}, '{k}') then '{k}' end" for k in T.GENRE_STOP_WORDS]) + ")"
_LAST = f"ascii(right({_T}, 1))"
_CLOSED = f"({_T} <> '' and unicode(right({_T}, 1)) between 44032 and 55203 and (unicode(right({_T}, 1)) - 44032) % 28 <> 0)"

#: name: ({column: expression}, {column: SQL}); each runs over all titles.
SCALARS: dict[str, tuple[dict, dict | None]] = {
    "str1_work_key": ({"key": T.work_key}, {"key": f"case when {_WORK_T} <> '' then {_WORK_T} || '|' || {_WORK_A} end"}),
    "str2_display_title": ({"title": lambda t, a: T.display_title(t)}, {"title": _spaces(_chain(_T, *T.DISPLAY_PAREN, *T.DISPLAY_TAIL))}),
    "str3_edition_title": ({"title": lambda t, a: T.edition_title(t)}, {"title": _spaces(_chain(_T, *_editions(T.EDITION_WORDS)))}),
    "str4_core_title": ({"title": lambda t, a: T.core_title(t)}, {"title": f"trim({_chain(_T, r'\s*[:：]\s*.+$', r'\s+[-—]\s+.+$')})"}),
    "str5_plain_author": ({"author": lambda t, a: T.plain_author(a)}, {"author": f"trim(split_part({_sub(_A, r'\s*\([^)]*\)')}, ',', 1))"}),
    "str6_ingest_title": ({"title": lambda t, a: T.ingest_title(t)}, {"title": _spaces(_INGEST)}),
    "str7_primary_author": ({"author": lambda t, a: T.primary_author(a)}, {"author": _PRIMARY}),
    "str8_catalogue_author": ({"author": lambda t, a: T.catalogue_author(a)}, {"author": _spaces(f"regexp_split_to_array({_sub(_A, r'^(지은이|저자|글|원작)\s*[:：]\s*')}, '[;,]')[1]")}),
    "str9_match_title": ({"title": lambda t, a: T.match_title(t)}, None),
    "str10_search_query": ({"query": T.search_query}, None),
    "str11_author_matches": ({"same": lambda t, a: T.author_matches(F.lit("조지 오웰"), a), "rowling": lambda t, a: T.author_matches(F.lit("조앤 K. 롤링"), a)}, None),
    "str12_isbn_rules": (
        {"odd": lambda t, a: T.non_standard_isbn("isbn"), "same": lambda t, a: T.isbn_matches(F.lit("9788937460050"), "isbn")},
        {"odd": "coalesce(isbn, '') = '' or isbn like 'K%' or length(isbn) < 10",
         "same": "coalesce(isbn, '') <> '' and isbn not like 'K%' and length(isbn) >= 10 and case when length(isbn) >= 13 then right(isbn, 13) = '9788937460050' else right(isbn, 10) = '8937460050' end"},
    ),
    "str14_parse_genre": (
        {"l1": lambda t, a: T.parse_genre("genre")[0], "l2": lambda t, a: T.parse_genre("genre")[1]},
        {"l1": f"case when trim({_G}) <> '' then {_BODY}[1] end", "l2": f"case when trim({_G}) <> '' and len({_BODY}) >= 2 then array_to_string({_BODY}[2:], ' ') end"},
    ),
    "str15_first_genre": ({"l1": lambda t, a: F.coalesce(T.parse_genre("genre")[0], F.lit("?"))}, {"l1": f"coalesce(case when trim({_G}) <> '' then {_BODY}[1] end, '?')"}),
    "str21_particle": ({"p": lambda t, a: T.particle(t, "과", "와")}, {"p": f"case when {_CLOSED} then '과' else '와' end"}),
    "str22_section_title": (
        {"heading": lambda t, a: T.similar_title(t), "cta": lambda t, a: T.call_to_action("_tier", "_likes")},
        {"heading": f"'『' || {_T} || '』' || case when {_CLOSED} then '과' else '와' end || ' 비슷한 책'",
         "cta": "case abs(id) % 3 when 0 then '좋아요 ' || (3 - abs(id) % 3) || '권 더 누르면 비슷한 책 추천이 시작돼요' when 1 then '좋아요 ' || (6 - abs(id) % 3) || '권 더 평가하면 취향 추천이 시작돼요' end"},
    ),
    "str23_font": ({"font": lambda t, a: T.font("genre", "description")}, {"font": _FONT}),
    "str27_short_title": ({"title": lambda t, a: T.short_title(t)}, {"title": f"lower({_chain(f'''regexp_split_to_array({_sub(_T, '[(（][^)）]*[)）]')}, '[:\\-–—]')[1]''', '(제?\\d+권?)', '\\s+')})"}),
    "str29_collapse_spaces": ({"title": lambda t, a: T.collapse_spaces(t)}, {"title": _spaces(_T)}),
    "flt1_non_book": ({"drop": lambda t, a: T.non_book(t, F.col("genre"))}, {"drop": f"{_STOP} is not null"}),
    "flt2_non_book_word": ({"word": lambda t, a: T.non_book_word(t, F.col("genre"))}, {"word": _STOP}),
    "prj1_generated_genre": (
        {"l1": lambda t, a: T.split_genre("genre")[0], "l2": lambda t, a: T.split_genre("genre")[1]},
        {"l1": "case when strpos(genre, '>') = 0 then genre else split_part(genre, '>', 1) end", "l2": "nullif(split_part(genre, '>', 2), '')"},
    ),
}


def _scalar(exprs: dict):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = catalogue(spark, sf_dir).withColumns({"_tier": (F.abs("id") % 3).cast("int"), "_likes": (F.abs("id") % 3).cast("int")})
        return rows.select("id", *(e(F.col("title"), F.col("author")).alias(c) for c, e in exprs.items()))

    return run


def _scalar_sql(exprs: dict) -> str:
    columns = ", ".join(f"{e} as {c}" for c, e in exprs.items())
    return views.with_views("items", TITLES.cte(), f"catalogue as (select * from titles union all select {CATALOGUE} from items)") + f"select id, {columns} from catalogue"


#: Source texts with sections, tags and addresses, made of the documents.
TEXTS = Derived("texts", "documents", """select doc_id as id,
  case doc_id % 5 when 0 then concat('[책소개]', chr(10), left(text, 200), chr(10), '★ 광고', chr(10), 'MD 한마디', chr(10), '지움', chr(10), chr(10), '남는 줄 ', substr(text, 200, 100), chr(10), '미리보기 보기', chr(10), chr(10), '[출판사리뷰]', chr(10), '리뷰', chr(10), chr(10), '[책속으로]', chr(10), substr(text, 300, 500))
    when 1 then null when 2 then concat('<p>', text, '</p>') when 3 then '' else concat('[책속으로]', chr(10), '펼쳐보기', chr(10), left(text, cast(doc_id % 9 as int))) end as rich,
  case doc_id % 4 when 0 then concat('<b>', left(text, 30), '</b> ', substr(text, 31, 100), ' ', chr(39), '두 글자', chr(39)) when 1 then left(text, 120) when 2 then '' end as description,
  case when doc_id % 6 <> 5 then concat('제목 ', left(text, 12)) end as title, case when doc_id % 7 <> 0 then source end as author, case when doc_id % 3 <> 0 then lang else '' end as genre,
  case doc_id % 4 when 0 then split('감동, ', ',') when 1 then split('성장,위로', ',') when 2 then split(' ', ',') end as tags, case when doc_id % 5 <> 1 then concat(' ', substr(text, 5, cast(doc_id % 20 as int)), ' ') end as review,
  case doc_id % 4 when 0 then concat('https://t1.kakaocdn.net/thumb?fname=http%3A%2F%2Fx.y%2F', cast(doc_id as varchar(20)), '.jpg&w=1') when 1 then 'http://a.b/c.jpg' when 2 then 'https://k.kakaocdn.net/x?w=1' end as url,
  case when doc_id % 3 = 0 then split(concat(lang, ',', source), ',') end as keywords
from {source}""")


def str13_clean_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.table(spark, sf_dir, "pages")
    return pages.select(F.col("page_id").alias("id"), F.length(T.clean_html("html")).alias("n"), F.md5(T.clean_html("html").cast("binary")).alias("h"))


def str16_str17_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TEXTS.frame(spark, sf_dir).select("id", T.section("rich", "책소개").alias("raw"), T.clean_intro(T.section("rich", "책소개")).alias("intro"), T.section("rich", "책속으로").alias("quote"), T.section("rich", "목차").alias("unknown"))


def str18_source_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, sources = T.rich_source("title", "author", "genre", "description", "rich", "keywords")
    return TEXTS.frame(spark, sf_dir).select("id", T.basic_source("title", "author", "genre", "description").alias("basic"), text.alias("full"), F.array_join(sources, ",").alias("sources"))


def str19_source_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, tier = T.source_choice("rich", "description", "title", "author", "genre")
    return TEXTS.frame(spark, sf_dir).select("id", text.alias("text"), tier.alias("tier"))


def str20_feedback_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TEXTS.frame(spark, sf_dir).select("id", T.feedback_text("tags", "review").alias("text"))


def str24_full_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TEXTS.frame(spark, sf_dir).select("id", T.full_cover("url").alias("cover"))


def str25_key_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TEXTS.frame(spark, sf_dir).select("id", F.array_join(T.key_terms("description"), "|").alias("terms"))


def str26_section_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TEXTS.frame(spark, sf_dir).select("id", T.section_lines("rich").alias("body"))


def str28_scrub_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.table(spark, sf_dir, "pages")
    return pages.select("page_id", T.scrub_key(F.concat(F.col("url"), F.lit("?authKey=s3cret&x=1"))).alias("url"))


_CLEAN = "regexp_replace(coalesce({}, ''), '<[^>]+>', '', 'g')"
_RICH, _DESC = "trim(" + _CLEAN.format("rich") + ")", "trim(" + _CLEAN.format("description") + ")"
_META = "trim(concat_ws(' ', nullif(title, ''), nullif(author, ''), nullif(genre, '')))"
_TAGS = "list_filter(coalesce(tags, []), lambda x: trim(x) <> '')"


def queries() -> dict:
    found = {name: _scalar(exprs) for name, (exprs, _) in SCALARS.items()}
    return found | {f.__name__: f for f in (str13_clean_html, str16_str17_sections, str18_source_texts, str19_source_choice, str20_feedback_text, str24_full_cover, str25_key_terms, str26_section_lines, str28_scrub_key)}


_LABELS = [("제목", "title"), ("저자", "author"), ("장르", "genre"), ("내용", "description")]


def _section(name: str) -> str:
    others = "|".join(x for x in T.SECTIONS if x != name)
    return f"regexp_replace(regexp_replace(regexp_extract(coalesce(rich, ''), '(?s)\\[{name}\\](.*)$', 1), '(?s)\\[(?:{others})\\].*$', ''), '^\\s+|\\s+$', '', 'g')"


def _introductions() -> str:
    """CTEs that give each text's introduction (raw, intro) and quotation: a line is skipped after an editor's block until a blank line."""
    return TEXTS.cte() + f""", cut as (select *, {_section('책소개')} as raw, {_section('책속으로')} as quote from texts),
lines as (select id, unnest(string_split(raw, chr(10))) as line, generate_subscripts(string_split(raw, chr(10)), 1) as i from cut),
kinds as (select *, trim(line) as s, trim(line) like '★%' as star, trim(line) like 'MD 한마디%' or trim(line) like 'MD한마디%' as block from lines),
marks as (select *, max(case when block and not star then i end) over w as opened, max(case when s = '' then i end) over w as blank from kinds window w as (partition by id order by i rows between unbounded preceding and 1 preceding)),
told as (select id, string_agg(line, chr(10) order by i) as body from marks where not star and not block and not contains(s, '미리보기') and (opened is null or coalesce(blank, 0) > opened) group by id),
intros as (select cut.*, regexp_replace(coalesce(body, ''), '^\\s+|\\s+$', '', 'g') as intro from cut left join told using (id))"""


def _labelled(label: str, column: str) -> str:
    return f"case when coalesce({column}, '') <> '' then '{label}: ' || {column} end"


def oracle_sql() -> dict[str, str]:
    found = {name: _scalar_sql(sql) for name, (_, sql) in SCALARS.items() if sql}
    texts = "with " + TEXTS.cte() + "\n"
    return found | {
        "str13_clean_html": "select page_id as id, length(t) as n, md5(t) as h from (select page_id, " + _CLEAN.format("html") + " as t from pages)",
        "str19_source_choice": texts + f"select id, left(case when length({_RICH}) >= 200 then {_RICH} when {_DESC} <> '' then {_DESC} when {_META} <> '' then {_META} end, 2000) as text, "
        f"case when length({_RICH}) >= 200 then 'rich' when {_DESC} <> '' then 'kakao_desc' when {_META} <> '' then 'minimal' end as tier from texts",
        "str20_feedback_text": texts + f"select id, nullif(concat_ws(chr(10), case when len({_TAGS}) > 0 then '태그: ' || array_to_string({_TAGS}, ', ') end, nullif(trim(coalesce(review, '')), '')), '') as text from texts",
        "str16_str17_sections": "with " + _introductions() + " select id, raw, intro, quote, '' as unknown from intros",
        "str18_source_texts": "with " + _introductions() + f""" select id, concat_ws(chr(10), {', '.join(_labelled(a, b) for a, b in _LABELS)}) as basic,
case when intro <> '' then left(concat_ws(chr(10), {', '.join(_labelled(a, b) for a, b in _LABELS)}, '책소개: ' || intro, case when quote <> '' then '발췌: ' || left(quote, 300) end, case when len(keywords) > 0 then '키워드: ' || array_to_string(keywords, ', ') end), 15000) else '' end as full,
case when intro <> '' then concat_ws(',', 'aladin', 'yes24_intro', case when quote <> '' then 'yes24_excerpt' end, case when len(keywords) > 0 then 'library_keywords' end) else '' end as sources from intros""",
        "str24_full_cover": texts + r"select id, case when contains(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), 'kakaocdn') then coalesce(nullif(url_decode(regexp_extract(url, '[?&]fname=([^&#]*)', 1)), ''), url) else url end as cover from texts",
        "str25_key_terms": "with " + TEXTS.cte() + r""", b as (select id, list_filter(list_transform(flatten(list_transform(regexp_extract_all(coalesce(description, ''), '(?s)<[Bb]>(.*?)</[Bb]>', 1), lambda x: regexp_split_to_array(trim(regexp_replace(x, '<[^>]+>', ' ', 'g')), '\s{2,}'))), lambda x: trim(x)), lambda x: length(x) between 2 and 80) as bold,
list_filter(regexp_extract_all(regexp_replace(coalesce(description, ''), '<[^>]+>', '', 'g'), '[''‘’]([^''‘’]+)[''‘’]', 1), lambda x: length(x) between 2 and 50) as quoted from texts),
t as (select id, list_concat(bold, quoted) as l from b) select id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') as terms from t""",
        "str26_section_lines": "with " + TEXTS.cte() + ", k as (select id, regexp_replace(array_to_string(list_filter(string_split(coalesce(rich, ''), chr(10)), lambda x: trim(x) not in (" + ", ".join(f"'{x}'" for x in T.UI_NOISE) + r")), chr(10)), '^\s+|\s+$', '', 'g') as body from texts) select id, case when length(body) > 5 then body end as body from k",
        "str28_scrub_key": r"select page_id, regexp_replace(url || '?authKey=s3cret&x=1', '(authKey=)[^&\s]+', '\1***', 'g') as url from pages",
    }
