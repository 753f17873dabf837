"""Title, author, genre and source-text normalisers of the catalogue.

Several normalisers differ on purpose: each stage compares titles by rules of
its own, and they are not interchangeable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------

TITLE_STOP_WORDS = [
    "토익", "토플", "TOEIC", "TOEFL", "IELTS",
    "기출문제", "모의고사", "기출 500",
    "한국사능력검정", "GSAT", "공무원",
    "수능", "EBS", "내신",
    "기출", "워크북", "실기", "필기",
    "교과서", "참고서", "학습지", "문제집", "문제풀이",
    "족보", "적중예상", "기본서",
    "드릴북", "연습장", "따라쓰기", "붙임딱지",
    "컬러링북", "다이어리", "플래너", "스케줄러",
    "악보", "기타 코드",
]
GENRE_STOP_WORDS = [
    "수험", "문제집", "자격증", "검정시험",
    "대학입시", "공무원", "취업/수험서",
    "초등참고서", "중학참고서", "고등참고서",
    "유아학습", "어린이학습", "학습만화",
    "달력/기타", "잡지", "다이어리/팬시",
    "만화", "코믹", "comic", "웹툰",
]
DISPLAY_PAREN = [
    r"\(.*?(?:특별판|에디션|한정판|리커버|양장|무선|문고판|기념|보너스|수록|클래식|개정판|완결|특전).*?\)",
    r"\(리딩\)",
    r"\(리스닝\)",
    r"\(보카\)",
]
DISPLAY_TAIL = [
    r"\s*-\s*SL Comic.*$",
    r"\s*-\s*S코믹스.*$",
    r"\s*-\s*전\d+권.*$",
    r"\s*-\s*.*(?:카드|스탠드|소책자|북마크|띠지|포스터|포토|스티커|티켓|엽서|pp|수록|독점|강의|MP3|PDF|해설|기출|시험 대비).*$",
    r"\s*\+앱.*$",
    r",\s*완결\s*$",
]
EDITION_WORDS = "판|에디션|리커버|양장|무선|문고|기념|보너스|수록|클래식|개정|완결|특전|리마스터|초판|복간|표지|디자인|일러스트|컬러|블랙|화이트|골드|실버|미니|빅|대형|포켓|뉴|신판|증보|축약|완역|전면|번역|역|합본|세트"
FORMAT_WORDS = r"큰글자|큰\s*글자|eBook|ebook"
FORMAT_PREFIX = r"^(?:큰\s*글자(?:책)?|큰글자(?:책)?|eBook|ebook|E-?book)\s*"
SERIES_WORDS = ["스티커북", "스티커", "색칠", "컬러링", "워크북", "학습지", "세트", "전집", "시리즈", "그림책", "놀이북", "활동북", "나의 첫", "토미", "톰토미"]
SERIES_SUBTITLE = [r"^\s*\d+권?$", r"^\s*(?:vol|Vol|VOL)\.?\s*\d+", r"^\s*(?:제?\d+\s*(?:권|편|부|장|화|탄))$", r"^\s*[가-힣]{1,6}\s*$"]
MATCH_SPLIT = r"\s+[:=-][\s]?|(?<=[가-힣]):(?=[가-힣])|[=/]"
MATCH_ROLES = "지음|옮김|그림|글|엮음|원작|지은이|옮긴이"
PAGE_ROLES = MATCH_ROLES + "|저|역|편|편저|감수"
PRIMARY_ROLES = "지음|옮김|엮음|글|그림"
GENRE_PREFIXES = ["국내도서", "외국도서", "eBook"]
SECTIONS = ["책소개", "출판사리뷰", "책속으로"]
UI_NOISE = ["책소개", "출판사 리뷰", "책 속으로", "접기", "펼쳐보기", "더보기"]
FONTS = {
    "Nanum Myeongjo": ["문학", "소설", "고전", "순수문학"],
    "Noto Serif KR": ["역사", "논픽션", "사회", "전쟁"],
    "Black Han Sans": ["스릴러", "추리", "범죄", "사회고발"],
    "Gowun Batang": ["시", "에세이", "산문", "수필"],
    "Do Hyeon": ["SF", "IT", "과학", "현대"],
    "Jua": ["힐링", "일상", "가족", "요리", "여행"],
    "Gaegu": ["판타지", "동화", "청소년", "만화"],
}
DEFAULT_FONT = "Pretendard"
GENERIC_REASON_WORDS = ["성장", "감동", "몰입감", "흡입력", "걸작", "수작", "재미", "감성", "힐링", "위로", "공감", "소장"]

# ----------------------------------------------------------------------------


def _s(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _drop(c: Column, *patterns: str) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, p, ""), patterns, c)


def collapse_spaces(c: Column | str) -> Column:
    """Runs of white space become one space, ends are trimmed; null is empty."""
    return F.trim(F.regexp_replace(_s(c), r"\s+", " "))


def work_key(title: Column | str, author: Column | str) -> Column:
    """One key for all editions of a work; null where the title is empty."""
    bracketed, space = r"[\(\[].*?[\)\]]", r"\s+"
    t = F.lower(_drop(F.split_part(_drop(_s(title), bracketed), F.lit(":"), F.lit(1)), space))
    a = F.lower(_drop(F.split_part(_s(author), F.lit(","), F.lit(1)), bracketed, space))
    return F.when(t != "", F.concat(t, F.lit("|"), a))


def display_title(title: Column | str) -> Column:
    """Title without edition notes and goods lists; the subtitle stays."""
    return collapse_spaces(_drop(_s(title), *DISPLAY_PAREN, *DISPLAY_TAIL))


def _editions(words: str) -> list[str]:
    return [rf"(?i)\s*\(.*?(?:{words}).*?\)", r"\s*\(\d{4}\)", r"\s*\(\s*\)"]


def edition_title(title: Column | str) -> Column:
    """Title without edition parentheses and years."""
    return collapse_spaces(_drop(_s(title), *_editions(EDITION_WORDS)))


def core_title(title: Column | str) -> Column:
    """Title before a colon or a spaced dash."""
    return F.trim(_drop(_s(title), r"\s*[:：]\s*.+$", r"\s+[-—]\s+.+$"))


def plain_author(author: Column | str) -> Column:
    """First author without parentheses; null is empty."""
    return F.trim(F.split_part(_drop(_s(author), r"\s*\([^)]*\)"), F.lit(","), F.lit(1)))


def ingest_title(title: Column | str) -> Column:
    """Title for edition dedup at ingest; a subtitle is only cut if more than three characters stay."""
    t = _drop(_s(title), "(?i)" + FORMAT_PREFIX, *_editions(f"{EDITION_WORDS}|{FORMAT_WORDS}"))
    for tail in (r"\s*[:：]\s*.+$", r"\s+[-—]\s+.+$"):
        cut = _drop(t, tail)
        t = F.when(F.length(F.trim(cut)) > 3, cut).otherwise(t)
    return collapse_spaces(t)


def primary_author(author: Column | str) -> Column:
    """First author without role notes; null where nothing is left."""
    a = _drop(F.split_part(author, F.lit(","), F.lit(1)), r"\s*\([^)]*\)", rf"\s+({PRIMARY_ROLES})\s*$")
    return F.nullif(F.trim(a), F.lit(""))


def catalogue_author(author: Column | str) -> Column:
    """First author of a library record such as 'role: name ; role: name'."""
    a = _drop(_s(author), r"^(지은이|저자|글|원작)\s*[:：]\s*")
    return collapse_spaces(F.split(a, "[;,]")[0])


def match_title(title: Column | str) -> Column:
    """Title for matching pages of other editions: no spaces, subtitle, volume or set."""
    t = F.split(_drop(_s(title), r"\s*\(.*?\)"), MATCH_SPLIT)[0]
    bare = F.trim(_drop(t, r"\s+\d+~?\d*권?\s*(세트)?\s*$"))
    return F.lower(_drop(F.when(F.length(bare) >= 2, bare).otherwise(t), r"\s+"))


def search_query(title: Column | str, author: Column | str) -> Column:
    """Core title and first author as one search string."""
    t = F.trim(_drop(F.split(_s(title), MATCH_SPLIT)[0], r"\s*\(.*?\)"))
    bare = F.trim(_drop(t, r"\s+\d+\s*$"))
    a = F.trim(F.split_part(_drop(_s(author), r"\s*\(.*?\)"), F.lit(","), F.lit(1)))
    a = F.trim(_drop(a, rf"\s*({MATCH_ROLES})\s*$"))
    return F.trim(F.concat_ws(" ", F.when(F.length(bare) >= 2, bare).otherwise(t), a))


def page_author(author: Column | str) -> Column:
    a = F.trim(F.split_part(_drop(_s(author), r"\s*\(.*?\)"), F.lit(","), F.lit(1)))
    return F.trim(_drop(a, rf"\s*({PAGE_ROLES})\s*$"))


def author_tokens(author: Column) -> Column:
    tokens = F.transform(F.split(author, r"\s+"), lambda t: F.lower(F.trim(F.replace(t, F.lit("."), F.lit("")))))
    return F.array_distinct(F.filter(tokens, lambda t: F.length(t) >= 2))


def author_matches(expected: Column | str, found: Column | str) -> Column:
    """Whether two author strings name one person: containment, the single token, or two shared tokens."""
    a, b = page_author(expected), page_author(found)
    x, y = (F.lower(_drop(c, r"[.\s]+")) for c in (a, b))
    s, t = author_tokens(a), author_tokens(b)
    shared = F.size(F.array_intersect(s, t))
    near = (F.length(x) >= 2) & (F.contains(y, x) | F.contains(x, y))
    return (a != "") & (b != "") & (near | F.when(F.size(s) == 0, False).when(F.size(s) == 1, shared == 1).otherwise(shared >= 2))


def non_standard_isbn(isbn: Column | str) -> Column:
    i = _s(isbn)
    return (i == "") | F.startswith(i, F.lit("K")) | (F.length(i) < 10)


def isbn_matches(page: Column | str, known: Column | str) -> Column:
    p, k = _s(page), _s(known)
    long = (F.length(p) >= 13) & (F.length(k) >= 13)
    return (p != "") & ~non_standard_isbn(known) & F.when(long, F.right(p, F.lit(13)) == F.right(k, F.lit(13))).otherwise(F.right(p, F.lit(10)) == F.right(k, F.lit(10)))


def clean_html(text: Column | str) -> Column:
    return _drop(_s(text), r"<[^>]+>")


def parse_genre(genre: Column | str) -> tuple[Column, Column]:
    """(l1, l2): the first segment after a known prefix, and all that follow joined."""
    parts = F.transform(F.split(_s(genre), ">"), lambda p: F.trim(p))
    parts = F.when(parts[0].isin(GENRE_PREFIXES), F.slice(parts, 2, 100)).otherwise(parts)
    some = F.trim(_s(genre)) != ""
    return F.when(some, F.get(parts, F.lit(0))), F.when(some & (F.size(parts) >= 2), F.array_join(F.slice(parts, 2, 100), " "))


def split_genre(genre: Column | str) -> tuple[Column, Column]:
    """(l1, l2) as the table's generated columns have them: the raw first and second segments."""
    g = F.col(genre) if isinstance(genre, str) else genre
    return F.when(F.instr(g, ">") == 0, g).otherwise(F.split_part(g, F.lit(">"), F.lit(1))), F.nullif(F.split_part(g, F.lit(">"), F.lit(2)), F.lit(""))


def section(text: Column | str, name: str) -> Column:
    """The part of a sectioned text after [name], up to the next known marker."""
    if name not in SECTIONS:
        return F.lit("")
    after = F.regexp_extract(_s(text), rf"(?s)\[{name}\](.*)$", 1)
    others = "|".join(s for s in SECTIONS if s != name)
    return F.regexp_replace(F.regexp_replace(after, rf"(?s)\[(?:{others})\].*$", ""), r"^\s+|\s+$", "")


def clean_intro(text: Column | str) -> Column:
    """Introduction without star lines, editor's blocks (up to the next blank line) and preview lines."""
    lines = F.split(_s(text), "\n")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("skip"))

    def step(acc: Column, line: Column) -> Column:
        s = F.trim(line)
        star, block = F.startswith(s, F.lit("★")), F.startswith(s, F.lit("MD 한마디")) | F.startswith(s, F.lit("MD한마디"))
        keep = ~star & ~block & ~acc["skip"] & ~F.contains(s, F.lit("미리보기"))
        skip = F.when(star, acc["skip"]).when(block, True).when(acc["skip"], s != "").otherwise(False)
        return F.struct(F.when(keep, F.array_append(acc["out"], line)).otherwise(acc["out"]).alias("out"), skip.alias("skip"))

    return F.regexp_replace(F.array_join(F.aggregate(lines, start, step, lambda a: a["out"]), "\n"), r"^\s+|\s+$", "")


def section_lines(text: Column | str) -> Column:
    """Section text without interface lines; null if five characters or fewer stay."""
    kept = F.array_join(F.filter(F.split(_s(text), "\n"), lambda x: ~F.trim(x).isin(UI_NOISE)), "\n")
    kept = F.regexp_replace(kept, r"^\s+|\s+$", "")
    return F.when(F.length(kept) > 5, kept)


def _labelled(label: str, c: Column | str) -> Column:
    return F.when(_s(c) != "", F.concat(F.lit(f"{label}: "), c if isinstance(c, Column) else F.col(c)))


def basic_source(title: str, author: str, genre: str, description: str) -> Column:
    return F.concat_ws("\n", _labelled("제목", title), _labelled("저자", author), _labelled("장르", genre), _labelled("내용", description))


def rich_source(title: str, author: str, genre: str, description: str, rich: str, keywords: str, excerpt: int = 300, most: int = 15000) -> tuple[Column, Column]:
    """(text, sources) of a full embedding text; empty where the rich text has no introduction."""
    intro, quote = clean_intro(section(rich, "책소개")), section(rich, "책속으로")
    words = F.size(F.coalesce(F.col(keywords), F.array().cast("array<string>"))) > 0
    text = F.concat_ws(
        "\n", _labelled("제목", title), _labelled("저자", author), _labelled("장르", genre), _labelled("내용", description),
        F.concat(F.lit("책소개: "), intro), F.when(quote != "", F.concat(F.lit("발췌: "), F.left(quote, F.lit(excerpt)))),
        F.when(words, F.concat(F.lit("키워드: "), F.array_join(keywords, ", "))),
    )
    sources = F.array_compact(F.array(F.lit("aladin"), F.lit("yes24_intro"), F.when(quote != "", "yes24_excerpt"), F.when(words, "library_keywords")))
    return F.when(intro != "", F.left(text, F.lit(most))).otherwise(""), F.when(intro != "", sources).otherwise(F.array().cast("array<string>"))


def source_choice(rich: str, description: str, title: str, author: str, genre: str, least: int = 200, most: int = 2000) -> tuple[Column, Column]:
    """(text, tier): the rich text if long enough, else the description, else the bare metadata, else null."""
    r, d = F.trim(clean_html(rich)), F.trim(clean_html(description))
    m = F.trim(F.concat_ws(" ", *(F.nullif(_s(c), F.lit("")) for c in (title, author, genre))))
    text = F.when(F.length(r) >= least, r).when(d != "", d).when(m != "", m)
    tier = F.when(F.length(r) >= least, "rich").when(d != "", "kakao_desc").when(m != "", "minimal")
    return F.left(text, F.lit(most)), tier


def feedback_text(tags: str, review: str) -> Column:
    """Emotion tags and review as one text; null without either."""
    t = F.filter(F.coalesce(F.col(tags), F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    r = F.trim(_s(review))
    return F.nullif(F.concat_ws("\n", F.when(F.size(t) > 0, F.concat(F.lit("태그: "), F.array_join(t, ", "))), F.when(r != "", r)), F.lit(""))


def particle(word: Column | str, closed: str, open_: str) -> Column:
    """The particle form for a word: `closed` if its last syllable ends in a consonant."""
    code = F.ascii(F.right(_s(word), F.lit(1)))
    return F.when(code.between(0xAC00, 0xD7A3) & ((code - 0xAC00) % 28 != 0), closed).otherwise(open_)


def similar_title(seed: Column | str) -> Column:
    return F.concat(F.lit("『"), _s(seed), F.lit("』"), particle(seed, "과", "와"), F.lit(" 비슷한 책"))


def call_to_action(tier: Column | str, likes: Column | str) -> Column:
    t, n = F.col(tier), F.col(likes)
    return F.when(t == 0, F.concat(F.lit("좋아요 "), (3 - n).cast("string"), F.lit("권 더 누르면 비슷한 책 추천이 시작돼요"))).when(
        t == 1, F.concat(F.lit("좋아요 "), (6 - n).cast("string"), F.lit("권 더 평가하면 취향 추천이 시작돼요"))
    )


def font(genre: str, description: str) -> Column:
    """The first font with a keyword in the lower-cased text; upper-case keywords never match."""
    text = F.lower(F.concat(_s(genre), F.lit(" "), _s(description)))
    hits = [F.when(reduce(lambda a, b: a | b, (F.contains(text, F.lit(k)) for k in keys)), name) for name, keys in FONTS.items()]
    return F.coalesce(*hits, F.lit(DEFAULT_FONT))


def full_cover(url: Column | str) -> Column:
    """The original behind a thumbnail address of the search service; other addresses stay."""
    u = F.col(url) if isinstance(url, str) else url
    inner = F.nullif(F.try_url_decode(F.regexp_extract(u, r"[?&]fname=([^&#]*)", 1)), F.lit(""))
    return F.when(F.contains(F.coalesce(F.regexp_extract(u, r"^[a-z]+://([^/?#]*)", 1), F.lit("")), F.lit("kakaocdn")), F.coalesce(inner, u)).otherwise(u)


def key_terms(text: Column | str) -> Column:
    """Bold phrases, then quoted terms, each once."""
    bold = F.flatten(
        F.transform(F.regexp_extract_all(_s(text), F.lit(r"(?s)<[Bb]>(.*?)</[Bb]>"), F.lit(1)), lambda b: F.split(F.trim(F.regexp_replace(b, r"<[^>]+>", " ")), r"\s{2,}"))
    )
    bold = F.filter(F.transform(bold, lambda p: F.trim(p)), lambda p: F.length(p).between(2, 80))
    quoted = F.regexp_extract_all(clean_html(text), F.lit("['‘’]([^'‘’]+)['‘’]"), F.lit(1))
    return F.array_distinct(F.concat(bold, F.filter(quoted, lambda q: F.length(q).between(2, 50))))


def short_title(title: Column | str) -> Column:
    """Title without parentheses, subtitle, volume numbers and spaces, lower-cased."""
    t = F.split(_drop(_s(title), r"[\(（][^)）]*[\)）]"), r"[:\-–—]")[0]
    return F.lower(_drop(t, r"(제?\d+권?)", r"\s+"))


def scrub_key(text: Column | str) -> Column:
    return F.regexp_replace(text, r"(authKey=)[^&\s]+", "$1***")


def non_book_word(title: Column | str, genre: Column | str) -> Column:
    """The first stop word that marks an item as no reading book, title words first; else null."""
    t, g = _s(title), _s(genre)
    return F.coalesce(*(F.when(F.contains(t, F.lit(k)), k) for k in TITLE_STOP_WORDS), *(F.when(F.contains(g, F.lit(k)), k) for k in GENRE_STOP_WORDS))


def non_book(title: Column | str, genre: Column | str) -> Column:
    """Whether a stop word marks an item as no reading book."""
    return F.rlike(_s(title), F.lit("|".join(TITLE_STOP_WORDS))) | F.rlike(_s(genre), F.lit("|".join(GENRE_STOP_WORDS)))


def adult_general(code: Column | str) -> Column:
    c = F.trim(_s(code))
    return (c == "") | F.startswith(c, F.lit("0"))


def status(value: Column | str) -> Column:
    """Shelf status with its old names decoded; anything unknown is finished."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v.isin("finished", "read"), "finished").when(v == "reading", "reading").when(v.isin("wishlist", "want_to_read"), "wishlist").otherwise("finished")
