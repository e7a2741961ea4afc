"""Text functions as column expressions; Python only for Unicode normalisation and entities."""

from __future__ import annotations

import html
import json
import re
import unicodedata
from functools import reduce
from itertools import zip_longest
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwell.functions.batches import row_udf, text_udf

#: What Python calls white space, for Java's regular expressions. Signs of one byte stand alone, so that they make one
#: table of bits, and the rest inside one range: ``(?U)``'s class asks many properties of every character.
SPACE = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"
#: The same as a string of its characters.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_UNEVEN = SPACE.replace(r"\x1f ", r"\x1f")  # all but the plain space


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    # lone plain spaces stay as they are
    return F.regexp_replace(c, f"{_UNEVEN}{SPACE}*+| {SPACE}++", " ")


_nfc = text_udf(lambda t: unicodedata.normalize("NFC", t))
#: HTML character references decoded.
unescape = text_udf(html.unescape)


# The references that markup itself needs; the ampersand's comes last, so that nothing is decoded twice.
MARKUP_REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"))


def unescaped_markup(c: Column, names: tuple[str, ...] = ("lt", "gt", "quot", "amp")) -> Column:
    """The named references of markup decoded, whole ones with a semicolon alone; all others stay."""
    for sign, to in MARKUP_REFERENCES:
        if sign[1:-1] in names:
            c = F.replace(c, F.lit(sign), F.lit(to))
    return c


def nfc(c: Column) -> Column:
    """Unicode NFC; texts of ASCII alone never leave the JVM."""
    return F.coalesce(_nfc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def comparable(c: Column) -> Column:
    """The form in which snapshot fields are compared: NFC, white space collapsed and stripped."""
    return strip(collapse(nfc(c)))


def display_value(c: Column, most: int = 120) -> Column:
    """One line, cut to ``most`` characters with an ellipsis."""
    line = F.replace(F.replace(F.replace(c, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit("\r"), F.lit("\\r"))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("..."))).otherwise(line)


def change_summary(old: Column, new: Column) -> Column:
    """Of two numbers: both, the signed difference, and its share of the old one if that isn't 0."""
    diff = new - old
    head = F.concat(old.cast("string"), F.lit(" -> "), new.cast("string"), F.lit(" ("), F.format_string("%+d", diff.cast("long")))
    return F.concat(head, F.when(old != 0, F.format_string(", %+.1f%%", diff / old * 100)).otherwise(""), F.lit(")"))


def strip_tags(c: Column) -> Column:
    """Text without tags, white space collapsed, references decoded."""
    t = strip(collapse(F.regexp_replace(c, "<[^>]+>", "")))
    # texts without a reference never leave the JVM; either way the steps above are made once
    return F.coalesce(unescape(F.when(F.contains(c, F.lit("&")), t)), t)


def format_content(c: Column) -> Column:
    """Three or more line breaks become two, and each line is stripped."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"\n\s*\n\s*\n", "\n\n")
    return F.regexp_replace(t, r"(?md)^\s+|\s+$", "")


def create_markdown(title: Column, date: Column, body: Column) -> Column:
    return F.format_string("# %s\n\n**날짜:** %s\n\n---\n\n%s\n", title, date, body)


# How file names are rewritten, in order, and the signs that they can't have.
FILE_SPAN = r"(\d{1,2})/(\d{1,2})\(([^)]+)\)\s*(\d{1,2}):(\d{2})\s*~\s*(\d{1,2}):(\d{2})"
FILE_REWRITES = [(r"(\d{1,2}):(\d{2})", "$1$2"), (r"(\d{1,2})/(\d{1,2})", "$1$2"), (r"\s*~\s*", "to"), (r"\s+", " ")]
FILE_FORBIDDEN = r'[<>:"/\\|?*]'


def safe_filename(c: Column, most: int = 100) -> Column:
    """A readable file name: brackets, times and signs that file systems forbid are rewritten."""
    two = lambda g: F.lpad(g, 2, "0")
    t = F.regexp_replace(c, r"\[([^]]+)\]", "($1)")
    g = [F.regexp_extract(t, FILE_SPAN, i) for i in range(8)]
    span = F.concat(two(g[1]), two(g[2]), g[3], F.lit("("), two(g[4]), g[5], F.lit("-"), two(g[6]), g[7], F.lit(")"))
    # the first span's text takes the place of all, as a replacement without group references
    t = F.when(g[0] != "", F.call_function("array_join", F.split(t, FILE_SPAN), span)).otherwise(t)
    for pattern, to in FILE_REWRITES:
        t = F.regexp_replace(t, pattern, to)
    return strip(F.regexp_replace(F.substring(t, 1, most), FILE_FORBIDDEN, ""))


def file_stem(c: Column, most: int = 80) -> Column:
    """A URL or title as a file stem; 'untitled' if nothing is left."""
    t = F.regexp_replace(F.regexp_replace(c, r"^https?://", ""), r"[^0-9A-Za-z\p{IsHangul}._-]+", "_")
    t = F.regexp_replace(F.substring(t, 1, most), "^_+|_+$", "")
    return F.when(F.coalesce(t, F.lit("")) == "", "untitled").otherwise(t)


# Patterns that mark a page as a notice, and those that the info cleaner removes or unifies.
NOTICE_PATHS = ["공지사항", "통신서비스중단작업공지", "통신사기주의보", "공연예매메인/공지사항", "공지/이용안내"]
NOTICE_HEADINGS = ["# 통신사기주의보", "### 통신서비스 중단/작업 공지", "### 공지사항"]
INFO_LINKS = [
    (r"\\+", ""),
    (r"!\[\s*\]\([^)]+\)", ""),
    (r"!\[([^\]]*)\]\([^)]+\)", "$1"),
    (r"\[([^\]]*)\]\(javascript:[^)]*\)", "$1"),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"\[\]\(\)", ""),
    (r"<[^>]+>", ""),
]
INFO_REMOVED = [
    r"자막\s*열기\s*자막\s*접기",
    r"(?md)^\s*[=-]{3,}\s*$",
    r"(?imd)^(?:_?닫기_?|주문하기|이전\s*다음|확인|동의|검색|레이어\s*닫기)$",
]
INFO_TERMS = [(r"피해\s*사례", "피해사례"), (r"주의\s*사항", "주의사항"), (r"대응\s*방안", "대응방안")]


def is_notice(path: Column, text: Column) -> Column:
    any_of = lambda c, words: reduce(Column.__or__, [F.coalesce(F.contains(c, F.lit(w)), F.lit(False)) for w in words])
    return any_of(path, NOTICE_PATHS) | any_of(text, NOTICE_HEADINGS)


def clean_info(c: Column) -> Column:
    """Markdown of an ordinary page: backslashes, images, links and tags go, lists and terms are unified."""
    t = F.coalesce(c, F.lit(""))
    for pattern, to in INFO_LINKS:
        t = F.regexp_replace(t, pattern, to)
    for pattern in INFO_REMOVED:
        t = F.regexp_replace(t, pattern, "")
    t = F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), "(?md) +$", "")
    t = F.regexp_replace(t, r"(?md)^\s*-\s*", "- ")
    for pattern, to in INFO_TERMS:
        t = F.regexp_replace(t, pattern, to)
    return strip(t)


# What the notice cleaner replaces, in order: style rules, page navigation, tags and escapes; then
# links; then navigation elements, as patterns over lines; and the sign that stands for a table meanwhile.
NOTICE_FIRST = [
    (r"\.[\w-]+ {[^}]+}", ""),
    (r"#[\w-]+ \.[\w-]+ {[^}]+}", ""),
    (r"\.[\w-]+ [\w-]+ {[^}]+}", ""),
    (r"\.[\w-]+ li {[^}]+}", ""),
]
NOTICE_SECOND = [
    (r"(?s)(?:\[HOME\]|HOME).*?\n", ""),
    (r"(?s)\[(?:이전글|다음글)\\\\.*?\]\(.*?\)|\[목록\]\(.*?\)", ""),
    (r"(?s)- (?:이전글|다음글) \[.*?\]\(.*?\)", ""),
    (r"<br\s*/?>|<BR\s*/?>", " "),
    (r"<[^>]+>", ""),
    (r"\\\[(.*?)\\\]", r"[\1]"),
    (r"\\\*", "*"),
    (r"\\{2,}", ""),
    (r"!\[\s*\]\((.*?)\)", ""),
    (r"\[([^\]]+)\]\([^)]+\)", r"\1"),
]
NOTICE_NAVIGATION = [
    r"\[목록\].*?#\)",
    r"^목록$",
    r"\[상세보기.*?\].*?\".*?\"\)",
    r"\[상세보기.*?\].*?\)",
    r"\[.*?바로가기.*?\].*?\".*?\"\)",
    r"\[.*?바로가기.*?\].*?\)",
    r"- \[가이드 전체\].*?\n",
    r"- \[.*?\]\(.*?\"현재탭\"\).*?\n",
    r"^\s*-\s*\[.*?\]\(.*?\)\s*$\n*",
    r"\[이전 탭.*?\].*?\n",
    r"\[다음 탭.*?\].*?\n",
    r"^\s*-\s*\[.*?\].*?\n",
    r"^\s*\[.*?\].*?\"현재탭\"\).*?\n",
    r"\[\s*이전글\\*.*?\]\(.*?\)",
    r"\[\s*다음글\\*.*?\]\(.*?\)",
    r"\[\s*목록\s*\]\(.*?\)",
    r"-\s*이전글\s*\[.*?\]\(.*?\)",
    r"-\s*다음글\s*\[.*?\]\(.*?\)",
    r"이전글\s*이전글이\s*없습니다\.*\s*\n*",
    r"다음글\s*다음글이\s*없습니다\.*\s*\n*",
]
TABLE_SIGN = "[TABLE]"


def _tables_apart(text: str) -> tuple[str, list[str]]:
    """Pipe tables (a header, a rule of dashes, rows) taken out, each leaving the sign; links in their rows as plain text."""
    lines = text.split("\n")
    bare = [x.strip() for x in lines]
    piped = [x.startswith("|") and x.endswith("|") for x in bare]
    kept, tables, at = [], [], 0
    while at < len(lines):
        width = 1
        if piped[at]:
            # a lone pipe line hides the line after it as well, as it is read with it
            width = 2
            if at + 1 < len(lines) and bare[at + 1].startswith("|") and not set(bare[at + 1].strip("|")) - set("|-"):
                end = next((k for k in range(at + 2, len(lines)) if not piped[k]), len(lines))
                if end > at + 2:
                    tables.append("\n".join([bare[at], bare[at + 1], *(re.sub(r"\[([^\]]+)\]\([^)]+\)", r"\1", x) for x in bare[at + 2 : end])]))
                    kept.append(TABLE_SIGN)
                    at = end
                    continue
                width = 3
        kept += lines[at : at + width]
        at += width
    return "\n".join(kept), tables


def _clean_notice(text: str) -> str:
    for pattern, to in NOTICE_FIRST:
        text = re.sub(pattern, to, text)
    text, tables = _tables_apart(text)
    for pattern, to in NOTICE_SECOND + [(f"(?m){p}", "") for p in NOTICE_NAVIGATION] + [(r"\n{3,}", "\n\n"), (r"(?m) +$", "")]:
        text = re.sub(pattern, to, text)
    parts = text.split(TABLE_SIGN)
    if len(tables) >= len(parts):  # signs that navigation took with it: their tables go to the end
        lost = tables[len(parts) - 1 :]
        text = "".join(x for pair in zip_longest(parts, tables[: len(parts) - 1], fillvalue="") for x in pair)
        for table in lost:
            text = (text if text.endswith("\n\n") else text.rstrip() + "\n\n") + table
    else:
        text = "".join(x for pair in zip_longest(parts, tables + [TABLE_SIGN] * (len(parts) - 1 - len(tables)), fillvalue="") for x in pair)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


_notice = text_udf(_clean_notice)


def clean_notice(c: Column) -> Column:
    """Markdown of a notice: style rules, navigation, tags, links go; tables stay as they are. Null is empty."""
    return F.coalesce(_notice(c), F.lit(""))


def preprocessed(path: Column, text: Column, notice: Column | None = None, info: Column | None = None) -> Column:
    """The text cleaned as what its path or headings make it: a notice or an ordinary page. notice, info: ``is_notice`` and ``clean_info``, where they are columns already."""
    notice = (F.coalesce(text, F.lit("")) != "") & (is_notice(path, text) if notice is None else notice)
    return F.when(notice, clean_notice(F.when(notice, text))).otherwise(clean_info(text) if info is None else info)


def content_type(path: Column, text: Column, notice: Column | None = None) -> Column:
    """'notice' or 'info'; an empty text is info."""
    return F.when(F.coalesce(text, F.lit("")) == "", "info").when(is_notice(path, text) if notice is None else notice, "notice").otherwise("info")


def search_term(question: Column, most: int = 5) -> Column:
    """The first words of two or more letters or digits, joined by spaces: one search term."""
    word = "[A-Za-z0-9가-힣]{2,}+"
    first = F.regexp_extract(question, f"(?s)^(?:.*?{word}){{0,{most}}}", 0)  # up to the last word needed
    return F.array_join(F.regexp_extract_all(first, F.lit(f"({word})"), F.lit(1)), " ")


def preview(c: Column, most: int = 200) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)



# Terms that a question with the first word is also searched for.
EXPANSIONS = {"홈코노미": ["홈코노미", "홈코노미캠페인"], "eSIM": ["eSIM", "eSIM이동"], "듀얼번호": ["듀얼번호", "듀얼번호가입"], "데이터쉐어링": ["데이터쉐어링", "데이터쉐어링가입"]}


def expanded_queries(question: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.array(question), *[F.when(F.contains(question, F.lit(k)), F.array(*map(F.lit, v))).otherwise(none) for k, v in EXPANSIONS.items()]))


# Words that tell a question's intent.
INTENT_WORDS = {
    "web_crawling": ["크롤링", "crawl", "url", "웹사이트", "웹페이지", "스크래핑", "scrape", "http"],
    "system_status": ["상태", "status", "health", "서버", "통계", "statistics"],
    "text_analysis": ["요약", "summarize", "분석", "analyze", "추출", "extract", "텍스트"],
    "html_processing": ["html", "파일", "file", "confluence", "업로드", "upload", "ari"],
    "db_query": ["메뉴", "menu", "링크", "link", "매니저", "manager", "담당자", "조회", "query"],
    "database_schema": ["스키마", "schema", "구조", "컬럼", "column", "테이블", "table", "필드", "field", "데이터구조"],
    "rag_query": ["rag", "검색", "search", "문서", "document", "지식", "knowledge"],
}


def keyword_intents(question: Column) -> Column:
    """The intents with a word in the question, in the table's order."""
    q = F.lower(question)
    hit = lambda words: q.rlike("|".join(rf"\Q{w}\E" for w in words))
    return F.array_compact(F.array(*[F.when(hit(words), F.lit(intent)) for intent, words in INTENT_WORDS.items()]))


def combined_intents(similar: Column, named: Column) -> Column:
    """Intents that both ways found (in the first one's order), then two of the first way alone, one of the second; three at most."""
    both = F.array_intersect(similar, named)
    return F.slice(F.array_distinct(F.concat(both, F.slice(F.array_except(similar, both), 1, 2), F.slice(F.array_except(named, both), 1, 1))), 1, 3)


def paragraph(c: Column) -> Column:
    """Text without tags, references decoded, then ``& < >`` escaped once."""
    t = strip_tags(c)
    for sign, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(sign), F.lit(to))
    return t


def link_cell(url: Column) -> Column:
    """A link for http URLs, N/A for others."""
    return F.when(F.coalesce(url, F.lit("")).rlike("^https?://"), F.concat(F.lit('<link href="'), paragraph(url), F.lit('">🔗 바로가기</link>'))).otherwise("N/A")


def plain_image_alts(c: Column) -> Column:
    """Image texts with a tag in them are emptied."""
    return F.regexp_replace(c, r"(?s)!\[(?=(?:(?!\]\().)*?<)(?:(?!\]\().)*\]\((.*?)\)", "![]($1)")


#: Percent escapes, then character references, decoded; a plus stays.
decoded = text_udf(lambda t: html.unescape(unquote(t)))


def channel(c: Column) -> tuple[Column, Column]:
    """Number and name of a channel's text: what stands before and after the first space; no name without one."""
    t = decoded(strip(collapse(F.replace(c, F.lit("\u00a0"), F.lit(" ")))))
    split = r"(?d)^(\S+)\s+(.*)$"
    found = t.rlike(split)
    return F.when(found, F.regexp_extract(t, split, 1)).otherwise(t), F.when(found, strip(F.regexp_extract(t, split, 2))).otherwise("")


def escape_pipes(c: Column) -> Column:
    return F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))


def without_parentheses(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\([^)]*\)", ""))


def trimmed_lines(c: Column) -> Column:
    """Each line stripped, blank ones dropped."""
    return F.array_join(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), strip), lambda x: x != ""), "\n")


# The markup of a question and its answer, and the references that are decoded in them.
FAQ_ITEM = r'(?s)<a href="#" class="inquiry"><em class="icon_q">Q 질문</em><span>([^<]+)</span></a>\s*<div class="answer">.*?<div class="answer-inner">\s*<p>(.*?)</p>'
FAQ_SIGNS = [("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")]


def faq_items(page: Column) -> Column:
    """question, answer of each item of a page that has both."""
    found = F.arrays_zip(*[F.regexp_extract_all(page, F.lit(FAQ_ITEM), F.lit(g)).alias(n) for g, n in ((1, "question"), (2, "answer"))])

    def item(x: Column) -> Column:
        q, a = strip(x["question"]), strip(x["answer"])
        for sign, to in FAQ_SIGNS:
            q, a = F.replace(q, F.lit(sign), F.lit(to)), F.replace(a, F.lit(sign), F.lit(to))
        return F.struct(q.alias("question"), F.regexp_replace(a, "<br/?>", "\n").alias("answer"))

    return F.filter(F.transform(found, item), lambda x: (x["question"] != "") & (x["answer"] != ""))


def product_name(c: Column) -> Column:
    """One line of letters, digits, Hangul and ``/ - ( )``."""
    # ASCII is told by ranges; only what is beyond is asked for its properties
    return strip(F.regexp_replace(collapse(c), r"(?U)[\x00-\x08\x0e-\x1b!-'*-,.:-@\[-\^`{-\x7f]++|[\x80-\x{10ffff}&&[^\w\sㄱ-ㅎㅏ-ㅣ가-힣]]++", ""))


def webzine_title(c: Column) -> Column:
    """The first line with text, without a leading year and month."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(strip(c), r"^\d{4}\.\s*\d{1,2}\s*", ""), "\n"), strip), lambda x: x != "")
    return strip(collapse(F.coalesce(F.get(lines, F.lit(0)), F.lit(""))))


def long_enough(c: Column, least: int = 50) -> Column:
    return F.length(strip(F.coalesce(c, F.lit("")))) >= least


def truncated(c: Column, most_tokens: int) -> Column:
    """The text up to so many tokens, a word being 1.3; a text within them stays as it is."""
    parts = F.regexp_extract_all(c, F.lit(r"(\s*\S+)"), F.lit(1))
    n = most_tokens * 10 // 13
    return F.when(F.size(parts) > n, F.array_join(F.slice(parts, 1, n), "")).otherwise(c)


def guarded_result(c: Column, most: int = 8 << 20, sample: int = 1000) -> Column:
    """A tool's result as JSON {success, message, truncated, sample} where it is too long, else as it is."""
    n = F.length(c)
    note = F.concat(F.lit("결과가 너무 커서 요약됨 (원본 크기: "), F.format_number(n, 0), F.lit(" 문자)"))
    cut = F.to_json(F.struct(F.lit(True).alias("success"), note.alias("message"), F.lit(True).alias("truncated"), F.concat(F.substring(c, 1, sample), F.lit("...")).alias("sample")))
    return F.when(n > most, cut).otherwise(c)


def menu_below(*parts: Column) -> Column:
    """Menu parts joined by ^, blank ones left out."""
    return F.concat_ws("^", *[F.nullif(strip(F.coalesce(p, F.lit(""))), F.lit("")) for p in parts])


def named_intents(answer: Column, known: list[str] | None = None) -> Column:
    """The known intents of a JSON list in a model's answer, in its order; none where there is no list."""
    a = strip(answer)
    listed = F.when(a.startswith("[") & a.endswith("]"), a).otherwise(F.regexp_extract(a, r"(\[.*?\])", 1))
    found = F.coalesce(F.from_json(listed, "array<string>"), F.array().cast("array<string>"))
    return F.filter(found, lambda x: x.isin(*(known or INTENT_WORDS)))


def nfc_list(items: Column) -> Column:
    """Each item in NFC, empty ones dropped. One call for the whole list."""
    joined = nfc(F.array_join(F.filter(items, lambda x: x.isNotNull()), "\x00"))
    return F.filter(F.split(joined, "\x00"), lambda x: x != "")


def _plain(value):
    """A JSON value in the form in which it is compared: strings normalised, whole numbers alike, at any depth."""
    if isinstance(value, str):
        return " ".join(unicodedata.normalize("NFC", value).split())
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return int(value) if isinstance(value, bool) or isinstance(value, float) and value.is_integer() else value


def canonical_json(value) -> str:
    return json.dumps(_plain(value), sort_keys=True, ensure_ascii=False)


def _canonical_text(t: str) -> str:
    try:
        return canonical_json(json.loads(t))
    except ValueError:
        return canonical_json(t)


def _alike(a: str | None, b: str | None) -> bool:
    return a is not None and b is not None and _canonical_text(a) == _canonical_text(b)


_alike_udf = row_udf(_alike, "boolean", pa.bool_())


def deep_equal(a: Column, b: Column) -> Column:
    """Whether two JSON texts are equal but for key order, white space, Unicode form and 1 against 1.0. Text that isn't JSON is a string."""
    same = a.eqNullSafe(b)
    return same | _alike_udf(F.when(~same, a), F.when(~same, b))
