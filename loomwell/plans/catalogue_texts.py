"""Queries over texts, metadata, URLs and dates, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwell.functions import dates, text, urls
from loomwell.operators import diff
from loomwell.plans.registered import query
from loomwell.plans.tables import table

_WS = r"[\s]"


def _sql_trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _sql_squeeze(x: str) -> str:
    return _sql_trim(rf"regexp_replace({x}, '\s+', ' ', 'g')")


# Notices

_NOTICE = """'HOME > ' || source || chr(10) || '.x {a}' || chr(10) || '[목록](http://l)' || chr(10) || text || chr(10) || {table} || chr(10) || '<br>끝 \\[a\\] \\* ![](i) ![alt](j)' || chr(10) || '- [탭](u)' || chr(10) || '이전글 이전글이 없습니다.' || chr(10)"""
_TABLE = "'|이름|값|' || chr(10) || '|---|---|' || chr(10) || '|[' || lang || '](http://u)|' || doc_id || '|'"


def _notice_sql() -> str:
    x = _NOTICE.replace("{table}", f"'{text.TABLE_SIGN}'")
    steps = text.NOTICE_FIRST + text.NOTICE_SECOND + [(f"(?m){p}", "") for p in text.NOTICE_NAVIGATION] + [(r"\n{3,}", "\n\n"), (r"(?m) +$", "")]
    for pattern, to in steps:
        quoted = pattern.replace("'", "''")
        x = f"regexp_replace({x}, '{quoted}', '{to}', 'g')"
    whole = f"replace({x}, '{text.TABLE_SIGN}', '|이름|값|' || chr(10) || '|---|---|' || chr(10) || '|' || lang || '|' || doc_id || '|')"
    return _sql_trim(rf"regexp_replace({whole}, '\n{{3,}}', chr(10) || chr(10), 'g')")


@query(f"SELECT doc_id, md5({_notice_sql()}) AS cleaned FROM documents")
def notice_clean(spark, d):
    table_ = F.concat(F.lit("|이름|값|\n|---|---|\n|["), "lang", F.lit("](http://u)|"), "doc_id", F.lit("|"))
    md = F.concat(F.lit("HOME > "), "source", F.lit("\n.x {a}\n[목록](http://l)\n"), "text", F.lit("\n"), table_, F.lit("\n<br>끝 \\[a\\] \\* ![](i) ![alt](j)\n- [탭](u)\n이전글 이전글이 없습니다.\n"))
    return table(spark, d, "documents").select("doc_id", F.md5(text.preprocessed(F.lit("홈^공지사항"), md)).alias("cleaned"))


# Metadata

_META = """meta AS (SELECT doc_id, source, lang, lang = 'fr' AS longer, source = 'src1' AS alt, source = 'src2' AS more, source = 'src3' AS owner, source = 'src4' AS bare FROM documents)"""


def _metadata(spark, d):
    image = lambda alt, src: F.struct(alt.alias("alt"), F.lit(src).alias("src"))
    body = F.when(F.col("lang") == "de", F.replace("text", F.lit(" "), F.lit("  "))).when(F.col("lang") == "fr", F.concat("text", F.lit(" plus"))).otherwise(F.col("text"))
    source = F.col("source")
    some = F.when(source == "src1", F.array(image(source, "a"), image(F.lit("new"), "b"))).when(source == "src2", F.array(image(source, "a"), image(F.col("lang"), "b"), image(F.lit("x"), "c"))).otherwise(F.array(image(source, "a"), image(F.col("lang"), "b")))
    old = F.struct(F.col("text").alias("페이지 내용"), F.array(image(source, "a"), image(F.col("lang"), "b")).alias("images"), F.col("n_chars").alias("changes"))
    new = F.struct(F.lit(0).alias("changes"), F.when(source != "src4", some).alias("images"), F.when(source == "src3", "x").alias("owner"), body.alias("페이지 내용"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("object_key"), F.to_json(old).alias("old_metadata"), F.to_json(new).alias("new_metadata"))


@query(f"""WITH {_META} SELECT doc_id AS object_key, 'metadata.페이지 내용' AS field, 'metadata_subfield_modified' AS type, NULL::INTEGER AS old_size, NULL::INTEGER AS new_size FROM meta WHERE longer
UNION ALL SELECT doc_id, 'metadata.images[1]', 'array_item_modified', NULL, NULL FROM meta WHERE alt UNION ALL SELECT doc_id, 'metadata.images', 'array_size_changed', 2, 3 FROM meta WHERE more
UNION ALL SELECT doc_id, 'metadata.owner', 'metadata_subfield_added', NULL, NULL FROM meta WHERE owner UNION ALL SELECT doc_id, 'metadata.images', 'metadata_subfield_removed', NULL, NULL FROM meta WHERE bare""")
def metadata_diff(spark, d):
    return diff.metadata_changes(_metadata(spark, d), None).select("object_key", "field", "type", "old_size", "new_size")


@query(f"WITH {_META} SELECT doc_id AS object_key, 'metadata.페이지 내용' AS field, md5(CAST(to_json(text || ' plus') AS VARCHAR)) AS new_md5 FROM meta JOIN documents USING (doc_id) WHERE longer")
def metadata_diff_page_text(spark, d):
    return diff.metadata_changes(_metadata(spark, d)).select("object_key", "field", F.md5("new_value").alias("new_md5"))


@query(f"WITH {_META} SELECT doc_id AS object_key, NOT (longer OR alt OR more OR owner OR bare) AS equal, CASE WHEN owner THEN 'images,owner,페이지 내용' ELSE 'images,페이지 내용' END AS keys FROM meta")
def metadata_deep_equal(spark, d):
    m = _metadata(spark, d)
    # the key left out, as a comparison does
    less = lambda c: F.to_json(F.from_json(F.regexp_replace(c, r'"changes":\d+,|,"changes":\d+', ""), "`페이지 내용` string, images array<struct<src string, alt string>>, owner string"))
    keys = diff.metadata_keys(F.col("old_metadata"), F.col("new_metadata"))
    return m.select("object_key", text.deep_equal(less("old_metadata"), less("new_metadata")).alias("equal"), F.array_join(keys, ",").alias("keys"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'u|[\"' || lang || '\",\"' || source || '\"]' WHEN 1 THEN 'u|{\"depth1\":\"' || lang || '\",\"depth2\":\"' || source || '\"}' WHEN 2 THEN 'u|' || lang ELSE 'u|' END AS object_key, CASE doc_id % 4 WHEN 0 THEN lang || ' > ' || source WHEN 1 THEN lang || ' > ' || source WHEN 2 THEN lang ELSE '(경로 없음)' END AS path FROM documents")
def hierarchy_forms(spark, d):
    form = F.expr("""CASE doc_id % 4 WHEN 0 THEN to_json(array(lang, source)) WHEN 1 THEN concat('{"depth2":"', source, '", "depth1":"', lang, '"}') WHEN 2 THEN lang ELSE '[]' END""")
    return table(spark, d, "documents").select("doc_id", diff.json_object_key(F.lit("u"), form).alias("object_key"), diff.hierarchy_display(diff.hierarchy_items(form)).alias("path"))


# Shapes of texts

_DISPLAY = "replace(text, chr(10), '\\n')"


@query(rf"""SELECT doc_id, CASE WHEN length({_DISPLAY}) > 120 THEN substr({_DISPLAY}, 1, 120) || '...' ELSE {_DISPLAY} END AS shown,
md5(regexp_replace(regexp_replace(text, '\n\s*\n\s*\n', chr(10) || chr(10), 'g'), '(?m)^\s+|\s+$', '', 'g')) AS formatted,
md5('# ' || source || chr(10) || chr(10) || '**날짜:** 2024-01-02' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || text || chr(10)) AS markdown,
md5({_sql_squeeze("text")}) AS stripped, md5(replace({_sql_squeeze("text")}, '&', '&amp;')) AS paragraph,
md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_sql_trim("x")}), lambda x: x <> ''), chr(10))) AS lines, md5(replace(text, '|', '\|')) AS piped,
md5({_sql_trim("regexp_replace(text, '[(][^)]*[)]', '', 'g')")}) AS plain, md5({_sql_trim(r"regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[^\p{L}\p{N}_\s/\-()]', '', 'g')")}) AS product,
{_sql_squeeze(r"coalesce(list_filter(list_transform(string_split(regexp_replace(text, '^\d{4}\.\s*\d{1,2}\s*', ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1], '')")} AS headline,
length({_sql_trim("text")}) >= 50 AS long_enough, array_to_string(regexp_extract_all(text, '[A-Za-z0-9]{{2,}}')[1:5], ' ') AS term,
'<link href="http://h/' || doc_id || '">🔗 바로가기</link>' AS cell FROM documents""")
def text_shapes(spark, d):
    t, md5 = F.col("text"), F.md5
    return table(spark, d, "documents").select(
        "doc_id", text.display_value(t).alias("shown"), md5(text.format_content(t)).alias("formatted"), md5(text.create_markdown(F.col("source"), F.lit("2024-01-02"), t)).alias("markdown"),
        md5(text.strip_tags(F.concat(F.lit("<p>"), t, F.lit("</p>")))).alias("stripped"), md5(text.paragraph(t)).alias("paragraph"), md5(text.trimmed_lines(t)).alias("lines"),
        md5(text.escape_pipes(t)).alias("piped"), md5(text.without_parentheses(t)).alias("plain"), md5(text.product_name(t)).alias("product"), text.webzine_title(t).alias("headline"),
        text.long_enough(t).alias("long_enough"), text.search_term(t).alias("term"), text.link_cell(F.concat(F.lit("http://h/"), "doc_id")).alias("cell"),
    )


@query(r"""WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '\s*\S+') AS words, length(text) AS n FROM documents)
SELECT doc_id, md5(CASE WHEN len(words) > 100 THEN array_to_string(words[1:100], '') ELSE text END) AS cut, n > 2000 AS large,
md5(CASE WHEN n > 2000 THEN '{"success":true,"message":"결과가 너무 커서 요약됨 (원본 크기: ' || format('{:,}', n) || ' 문자)","truncated":true,"sample":' || CAST(to_json(substr(text, 1, 1000) || '...') AS VARCHAR) || '}' ELSE text END) AS guarded FROM w""")
def text_limits(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(text.truncated(t, 130)).alias("cut"), (F.length(t) > 2000).alias("large"), F.md5(text.guarded_result(t, 2000)).alias("guarded"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang || '^' END || CASE WHEN doc_id % 5 = 0 THEN '' ELSE source || '^' END || 'T' || doc_id AS menu, '(공지) ' || source || ' 0302수(0100-0830) 점검' AS file,
'x.y_a_' || doc_id || '_b_1' AS stem, '![](u' || doc_id || ') ![ok](v)' AS images, CASE WHEN lang = 'es' THEN '' ELSE 'rag_query' END AS intents, 'a,b̈,' || source AS parts,
CASE WHEN lang = 'en' THEN 'eSIM ' || source || ',eSIM,eSIM이동' ELSE source END AS queries FROM documents""".replace("b̈", "ö"))
def text_names(spark, d):
    menu = text.menu_below(F.expr("CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE lang END"), F.expr("CASE WHEN doc_id % 5 <> 0 THEN source END"), F.concat(F.lit("T"), "doc_id"))
    file = text.safe_filename(F.concat(F.lit("[공지] "), "source", F.lit(" 03/2(수) 1:00 ~ 08:30 점검?")))
    stem = text.file_stem(F.concat(F.lit("https://x.y/a?"), "doc_id", F.lit("=b&1")))
    images = text.plain_image_alts(F.concat(F.lit("![<b>a\n</b>](u"), "doc_id", F.lit(") ![ok](v)")))
    answer = F.when(F.col("lang") == "es", "none found").otherwise('I think ["rag_query", "other"] fits')
    parts = text.nfc_list(F.array(F.lit("a"), F.lit(""), F.lit("o\u0308"), F.lit(None), F.col("source")))
    queries = text.expanded_queries(F.when(F.col("lang") == "en", F.concat(F.lit("eSIM "), "source")).otherwise(F.col("source")))
    return table(spark, d, "documents").select(
        "doc_id", menu.alias("menu"), file.alias("file"), stem.alias("stem"), images.alias("images"), F.array_join(text.named_intents(answer), ",").alias("intents"), F.array_join(parts, ",").alias("parts"), F.array_join(queries, ",").alias("queries")
    )


# URLs

@query("""SELECT doc_id, 'https://m.shop.kt.com:444/m/x?' || doc_id AS shop, '' AS none, CASE WHEN doc_id % 2 = 0 THEN 'https://m.globalroaming.kt.com/news/view.asp?idx=' || doc_id ELSE 'https://m.globalroaming.kt.com/news/list.asp?p=' || doc_id END AS roaming,
'https://gigagenie.kt.com/m/blog/' || doc_id AS blog, CASE WHEN doc_id % 2 = 0 THEN 'http://h/a/' || source ELSE 'http://h/' || source END AS absolute, 'http://h/d?no=' || doc_id || CASE WHEN lang = 'en' THEN '&kind=' || source ELSE '' END AS detail,
CAST(CASE WHEN doc_id % 2 = 0 THEN 2000 + doc_id % 50 ELSE 1990 + doc_id % 50 END AS INTEGER) AS year, lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') AS month,
CASE doc_id % 4 WHEN 0 THEN 'shop_popups' WHEN 1 THEN 'accessories' WHEN 2 THEN 'winners' END AS handler FROM documents""")
def url_forms(spark, d):
    c = lambda *parts: F.concat(*[F.lit(x) if x.startswith(("http", "?", "&", "/", "ftp", "=")) else F.col(x) for x in parts])
    even = F.col("doc_id") % 2 == 0
    year, month = urls.year_month(F.concat(F.lit("http://h/?year="), F.when(even, F.col("doc_id") % 50).otherwise(F.col("doc_id") % 50 + 1990), F.lit("&month="), F.col("doc_id") % 12 + 1))
    page = F.expr("CASE doc_id % 4 WHEN 0 THEN 'https://shop.kt.com/unify/mobile.do?a=1&category=usim' WHEN 1 THEN 'https://shop.kt.com/display/olhsStore.do?dispNo=STOR043103' WHEN 2 THEN 'https://shop.kt.com/display/olhsStore.do?dispNo=STOR05&subDispNo=STOR0506' ELSE 'x://y' END")
    return table(spark, d, "documents").select(
        "doc_id", urls.to_shop_mobile(c("https://shop.kt.com/x?", "doc_id")).alias("shop"), urls.to_shop_mobile(c("ftp://", "source")).alias("none"),
        urls.to_roaming_mobile(F.when(even, c("https://globalroaming.kt.com/news/view.asp?p=1&idx=", "doc_id")).otherwise(c("https://globalroaming.kt.com/news/list.asp?p=", "doc_id"))).alias("roaming"),
        urls.to_blog_mobile(c("https://gigagenie.kt.com/blog/", "doc_id")).alias("blog"), urls.absolute(F.lit("http://h/a/b"), F.when(even, F.col("source")).otherwise(c("/", "source"))).alias("absolute"),
        urls.detail_url("http://h/d", no=F.col("doc_id").cast("string"), kind=F.when(F.col("lang") == "en", F.col("source"))).alias("detail"), year.alias("year"), month.alias("month"), urls.route(page).alias("handler"),
    )


# Dates

_YMD = "strftime(o_orderdate, '%Y-%m-%d')"


@query(f"""SELECT o_orderkey, {_YMD} AS recent_or_none, CASE WHEN o_orderstatus = 'F' THEN '' ELSE {_YMD} END AS started, CASE WHEN o_orderstatus = 'F' THEN '' ELSE strftime(o_orderdate + INTERVAL 9 DAY, '%Y-%m-%d') END AS ended,
strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, '안내' AS category, strftime(o_orderdate, '%Y.%m.%d') AS day, '(' || strftime(o_orderdate, '%y-%m-%d') || ')T' AS label, CAST(CASE WHEN o_orderkey % 100 < 70 THEN 2000 ELSE 1900 END + o_orderkey % 100 AS INTEGER) AS full_year,
CAST(year(o_orderdate) AS VARCHAR) || '-' || CAST(month(o_orderdate) AS VARCHAR) || '-' || CAST(day(o_orderdate) AS VARCHAR) AS shown, CASE WHEN o_orderstatus = 'F' THEN '1900-01-01' ELSE strftime(o_orderdate, '%Y-%m-01') END AS month_start
FROM (SELECT *, o_orderdate >= TIMESTAMP '2000-01-01' AS this_century FROM orders)""".replace(f"{_YMD} AS recent_or_none", f"CASE WHEN this_century THEN {_YMD} ELSE '' END AS recent_or_none"))
def date_forms(spark, d):
    at = F.col("o_orderdate")
    form = lambda p: F.date_format(at, p)
    said = F.when(F.col("o_orderstatus") == "F", form("yyyy-MM-dd")).otherwise(F.concat(F.lit("기간 "), form("yyyy.MM.dd"), F.lit(" ~ "), F.date_format(at + F.expr("INTERVAL 9 DAYS"), "yyyy.MM.dd")))
    start, end = dates.exact_period(said)
    category, day = dates.category_and_date(F.concat(F.lit("안내"), form("yyyy.MM.dd")))
    open_ = F.col("o_orderstatus") != "F"
    return table(spark, d, "orders").select(
        "o_orderkey", dates.recent_date(F.concat(F.lit("on "), form("yyyy. M. d").substr(1, 99))).alias("recent_or_none"), start.alias("started"), end.alias("ended"), dates.iso(at).alias("iso"), category.alias("category"), day.alias("day"),
        dates.folder_label(form("yyyy.M.d"), F.lit("T")).alias("label"), dates.full_year(F.col("o_orderkey") % 100).cast("int").alias("full_year"), dates.show_date(form("M/d/yyyy")).alias("shown"),
        dates.month_start(F.when(open_, F.year(at)), F.when(open_, F.month(at))).alias("month_start"),
    )
