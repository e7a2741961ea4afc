import time

import pytest
from pyspark.sql import functions as F

from loomwell.functions import dates, dom, tables, text, urls
from loomwell.operators import html


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def one(spark, value, f):
    return values(spark, [(value,)], "x string", f(F.col("x")))[0][0]


def test_white_space_is_pythons(spark):
    odd = " 　a  \x1cb\u0085"
    assert one(spark, odd, text.comparable) == " ".join(odd.split())
    assert one(spark, "é", text.comparable) == "é"
    assert one(spark, None, text.comparable) is None


def test_display_and_summary(spark):
    assert one(spark, "a\nb\tc", text.display_value) == "a\\nb\\tc"
    assert one(spark, "x" * 130, text.display_value) == "x" * 120 + "..."
    rows = values(spark, [(2, 3), (0, 5)], "a int, b int", text.change_summary(F.col("a"), F.col("b")))
    assert rows == [("2 -> 3 (+1, +50.0%)",), ("0 -> 5 (+5)",)]


def test_file_names(spark):
    assert one(spark, "[공지] 03/2(수) 1:00 ~ 08:00 점검?", text.safe_filename) == "(공지) 0302수(0100-0800) 점검"
    assert one(spark, "a/b: c ~ d", text.safe_filename) == "ab ctod"
    assert one(spark, "https://x.y/a?b=1", text.file_stem) == "x.y_a_b_1"
    assert one(spark, "///", text.file_stem) == "untitled"


def test_cleaning(spark):
    md = "![](u)![alt](u) [t](javascript:x) [u](http://v) [](  )\\\\ <b>z</b>\n\n\n\n  -   item  \n=====\n닫기\n피해  사례"
    assert one(spark, md, text.clean_info) == "alt t u [](  ) z\n- item\n\n피해사례"
    assert one(spark, "", text.clean_info) == "" and one(spark, None, text.clean_info) == ""
    kinds = values(spark, [("홈^공지사항", "x"), ("홈", "# 통신사기주의보"), ("홈", "x"), ("홈^공지사항", "")], "p string, t string", text.content_type(F.col("p"), F.col("t")))
    assert [k for k, in kinds] == ["notice", "notice", "info", "info"]


def test_questions(spark):
    assert one(spark, "a bb ccc 가나 1 22 dd ee", text.search_term) == "bb ccc 가나 22 dd"
    assert one(spark, "eSIM 신청", text.expanded_queries) == ["eSIM 신청", "eSIM", "eSIM이동"]
    assert one(spark, "메뉴 URL 조회", text.keyword_intents) == ["web_crawling", "db_query"]
    rows = values(spark, [(["a", "b", "c"], ["d", "b"])], "a array<string>, b array<string>", text.combined_intents(F.col("a"), F.col("b")))
    assert rows[0][0] == ["b", "a", "c"]


def test_urls(spark):
    assert one(spark, "https://product.kt.com/wDic/x", urls.to_mobile) == "https://m.product.kt.com/mDic/x"
    assert one(spark, "https://help.kt.com/a", urls.to_mobile) == "https://m.help.kt.com/a"
    assert one(spark, "http://help.kt.com/a", urls.to_mobile) == "http://help.kt.com/a"
    assert one(spark, None, urls.to_mobile) == ""
    assert one(spark, "https://event.kt.com/past_event_view.html?pcEvtNo=9", urls.to_event_mobile) == "https://m.kt.com/past_event_view.html?mblevtno=10&rows=10"
    assert one(spark, "https://globalroaming.kt.com/news/view.asp?p=2&idx=7", urls.to_roaming_mobile) == "https://m.globalroaming.kt.com/news/view.asp?idx=7"
    assert one(spark, "ftp://x", urls.to_shop_mobile) == ""
    assert one(spark, "see http://a/b, (http://a/b) http://c.", urls.urls_in_text) == ["http://a/b", "http://c"]
    assert one(spark, "xhttps://inside.kt.com/html/notice/notice_list.html", urls.route) is None
    assert one(spark, "https://inside.kt.com/html/notice/notice_list.html?x", urls.route) == "notices"
    rows = values(spark, [("http://a/b?year=24&month=3",)], "x string", *urls.year_month(F.col("x")))
    assert rows == [(2024, "03")]


def test_dates(spark):
    assert one(spark, "on 2024.1.2", dates.hyphen_date) == "2024-01-02"
    pairs = lambda f, x: values(spark, [(x,)], "x string", *f(F.col("x")))[0]
    assert pairs(dates.period, "2024.1.2 ~ 2024/3/04") == ("2024-01-02", "2024-03-04")
    assert pairs(dates.period, "2024-01-02 ~ 2024-03-04") == ("0000-00-00", "9999-99-99")
    assert pairs(dates.category_and_date, "안내2024.01.02") == ("안내", "2024.01.02")
    assert pairs(dates.category_and_date, "none") == ("", "")
    assert pairs(dates.date_range, "2024년 3월 5일 ~ 4월 1일") == ("2024-03-05", "2024-04-01")
    assert pairs(dates.date_range, "2024.3.5 ~ 2025.4.1") == ("2024-03-05", "2025-04-01")
    assert one(spark, "1/2/2024", dates.show_date) == "2024-1-2"
    rows = values(spark, [(69,), (70,)], "y int", dates.full_year(F.col("y")))
    assert rows == [(2069,), (1970,)]


@pytest.mark.parametrize("page", ["<a" * 50_000, "<b>" * 12_000 + "</i>" * 10_000, "<script></script>" * 6_000, '<a ">' * 20_000, "<div>" * 10_000 + "<td>x</td>" * 6_000, "<div>" * 10_000 + "<img alt=abcd>" * 4_000, "<nav>" + "<div>" * 10_000 + "<li></li>" * 6_000])
def test_hard_pages_are_read_in_linear_time(page):
    """100 kB of markup that a reader in quadratic time takes a minute for."""
    began = time.process_time()
    html._page(page, "http://a/b", 3, 2)
    assert time.process_time() - began < 6


def test_unfinished_markup():
    assert dom.tree("x<a").text() == "x<a"
    assert [n.attrs for n in dom.tree("<a \">y</a><a href='/z'>w</a>").all("a")] == [{}, {"href": "/z"}]
    assert [n.text() for n in dom.tree("<a>one<a>two</a></a>").all("a")] == ["one", "two"]
    assert dom.tree("a<!-- open <p>b</p>").text() == "a" and dom.tree("<script>a<b</script>c").text() == "c"


def test_table_functions_from_sql(spark):
    tables.register(spark)
    page = "<table><tr><th rowspan=2>k<th colspan=2>v<tr><td>a<td>b<tr><td>1</table><p id=x class='y z'>one <b>two</b> three<table><tr><td>q<table><tr><td>in</table></table>"
    spark.createDataFrame([(1, page), (2, None), (3, "")], "id int, html string").createOrReplaceTempView("some_pages")
    got = [tuple(r) for r in spark.sql("SELECT id, c.* FROM some_pages, LATERAL html_cells(html) c ORDER BY 1, 2, 3, 4").collect()]
    assert [(g[1], g[2], g[3], g[4]) for g in got] == [(0, 0, 0, "k"), (0, 0, 1, "v"), (0, 0, 2, "v"), (0, 1, 0, "k"), (0, 1, 1, "a"), (0, 1, 2, "b"), (0, 2, 0, "1"), (0, 2, 1, ""), (0, 2, 2, ""), (1, 0, 0, "q in"), (2, 0, 0, "in")]
    assert [g[5] for g in got[:5]] == [True, True, True, True, False] and {g[0] for g in got} == {1}
    nodes = spark.sql("SELECT n.* FROM some_pages, LATERAL html_nodes(html) n WHERE n.tag IN ('p', 'b')").collect()
    assert [(n.tag, n.id, n.classes, n.text) for n in nodes] == [("p", "x", "y z", "one three"), ("b", None, None, "two")] and nodes[1].parent_no == nodes[0].node_no


def test_white_space_forms_are_python_s(spark):
    """Stripping, collapsing and product names by tables of characters, against properties of every character."""
    space = r"(?U)[\s\x1c-\x1f]"
    chars = [chr(c) for c in range(0x3100) if not chr(c).isalnum() or c < 0x80] + ["​", "﻿", "\U0001f600", "\U00020000"]
    rows = [(x,) for c in chars for x in (f"a{c}b", f"{c} x{c}{c}", f"a {c}")] + [("",), (None,), ("  ",)]
    t = F.col("t")
    strip = lambda c: F.regexp_replace(c, rf"^(?:{space}+)|(?:{space}+)$", "")
    collapse = lambda c: F.regexp_replace(c, f"{space}+", " ")
    product = strip(F.regexp_replace(collapse(t), r"(?U)[^\w\s\x1c-\x1fㄱ-ㅎㅏ-ㅣ가-힣/\-()]", ""))
    same = text.strip(t).eqNullSafe(strip(t)) & text.collapse(t).eqNullSafe(collapse(t)) & text.product_name(t).eqNullSafe(product)
    assert spark.createDataFrame(rows, "t string").filter(~same).count() == 0


def test_texts_without_references_stay_in_the_jvm(spark):
    df = spark.createDataFrame([("<b>a</b> &lt;b &amp;amp;",), ("a  <i>b",), ("&",), (None,)], "t string")
    out = df.select(text.strip_tags(F.col("t")).alias("t"))
    assert [r.t for r in out.collect()] == ["a <b &amp;", "a b", "&", None]
    assert "Contains(t" in out._jdf.queryExecution().executedPlan().toString()


def test_search_term_of_few_and_many_words(spark):
    df = spark.createDataFrame([("a bb c dd\nee ff-gg hhh",), ("x yy",), ("x y",), ("",), (None,), ("가나 b 다라",)], "t string")
    assert [r.t for r in df.select(text.search_term(F.col("t")).alias("t")).collect()] == ["bb dd ee ff gg", "yy", "", "", None, "가나 다라"]


def test_pages_are_cleaned_once(spark):
    from loomwell.operators import build

    rows = [("u1", "A^B", "a\n\n\n\nb  \n -  c"), ("u2", "공지사항^B", "x  \n\n\n\ny é"), ("u3", "공지사항", ""), ("u4", None, None), ("u5", "A", "# 통신사기주의보\nz")]
    pages = spark.createDataFrame(rows, "url string, menu_path string, markdown string").withColumns({"meta_title": F.lit("m"), "page_title": F.lit("p")})
    out = build.documents(pages).select("url", "text", "kind")
    assert sorted(map(tuple, out.collect())) == [("u1", "a\\n\\nb\\n- c", "info"), ("u2", "x\\n\\ny é", "notice"), ("u3", "", "info"), ("u4", "", "info"), ("u5", "# 통신사기주의보\\nz", "notice")]
    assert out._jdf.queryExecution().executedPlan().toString().count("자막") == 2  # the cleaner's pattern, once in its column
