"""Site pages: what the page handlers make of the rows that a browser step brought, as tables in, tables out.

Every function takes rows in the order of column ``ord`` under a page or list key, and
none looks at more than one list in a task. Null texts are empty; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwell.functions import dates, text, urls
from loomwell.operators import sequence

# Plan titles that aren't plans, a mark of those that are chosen freely, menus where none is given.
ALL_PLANS, FREE_PLAN = "전체", "선택형"
EVENT_MENU, WEBZINE_MENU = "KT 이벤트", "Shop"


def channel_plans(rows: DataFrame) -> DataFrame:
    """(tab, ord, code, title) of a channel page's plans (tab, ord, code, raw_title): no blank, 'all' or free ones, each code once in its tab."""
    title = text.without_parentheses(text.strip(F.replace(F.coalesce("raw_title", F.lit("")), F.lit(" "), F.lit(" "))))
    code = text.strip(F.coalesce("code", F.lit("")))
    plans = rows.select("tab", "ord", code.alias("code"), title.alias("title"))
    plans = plans.filter((F.col("code") != "") & ~F.col("title").isin("", ALL_PLANS) & ~F.contains("title", F.lit(FREE_PLAN)))
    return sequence.first_wins(plans, ["tab", "code"], [F.col("ord")])


def channel_table(rows: DataFrame) -> DataFrame:
    """(tab, ord, number, name, note, line) of channels (tab, ord, channel, alt): ``line`` is the row of a pipe table."""
    number, name = text.channel(F.col("channel"))
    note = text.decoded(text.strip(F.coalesce("alt", F.lit(""))))
    out = rows.select("tab", "ord", number.alias("number"), name.alias("name"), note.alias("note")).filter("number <> ''")
    return out.withColumn("line", F.concat(F.lit("| "), F.concat_ws(" | ", *[text.escape_pipes(F.col(c)) for c in ("number", "name", "note")]), F.lit(" |")))


def faq_rows(pages: DataFrame) -> DataFrame:
    """(page, category, ord, question, answer) of FAQ pages (page, category, html)."""
    found = pages.select("page", "category", F.posexplode(text.faq_items(F.coalesce("html", F.lit("")))).alias("ord", "item"))
    return found.select("page", "category", "ord", "item.question", "item.answer")


def faq_document(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, document, questions): a list's questions and answers in order, a heading where the category changes.

    Rows: key, the order's columns, category, question, answer; a question counts once,
    without the space around it. A document has the questions of one list.
    """
    asked = rows.withColumn("question", text.strip(F.coalesce("question", F.lit("")))).filter("question <> ''")
    once = sequence.first_wins(asked, [key, "question"], [F.col(c) for c in order])
    broken = sequence.control_break(once, [key], [F.col(c) for c in order], "category")
    head = F.when(F.col("is_break") & (F.coalesce("category", F.lit("")) != ""), F.concat(F.lit("## "), "category", F.lit("\n\n"))).otherwise("")
    line = F.concat(head, F.lit("### Q. "), "question", F.lit("\n\n"), F.coalesce("answer", F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return broken.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n\n").alias("document"), F.count(F.lit(1)).alias("questions"))


def notices(rows: DataFrame, key: str, as_of: Column, days: int = 365) -> DataFrame:
    """A notice list's rows (key, ord, raw_date, ...) with category, date and label, up to its first one older than ``days`` before ``as_of``.

    A row without a date isn't old.
    """
    category, day = dates.category_and_date(F.col("raw_date"))
    dated = rows.withColumn("category", category).withColumn("date", dates.hyphen_date(day)).withColumn("label", dates.folder_label(day, F.col("title")))
    fresh = ~F.coalesce(F.to_date(F.nullif("date", F.lit(""))) < F.date_sub(as_of, days), F.lit(False))
    return sequence.take_while(dated, [key], [F.col("ord")], fresh)


def events(listed: DataFrame, details: DataFrame, menu: Column) -> DataFrame:
    """(evt_no, title, startdate, enddate, menu, url, murl) of listed events, each number once, the detail page's title and period where it has them."""
    one = sequence.first_wins(listed.filter("evt_no is not null"), ["evt_no"], [F.col("ord")])
    seen = details.select("evt_no", F.col("title").alias("__title"), F.col("period").alias("__period"))
    both = one.join(seen, "evt_no", "left")
    title = F.coalesce(F.nullif(text.strip(F.coalesce("__title", F.lit(""))), F.lit("")), F.col("title"))
    start, end = dates.period(F.coalesce(F.nullif("__period", F.lit("")), F.col("period")))
    url = urls.detail_url("https://event.kt.com/html/event/ongoing_event_view.html", page=F.lit("1"), searchCtg=F.lit("ALL"), sort=F.lit(""), pcEvtNo=F.col("evt_no").cast("string"))
    return both.select("evt_no", title.alias("title"), start.alias("startdate"), end.alias("enddate"), F.when(F.coalesce(menu, F.lit("")) == "", title).otherwise(F.concat_ws("^", menu, title)).alias("menu"), url.alias("url"), urls.to_event_mobile(url).alias("murl"))


def winners(rows: DataFrame, key: str, stop: int = 3) -> DataFrame:
    """Announcements (key, page, ord, id1, id3, period, ...) with unique id and dates: repeats of earlier pages go, and what comes after ``stop`` pages in a row without a new one."""
    unique = F.concat_ws("_", F.coalesce("id1", F.lit("")), F.coalesce("id3", F.lit("")))
    start, end = dates.exact_period(F.col("period"))
    known = rows.withColumn("unique_id", unique).withColumn("startdate", start).withColumn("enddate", end)
    kept = sequence.first_page_wins(known, [key, "unique_id"], "page")
    pages = rows.select(key, "page").distinct().join(kept.select(key, "page").distinct().withColumn("new", F.lit(True)), [key, "page"], "left")
    read = sequence.stop_after_run(pages, [key], [F.col("page")], F.col("new").isNull(), stop)
    return kept.join(read.select(key, "page"), [key, "page"], "left_semi")


def webzine(rows: DataFrame, menu: Column) -> DataFrame:
    """(url, title, startdate, menu, murl) of webzine items (ord, url, label, content): each URL once, year and month from its query before the label's, short ones left out."""
    one = sequence.first_wins(rows.filter("url is not null"), ["url"], [F.col("ord")]).filter(text.long_enough(F.col("content")))
    year, month = urls.year_month(F.col("url"))
    said = F.regexp_extract("label", r"(\d{4})\.\s*(\d{1,2})", 1), F.regexp_extract("label", r"(\d{4})\.\s*(\d{1,2})", 2)
    year = F.coalesce(year.cast("string"), F.nullif(said[0], F.lit("")))
    month = F.coalesce(month, F.nullif(said[1], F.lit("")))
    title = text.webzine_title(F.col("label"))
    place = F.concat_ws("^", F.when(F.coalesce(menu, F.lit("")) == "", F.lit(WEBZINE_MENU)).otherwise(menu), title)
    return one.select("url", title.alias("title"), dates.month_start(year, month).alias("startdate"), place.alias("menu"), urls.to_shop_mobile(F.col("url")).alias("murl"))


def store_plans(rows: DataFrame, base: str) -> DataFrame:
    """(href, title, startdate, enddate, url) of plan lists (ord, href, title, dates, number, kind): each pair of href and title once; the URL has what isn't null."""
    one = sequence.first_wins(rows, ["href", "title"], [F.col("ord")])
    both = F.split(F.coalesce("dates", F.lit("")), "~")
    known = lambda i, none: F.coalesce(F.nullif(dates.recent_date(F.get(both, F.lit(i))), F.lit("")), F.lit(none))
    return one.select("href", "title", known(0, "1900-01-01").alias("startdate"), known(1, "2999-12-31").alias("enddate"), urls.detail_url(base, prodNo=F.col("number"), kind=F.col("kind")).alias("url"))


def products(rows: DataFrame) -> DataFrame:
    """(ord, code, name, menu, url, murl) of a category's products (ord, code, name, menu, tab, part, href, page): a code counts once, rows without one always."""
    one = sequence.first_wins_if_keyed(rows.withColumn("code", F.nullif(F.col("code"), F.lit(""))), "code", [F.col("ord")])
    name, url = text.product_name(F.col("name")), urls.absolute(F.col("page"), F.col("href"))
    return one.select("ord", "code", name.alias("name"), text.menu_below(F.col("menu"), F.col("tab"), F.col("part"), name).alias("menu"), url.alias("url"), urls.to_mobile(url).alias("murl"))
