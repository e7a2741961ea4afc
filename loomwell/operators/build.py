"""From crawled pages to snapshot documents: routing, cleaning, building.

Defined cases: null texts, titles and URLs are empty; a result with fewer menus than data
has null ones; details are unique by their key; repeated rows stay; empty tables give empty
results; a page's own columns other than those named are not carried on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwell.functions import text, urls
from loomwell.operators import sequence
from loomwell.operators.html import title_resolved
from loomwell.operators.tree import hierarchy

# Dates of documents whose page tells none.
START, END = "1900-01-01", "2999-12-31"


def expand_results(results: DataFrame) -> DataFrame:
    """(url, menus, datas) to a row for each data, with the menu at its place or null."""
    return results.select("url", "menus", F.posexplode("datas").alias("i", "data")).select("url", "i", "data", F.get("menus", F.col("i")).alias("menu"))


def documents(pages: DataFrame) -> DataFrame:
    """Snapshot rows from pages (url, menu_path, meta_title, page_title, markdown): cleaned text with escaped line breaks."""
    # columns of their own, since a later step names them more than once and would work them out as often
    notice = F.col("__notice")
    flagged = pages.select("url", "menu_path", "meta_title", "page_title", "markdown", text.is_notice(F.col("menu_path"), F.col("markdown")).alias("__notice"))
    ready = flagged.withColumn("__info", F.when(~(notice & (F.coalesce("markdown", F.lit("")) != "")), text.clean_info(F.col("markdown"))))
    cleaned = text.preprocessed(F.col("menu_path"), F.col("markdown"), notice, F.col("__info"))
    path = hierarchy(F.col("menu_path"))
    return ready.select(
        "url", urls.to_mobile(F.col("url")).alias("murl"), path.alias("hierarchy"),
        title_resolved(F.col("menu_path"), F.col("meta_title"), F.col("page_title")).alias("title"),
        F.replace(text.nfc(cleaned), F.lit("\n"), F.lit("\\n")).alias("text"),
        F.lit(START).alias("startdate"), F.lit(END).alias("enddate"), F.lit("new").alias("status"),
        text.content_type(F.col("menu_path"), F.col("markdown"), notice).alias("kind"), urls.route(F.col("url")).alias("handler"),
    )


def enriched(listed: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """List rows with their detail page: a detail's title wins unless it is blank; rows without one stay."""
    d = details.select(key, F.col("title").alias("__title"), "content")
    return listed.join(d, key, "left").withColumn("title", F.coalesce(F.nullif(F.trim("__title"), F.lit("")), F.col("title"))).drop("__title")


def markdown_file(title: Column, url: Column, at: Column, body: Column) -> Column:
    """The text of a page's Markdown file; null for a blank body, which gets none."""
    return F.when(F.trim(F.coalesce(body, F.lit(""))) != "", F.format_string("# %s\n\n- URL: %s\n- 수집 시각: %s\n\n%s\n", title, url, at, body))


def write_markdown(pages: DataFrame, path: str) -> None:
    """Each page's Markdown file (title, url, at, body) as ``path/<stem>.md``-style folders of text, one folder for each stem; blank bodies are left out."""
    rows = pages.select(text.file_stem(F.coalesce(F.nullif("title", F.lit("")), F.col("url"))).alias("stem"), markdown_file(F.col("title"), F.col("url"), F.col("at"), F.col("body")).alias("value"))
    rows.filter("value is not null").write.partitionBy("stem").text(path)


# How many recommendations of each kind a page takes, before any is dropped.
RECOMMENDED = {"top": 10, "bundle_option": 20, "plan_variant": 10, "other_plan": 10, "extra_service": 10}


def recommendations(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, kind, ord, name, desc, url, murl): the first of each kind, less those without URL or with a script for one; a bundle's URL counts once."""
    some = sequence.capped(rows, [key], "kind", [F.col("ord")], RECOMMENDED)
    some = some.filter((F.coalesce("url", F.lit("")) != "") & ~((F.col("kind") == "plan_variant") & F.col("url").startswith("javascript:")))
    bundles = sequence.first_wins(some.filter("kind = 'bundle_option'"), [key, "url"], [F.col("ord")])
    kept = some.filter("kind <> 'bundle_option'").unionByName(bundles)
    return kept.select(key, "kind", "ord", "name", F.when(F.col("kind") == "bundle_option", F.coalesce("desc", F.lit(""))).otherwise("").alias("desc"), "url", urls.to_mobile(F.col("url")).alias("murl"))


def with_recommendations(metadata: DataFrame, listed: DataFrame, key: str = "page_id") -> DataFrame:
    """Metadata maps with the list as JSON under ``recommendations``; a page without any keeps its map. A list has 60 items at most."""
    items = listed.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct("kind", "ord", "name", "desc", "url", "murl")))).alias("__items"))
    with_ = F.map_concat(F.map_filter("metadata", lambda k, _: k != "recommendations"), F.create_map(F.lit("recommendations"), F.col("__items")))
    return metadata.join(items, key, "left").withColumn("metadata", F.when(F.col("__items").isNotNull(), with_).otherwise(F.col("metadata"))).drop("__items")
