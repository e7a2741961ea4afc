"""The menu registry: links, their managers, search, paging, changes.

Defined cases: a null column never holds a searched term; null ids match nothing; links
with one URL are told by their id; repeated managers are a violation, not an error; empty
tables give empty results. Names of this module's own columns begin with two underscores.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwell.functions.text import strip
from loomwell.operators.sequence import first_wins, numbered

SEARCHED = ("menu_path", "pc_url", "mobile_url", "created_by")


def contains_term(columns: tuple[str, ...] | list[str], term: str | None) -> Column:
    """Case-insensitive LIKE '%term%' on any column; % and _ in the term are wildcards; a blank term holds always."""
    if not (term or "").strip():
        return F.lit(True)
    return reduce(lambda a, b: a | b, (F.coalesce(F.col(c).ilike(f"%{term}%"), F.lit(False)) for c in columns))


def newest_first() -> list[Column]:
    """Links without a creation time come first, as in PostgreSQL's descending order; the id parts ties."""
    return [F.col("created_at").desc_nulls_first(), F.col("updated_at").desc_nulls_last(), F.col("id").asc()]


def page(df: DataFrame, order: list[Column], skip: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(limit)


def page_facts(total: Column, skip: int, limit: int) -> list[Column]:
    """total, page, pages of a listing."""
    if limit <= 0:
        return [total.alias("total"), F.lit(1).alias("page"), F.lit(1).cast("long").alias("pages")]
    return [total.alias("total"), F.lit(skip // limit + 1).alias("page"), F.ceil(total / limit).alias("pages")]


def search(links: DataFrame, term: str | None, columns: tuple[str, ...] = SEARCHED) -> DataFrame:
    return links.filter(contains_term(columns, term))


def unassigned(links: DataFrame, managers: DataFrame) -> DataFrame:
    return links.join(managers, links["id"] == managers["menu_id"], "left_anti")


def assigned(links: DataFrame, managers: DataFrame) -> DataFrame:
    return managers.join(links.withColumnRenamed("id", "menu_id"), "menu_id")


def with_managers(links: DataFrame, managers: DataFrame) -> DataFrame:
    """Every link, with a struct of its manager or null."""
    one = managers.select(F.col("menu_id").alias("id"), F.struct("team_name", "manager_names").alias("manager"))
    return links.join(one, "id", "left")


def violations(links: DataFrame, managers: DataFrame) -> DataFrame:
    """(id, rule) of rows that break the registry's rules."""
    blank = lambda c: strip(F.coalesce(F.col(c), F.lit(""))) == ""
    rules = [
        links.filter(blank("menu_path")).select("id", F.lit("link without menu_path").alias("rule")),
        managers.filter(blank("team_name")).select(F.col("menu_id").alias("id"), F.lit("manager without team_name").alias("rule")),
        managers.filter(blank("manager_names")).select(F.col("menu_id").alias("id"), F.lit("manager without manager_names").alias("rule")),
        managers.join(links, managers["menu_id"] == links["id"], "left_anti").select(F.col("menu_id").alias("id"), F.lit("manager of no link").alias("rule")),
        managers.groupBy("menu_id").count().filter("count > 1").select(F.col("menu_id").alias("id"), F.lit("several managers").alias("rule")),
    ]
    return reduce(DataFrame.unionByName, rules)


def delete_links(links: DataFrame, managers: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and managers without those ids (column id): managers go with their link."""
    return links.join(ids, "id", "left_anti"), managers.join(ids, managers["menu_id"] == ids["id"], "left_anti")


def update_links(links: DataFrame, changes: DataFrame, columns: tuple[str, ...] = ("menu_path", "pc_url", "mobile_url")) -> DataFrame:
    """Columns that ``changes`` (id and some of them) gives a value take it."""
    given = [c for c in columns if c in changes.columns]
    new = changes.select("id", *[F.col(c).alias(f"__{c}") for c in given])
    joined = links.join(new, "id", "left")
    return joined.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in given else F.col(c) for c in links.columns])


def create_links(links: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """``links`` with the new rows (ord and any of the columns) behind them: next ids in their order, created at ``at``.

    New rows without a menu path raise when the result is read.
    """
    first = links.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()[0]
    rows = numbered(new, ["ord"], "id", first + 1)
    path = F.when(strip(F.coalesce(F.col("menu_path"), F.lit(""))) == "", F.raise_error(F.lit("a link needs a menu path"))).otherwise(F.col("menu_path"))
    given = {c: F.col(c) for c in rows.columns} | {"menu_path": path, "created_at": at}
    return links.unionByName(rows.select(*[given.get(c, F.lit(None)).cast(links.schema[c].dataType).alias(c) for c in links.columns]))


def create_managers(links: DataFrame, managers: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The managers with those new ones that may be added, and the others with their rule: no such link, one already, several new ones."""
    facts = new.join(links.select(F.col("id").alias("menu_id"), F.lit(True).alias("__link")), "menu_id", "left")
    facts = facts.join(managers.select("menu_id", F.lit(True).alias("__has")).distinct(), "menu_id", "left").join(new.groupBy("menu_id").agg(F.count(F.lit(1)).alias("__n")), "menu_id")
    rule = F.when(F.col("__link").isNull(), "manager of no link").when(F.col("__has").isNotNull() | (F.col("__n") > 1), "several managers")
    judged = facts.withColumn("rule", rule)
    return managers.unionByName(judged.filter("rule is null").select(*managers.columns)), judged.filter("rule is not null").select("menu_id", "rule").distinct()


def matching_suffix(column: str, like: str, pattern: str) -> Column:
    """Whether an id is LIKE the wildcard and then matches the whole pattern."""
    return F.col(column).like(like) & F.col(column).rlike(f"^(?:{pattern})$")


def url_lookup(urls: DataFrame, links: DataFrame) -> DataFrame:
    """(url, id, menu_path): the link of each URL; of several with one URL the one with the largest id."""
    one = links.groupBy(F.col("pc_url").alias("url")).agg(F.max_by(F.struct("id", "menu_path"), "id").alias("link"))
    return urls.join(one, "url", "left").select("url", "link.id", "link.menu_path")


def max_suffix(ids: DataFrame, column: str, prefix: str) -> Column:
    """The largest number behind ``prefix`` in whole ids, 0 if there is none: an aggregate."""
    return F.coalesce(F.max(F.regexp_extract(column, rf"^{prefix}(\d+)$", 1).try_cast("long")), F.lit(0))


def upsert(links: DataFrame, incoming: DataFrame, prefix: str) -> DataFrame:
    """(menu_path, pc_url, mobile_url, document_id, action) of each incoming key.

    incoming: ord, menu_path, pc_url, mobile_url; a row needs path and URL. A known
    pair is updated; a new one gets the next id, in order of first appearance, and
    later rows with the same pair take the same one.
    """
    usable = incoming.filter("menu_path <> '' and pc_url <> ''")
    keyed = usable.groupBy("menu_path", "pc_url").agg(F.min("ord").alias("ord"), F.max_by("mobile_url", "ord").alias("mobile_url"))
    known = first_wins(links.select("menu_path", "pc_url", "document_id", "id"), ["menu_path", "pc_url"], [F.col("id")]).drop("id")
    found = keyed.join(known, ["menu_path", "pc_url"], "left")
    first = links.agg(max_suffix(links, "document_id", prefix)).first()[0]
    new = numbered(found.filter("document_id is null"), ["ord"], "n", first + 1)
    new = new.withColumn("document_id", F.concat(F.lit(prefix), F.col("n").cast("string"))).drop("n").withColumn("action", F.lit("insert"))
    return found.filter("document_id is not null").withColumn("action", F.lit("update")).unionByName(new).drop("ord")
