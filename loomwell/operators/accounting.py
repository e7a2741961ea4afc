"""What batches came to: successes and failures of two stores, rates, pages.

Defined cases: an id that failed often counts once; null counts and times give 0; empty
tables give counts of 0, or no groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upload_totals(documents: DataFrame, *failed: DataFrame) -> DataFrame:
    """One row: processed, failed (the largest count of any store), success.

    documents: id; failed: one table of ids for each store, where an id counts once.
    """
    totals = documents.agg(F.count(F.lit(1)).alias("processed"))
    for i, f in enumerate(failed):
        totals = totals.crossJoin(f.agg(F.count_distinct("id").alias(f"__f{i}")))  # one row each
    worst = F.array_max(F.array(F.lit(0).cast("long"), *[F.col(f"__f{i}") for i in range(len(failed))]))
    return totals.select("processed", worst.alias("failed"), (F.col("processed") - worst).alias("success"))


def failed_ids(*failed: DataFrame) -> DataFrame:
    """The ids that failed in any store, each once."""
    out = failed[0].select("id")
    for f in failed[1:]:
        out = out.union(f.select("id"))
    return out.distinct()


def batch_totals(points: DataFrame, size: int = 50) -> DataFrame:
    """(batch, documents, failed, success) of points (ord, id, ok) sent in batches of ``size``: a document fails with any of its points."""
    each = points.groupBy(F.floor(F.col("ord") / size).alias("batch"), "id").agg(F.bool_and("ok").alias("ok"))
    return each.groupBy("batch").agg(F.count(F.lit(1)).alias("documents"), F.count_if(~F.col("ok")).alias("failed"), F.count_if("ok").alias("success"))


def rate(done: Column, elapsed: Column) -> Column:
    """Items a second, 0 before any time has passed."""
    return F.when(elapsed > 0, done / elapsed).otherwise(0.0)


def seconds_left(done: Column, total: Column, elapsed: Column) -> Column:
    """At the rate so far; 0 where there is none."""
    r = rate(done, elapsed)
    return F.when(r > 0, (total - done) / r).otherwise(0.0)


def share_done(done: Column, total: Column) -> Column:
    return F.when(total > 0, done / total * 100).otherwise(0.0)


def last_page(links: DataFrame, *keys: str) -> DataFrame:
    """(keys, last_page): the largest page that a pager's links (text, css, href) name: a whole number, or the ``last`` link's target; 1 for none."""
    text = F.trim(F.coalesce("text", F.lit("")))
    number = F.when(text.rlike(r"^\d+$"), text.try_cast("long"))
    target = F.when(F.contains(F.coalesce("css", F.lit("")), F.lit("last")), F.regexp_extract(F.coalesce("href", F.lit("")), r"gotoAjax\((\d+),", 1).try_cast("long"))
    return links.groupBy(*keys).agg(F.greatest(F.lit(1).cast("long"), F.max(F.greatest(number, target))).alias("last_page"))
