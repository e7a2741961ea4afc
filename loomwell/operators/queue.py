"""The crawl queue: what to crawl, how it went.

Defined cases: a null status is pending, a null ``is_active`` is not active; a result for
an id that isn't in the queue is left out, and ids are unique on both sides; an empty
queue has no rows, and counts of 0. Names of this module's own columns begin with two
underscores; other columns ride along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Handlers that read several pages have no time limit; others and plain pages have one, in seconds.
MULTI_PAGE = ("notice", "event", "faq", "list", "webzine")
HANDLER_SECONDS, PLAIN_SECONDS = 180, 300


def pending(force: bool = False) -> Column:
    active = F.col("is_active")
    return active if force else active & ((F.col("last_status") != "success") | F.col("last_status").isNull())


def active_urls(queue: DataFrame, force: bool = False, limit: int = 0) -> DataFrame:
    """By priority, then id; ``limit`` 0: all."""
    out = queue.filter(pending(force)).orderBy(F.col("priority").desc(), F.col("id").asc())
    return out.limit(limit) if limit else out


def stats(queue: DataFrame) -> DataFrame:
    """One row. ``pending`` is active less success less failed, whether those are active or not; ``pending_active`` counts."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    active, success, failed = n(F.col("is_active")), n(F.col("last_status") == "success"), n(F.col("last_status") == "failed")
    return queue.agg(F.count(F.lit(1)).alias("total"), active.alias("active"), success.alias("success"), failed.alias("failed"), (active - success - failed).alias("pending"), n(pending()).alias("pending_active"))


def update_status(queue: DataFrame, results: DataFrame) -> DataFrame:
    """results: id, status, error, at, handler_name; the handler only changes if given."""
    new = results.select("id", *[F.col(c).alias(f"__{c}") for c in ("status", "error", "at", "handler_name")], F.lit(True).alias("__hit"))
    q = queue.join(new, "id", "left")
    hit = F.coalesce("__hit", F.lit(False))
    changed = {
        "last_status": F.when(hit, F.col("__status")).otherwise(F.col("last_status")),
        "last_error": F.when(hit, F.col("__error")).otherwise(F.col("last_error")),
        "last_crawled_at": F.when(hit, F.col("__at")).otherwise(F.col("last_crawled_at")),
        "handler_name": F.coalesce("__handler_name", "handler_name"),
    }
    return q.select(*[changed.get(c, F.col(c)).alias(c) for c in queue.columns])


def timeout_seconds(handler: Column) -> Column:
    """Null for no limit. A blank handler is none."""
    multi = F.lower(handler).rlike("|".join(MULTI_PAGE))
    return F.when(F.coalesce(handler, F.lit("")) == "", F.lit(PLAIN_SECONDS)).when(multi, F.lit(None).cast("int")).otherwise(F.lit(HANDLER_SECONDS))


def crawl_summary(results: DataFrame, *keys: str) -> DataFrame:
    """success, failed, total of each run; which items failed is ``failed_items``."""
    failed = F.col("status") == "failed"
    return results.groupBy(*keys).agg(F.count_if(F.col("status") == "success").alias("success"), F.count_if(failed).alias("failed"), F.count(F.lit(1)).alias("total"))


def failed_items(results: DataFrame, *keys: str) -> DataFrame:
    """(keys, id) of the failed items of each run, a row each, so that a run may have any number."""
    return results.filter((F.col("status") == "failed") & F.col("id").isNotNull()).select(*keys, "id")


def joined_ids(ids: Column) -> Column:
    """The ids of one request's list by ', ', null ones left out."""
    return F.array_join(F.transform(F.array_compact(ids), lambda x: x.cast("string")), ", ")


def listed_ids(text: Column) -> Column:
    """The whole numbers of a text box, parted by white space or commas; anything else is left out."""
    return F.array_compact(F.transform(F.split(F.coalesce(text, F.lit("")), r"[\s,]+"), lambda x: F.regexp_extract(x, r"^([+-]?\d+)", 1).try_cast("long")))


def by_ids(queue: DataFrame, ids: list[int], key: str = "id") -> DataFrame:
    """The rows with those ids: no row for no ids."""
    return queue.filter(F.col(key).isin(*ids)) if ids else queue.limit(0)


def exactly_one(df: DataFrame, holds: Column) -> DataFrame:
    """The row for which ``holds``, or none; more than one raises when the result is read."""
    found = df.filter(holds).limit(2)
    several = found.agg(F.count(F.lit(1)).alias("__n")).select(F.when(F.col("__n") > 1, F.raise_error(F.lit("more than one row fits"))).otherwise(F.lit(True)).cast("boolean").alias("__one"))
    return found.join(F.broadcast(several), F.col("__one"))
