"""URL filters: rules found by hash prefixes of host-suffix and path-prefix expressions.

Each URL is expanded into every suffix of its host (whole labels) joined with
those prefixes of its path whose length some rule's path has. The expressions
meet the rules in an equi-join on the first four bytes of SHA-256; the whole
digest then confirms the hit, and the longest rule wins.

Defined cases: a null URL or one without ``://`` has an empty host and path and
meets no rule but one with both empty; equal rules that disagree: block wins;
rules with a null part are left out; repeated URLs are judged alike; no rules or
no URLs give no hits; the URL table's other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column) -> Column:
    """a.b.c: [a.b.c, b.c, c]."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def path_prefixes(path: Column, lengths: Column) -> Column:
    """The prefixes of those lengths that the path has."""
    return F.transform(F.filter(lengths, lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))


def _expression(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\x01"), path)


def _key(digest: Column) -> Column:
    """The first four bytes of a hexadecimal digest as a number."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def compile_rules(rules: DataFrame) -> DataFrame:
    """rules (host, path, verdict): one row for each host and path, with digest and hash prefix."""
    known = rules.filter("host is not null and path is not null and verdict in ('allow', 'block')")
    known = known.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    digest = F.sha2(_expression(F.col("host"), F.col("path")), 256)
    return known.select(F.concat("host", "path").alias("rule"), "verdict", F.length("path").alias("path_length"), digest.alias("digest"), _key(digest).alias("key"))


def url_verdicts(urls: DataFrame, rules: DataFrame, key: str = "page_id", default: str = "allow") -> DataFrame:
    """key, host, path, rule, verdict for each row of ``urls``.

    URLs that no rule fits get ``default``. The distinct lengths of rule paths go
    to the driver: one number for each, at most as many as a URL has characters.
    Expressions are looked up for distinct URLs only and hits alone are grouped,
    so that a host with a third of all pages costs no more than its distinct URLs.
    """
    compiled = compile_rules(rules)
    lengths = sorted(r[0] for r in compiled.select("path_length").distinct().collect())
    rows = urls.select(F.col(key), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    places = rows.select("host", "path").distinct()
    expanded = places.select(
        "host", "path", F.explode(host_suffixes(F.col("host"))).alias("h")
    ).select("host", "path", "h", F.explode(path_prefixes(F.col("path"), F.array(*map(F.lit, lengths)).cast("array<int>"))).alias("p"))
    digest = F.sha2(_expression(F.col("h"), F.col("p")), 256)
    candidates = expanded.select("host", "path", digest.alias("d")).withColumn("key", _key(F.col("d")))
    hits = candidates.join(compiled, "key").filter(F.col("d") == F.col("digest"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "path_length")).alias("hit"))
    return rows.join(best, ["host", "path"], "left").select(key, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))
