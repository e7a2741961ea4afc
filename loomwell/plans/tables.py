"""The driver's tables in the shapes that the operators take, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as menu links."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS id", "concat('doc_', doc_id) AS document_id", "concat(lang, '^', source) AS menu_path", "concat('doc/', doc_id) AS pc_url",
        "CASE WHEN lang = 'en' THEN concat('m/', doc_id) END AS mobile_url", "source AS created_by",
        "CASE WHEN source <> 'src3' THEN date_add(date'2024-01-01', cast(n_chars % 900 AS int)) END AS created_at",
        "CASE WHEN lang <> 'de' THEN date_add(date'2026-01-01', cast(n_chars % 7 AS int)) END AS updated_at",
    )


LINKS = """links AS (SELECT doc_id AS id, 'doc_' || doc_id AS document_id, lang || '^' || source AS menu_path, 'doc/' || doc_id AS pc_url,
  CASE WHEN lang = 'en' THEN 'm/' || doc_id END AS mobile_url, source AS created_by,
  CASE WHEN source <> 'src3' THEN DATE '2024-01-01' + CAST(n_chars % 900 AS INTEGER) END AS created_at,
  CASE WHEN lang <> 'de' THEN DATE '2026-01-01' + CAST(n_chars % 7 AS INTEGER) END AS updated_at FROM documents)"""


def managers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` as managers of links."""
    return table(spark, sf_dir, "labels").selectExpr("doc_id AS menu_id", "concat('team ', quality) AS team_name", "concat('manager ', toxic) AS manager_names")


MANAGERS = "managers AS (SELECT doc_id AS menu_id, 'team ' || quality AS team_name, 'manager ' || toxic AS manager_names FROM labels)"


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as a crawl queue."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "concat('q/', o_custkey) AS pc_url", "cast(substr(o_orderpriority, 1, 1) AS int) AS priority", "o_totalprice > 150000 AS is_active",
        "CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'failed' END AS last_status", "o_orderdate AS last_crawled_at", "cast(null AS string) AS last_error",
        "CASE WHEN o_orderstatus = 'O' THEN 'faq_list' WHEN o_orderstatus = 'F' THEN 'detail' END AS handler_name",
    )


QUEUE = """queue AS (SELECT o_orderkey AS id, 'q/' || o_custkey AS pc_url, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, o_totalprice > 150000 AS is_active,
  CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'failed' END AS last_status,
  CASE WHEN o_orderstatus = 'O' THEN 'faq_list' WHEN o_orderstatus = 'F' THEN 'detail' END AS handler_name FROM orders)"""


def old_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a snapshot; Spanish ones share a URL in twos, so that keys repeat."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"), F.expr("CASE WHEN lang = 'es' THEN concat('doc/', doc_id div 2) ELSE concat('doc/', doc_id) END").alias("url"),
        F.when(F.col("source") != "src7", F.concat(F.lit("m/"), F.col("doc_id"))).alias("murl"), F.array("lang", "source").alias("hierarchy"), "text",
    )


def new_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old one with src1 moved to new URLs, French texts longer, German ones in other white space, src2 without mobile URLs."""
    old = old_snapshot(spark, sf_dir)
    lang, source = F.get("hierarchy", F.lit(0)), F.get("hierarchy", F.lit(1))
    return old.select(
        "ord", F.when(source == "src1", F.concat(F.lit("new/"), "url")).otherwise(F.col("url")).alias("url"), F.when(source == "src2", F.lit("")).otherwise(F.col("murl")).alias("murl"), "hierarchy",
        F.when(lang == "fr", F.concat("text", F.lit(" plus javascript"))).when(lang == "de", F.replace("text", F.lit(" "), F.lit("  "))).otherwise(F.col("text")).alias("text"),
    )


SNAPSHOTS = """old_snap AS (SELECT doc_id AS ord, CASE WHEN lang = 'es' THEN 'doc/' || (doc_id // 2) ELSE 'doc/' || doc_id END AS url, CASE WHEN source <> 'src7' THEN 'm/' || doc_id END AS murl, [lang, source] AS hierarchy, text FROM documents),
new_snap AS (SELECT ord, CASE WHEN hierarchy[2] = 'src1' THEN 'new/' || url ELSE url END AS url, CASE WHEN hierarchy[2] = 'src2' THEN '' ELSE murl END AS murl, hierarchy,
  CASE hierarchy[1] WHEN 'fr' THEN text || ' plus javascript' WHEN 'de' THEN replace(text, ' ', '  ') ELSE text END AS text FROM old_snap),
old_one AS (SELECT url || '|["' || array_to_string(hierarchy, '", "') || '"]' AS object_key, arg_max(text, ord) AS text, max(ord) AS ord FROM old_snap GROUP BY 1),
new_one AS (SELECT url || '|["' || array_to_string(hierarchy, '", "') || '"]' AS object_key, arg_max(text, ord) AS text, max(ord) AS ord FROM new_snap GROUP BY 1),
old_last AS (SELECT o.object_key, o.text, s.murl FROM old_one o JOIN old_snap s USING (ord)),
new_last AS (SELECT n.object_key, n.text, s.murl FROM new_one n JOIN new_snap s USING (ord)),
pairs AS (SELECT coalesce(o.object_key, n.object_key) AS object_key, o.text AS old_text, n.text AS new_text, o.murl AS old_murl, n.murl AS new_murl,
  CASE WHEN o.object_key IS NULL THEN 'added' WHEN n.object_key IS NULL THEN 'removed' ELSE 'common' END AS state FROM old_last o FULL JOIN new_last n USING (object_key)),
cells AS (SELECT object_key, 'text' AS field, old_text AS old_value, new_text AS new_value FROM pairs WHERE state = 'common' UNION ALL SELECT object_key, 'murl', old_murl, new_murl FROM pairs WHERE state = 'common'),
changes AS (SELECT *, CASE WHEN old_value IS NULL THEN 'field_added' WHEN new_value IS NULL THEN 'field_removed' ELSE 'field_modified' END AS type FROM cells
  WHERE trim(regexp_replace(nfc_normalize(old_value), '\\s+', ' ', 'g')) IS DISTINCT FROM trim(regexp_replace(nfc_normalize(new_value), '\\s+', ' ', 'g')))"""


def menu_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` with their URL as a menu path: host and path segments."""
    path = F.concat_ws("^", F.regexp_extract("url", "://([^/?#]*)", 1), F.replace(F.regexp_extract("url", r"://[^/?#]*/([^?#]*)", 1), F.lit("/"), F.lit("^")))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", path.alias("menu_path"))


MENU_PAGES = """menu_pages AS (SELECT page_id AS id, url, regexp_extract(url, '://([^/?#]*)', 1) || '^' || replace(regexp_extract(url, '://[^/?#]*/([^?#]*)', 1), '/', '^') AS menu_path FROM pages),
segs AS (SELECT id, list_filter(list_transform(string_split(menu_path, '^'), lambda x: trim(x)), lambda x: x <> '') AS s FROM menu_pages),
nodes AS (SELECT id, array_to_string(s, '^') AS leaf, array_to_string(s[1:k], '^') AS node FROM segs, LATERAL (SELECT unnest(range(1, len(s) + 1)) AS k))"""


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as progress events: a user's events are a task's, of kinds by event type."""
    return table(spark, sf_dir, "events").selectExpr(
        "cast(user_id AS string) AS task_id", "event_id AS ord",
        "CASE WHEN event_type = 'signup' THEN 'connected' WHEN event_type = 'view' THEN 'status' WHEN event_type = 'error' AND value > 150 THEN 'complete' WHEN event_type = 'error' AND value > 120 THEN 'error' WHEN event_type = 'error' THEN 'status' ELSE 'progress' END AS type",
        "cast(floor(value) AS bigint) AS current", "cast(100 AS bigint) AS total", "CASE WHEN value > 20 THEN cast(floor(value / 2) AS bigint) END AS success",
        "CASE WHEN value < 70 THEN cast(floor(value / 10) AS bigint) END AS failed", "concat('u/', event_id) AS url", "CASE WHEN event_type = 'view' THEN concat('at ', event_id) END AS message",
    )


PROGRESS = """progress AS (SELECT CAST(user_id AS VARCHAR) AS task_id, event_id AS ord,
  CASE WHEN event_type = 'signup' THEN 'connected' WHEN event_type = 'view' THEN 'status' WHEN event_type = 'error' AND value > 150 THEN 'complete' WHEN event_type = 'error' AND value > 120 THEN 'error' WHEN event_type = 'error' THEN 'status' ELSE 'progress' END AS type,
  CAST(floor(value) AS BIGINT) AS current, CAST(100 AS BIGINT) AS total, CASE WHEN value > 20 THEN CAST(floor(value / 2) AS BIGINT) END AS success,
  CASE WHEN value < 70 THEN CAST(floor(value / 10) AS BIGINT) END AS failed, 'u/' || event_id AS url, CASE WHEN event_type = 'view' THEN 'at ' || event_id END AS message FROM events)"""
