"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.llm import alignment, arc_warc, html_crf, importance, jpeg_dc, license_rules, mixing, packing, quality_rules, reshard, simhash, sp_wfst, url_rules
from loomwell.llm.common import table

# The rules of the URL query.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    return quality_rules.quality_rules(docs, rules)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "labels").select("doc_id", mixing.domain_of_labels().alias("domain"))
    return mixing.document_rates(table(spark, sf_dir, "documents"), labelled)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_wfst.encode(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = arc_warc.pages_through_archives(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 32 shards by text checksum, equal texts together, to 40 of near equal bytes."""
    checksum = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    files, _ = reshard.reshard(table(spark, sf_dir, "documents"), checksum % 32, 40)
    t = F.coalesce("text", F.lit(""))
    size = (F.octet_length(t) + F.lit(reshard.ROW_OVERHEAD)).cast("long")
    return files.select("doc_id", size.alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.url_verdicts(table(spark, sf_dir, "pages"), rules)


def op9_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg_dc.text_media(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.license_scan(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.linked(table(spark, sf_dir, "documents")).documents.withColumnRenamed("digest", "groups_sha256")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_html_extraction": op2_html_extraction,
    "op3_mixing": op3_mixing,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_simhash": op5_simhash,
    "op6_warc": op6_warc,
    "op7_reshard": op7_reshard,
    "op8_url_filters": op8_url_filters,
    "op9_jpeg_media": op9_jpeg_media,
    "op10_license_scan": op10_license_scan,
    "op11_alignment": op11_alignment,
    "op12_packing": op12_packing,
    "op13_importance": op13_importance,
}

ORACLE_SQL: dict[str, str] = {
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS hex, max(page_id) OVER (PARTITION BY h) AS last, row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST) AS place FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
           (('0x' || substr(hex, 1 + (i // 4) * 5, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN place = 1 OR last IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place > 1 THEN last END AS refers_to
FROM d
""",
    "op8_url_filters": f"""
WITH rules(h, p, v) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
urls AS (SELECT page_id, row_number() OVER () AS rn,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
hits AS (SELECT rn, arg_max(h || p, length(h || p) * 100000 + length(p)) AS rule, arg_max(v, length(h || p) * 100000 + length(p)) AS v
         FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rn)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM urls LEFT JOIN hits USING (rn)
""",
    "op10_license_scan": license_rules.oracle_sql(),
    "op13_importance": importance.oracle_sql(),
}
