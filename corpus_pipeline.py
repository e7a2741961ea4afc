"""A training-data pipeline over ``documents``: quality rules, near-duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept. ``run`` writes each stage's result as a table in the shared folder and
reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwell.llm import mixing, near_copies, quality_rules, sp_wfst
from loomwell.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rule or the learned rules reject.

    Null and empty texts fail the base rule; an empty table stays empty.
    """
    return quality_rules.keep_good(docs, quality_rules.learn(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near copies, the one with the smallest id.

    Links are pairs whose sets of 5-word shingles have a Jaccard similarity of 0.8
    or more. Of rows that repeat id and words one stays; an empty table stays empty.
    """
    return near_copies.keep_one(docs, size=5, least=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents by their rates, so that expected domain tokens meet the targets.

    Null and empty texts have the rate of a text without words; equal rows have equal
    rates, and equal ids are drawn alike; texts count whole; an empty table stays empty.
    """
    labelled = table(spark, sf_dir, "labels").select("doc_id", mixing.domain_of_labels().alias("domain"))
    return mixing.mixed(docs, labelled)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, n_byte_tokens, round_trip of each document.

    Null and empty texts have no tokens; texts of any length are encoded whole;
    repeated rows get rows of their own; an empty table stays empty.
    """
    # the workers of the stages before still hold their own memory, so this one remembers less
    return sp_wfst.encode(docs, remember=40_000_000)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("mixing", mix), ("tokens", tokens)]

#: The learned rules, the classifier and the pieces aren't SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
