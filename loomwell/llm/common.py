"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.sources.shared import shared_path, written

__all__ = ["WORD", "hot_keys", "let", "shared_path", "table", "written"]

#: A word of a text: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hot_keys(df: DataFrame, key: str, total: int, share: int = 200) -> DataFrame:
    """Keys that hold at least 1/share of ``total`` rows: at most ``share`` rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") * share >= F.lit(total)).select(key)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for each row, however often the
    body uses it and wherever the optimiser moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
