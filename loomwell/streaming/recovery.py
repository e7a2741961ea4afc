"""Results of a stream in the versioned store, so that a batch that is run again counts once.

Each micro-batch is one segment of a versioned folder, which carries the query's name
and the batch's number: when the stream starts again from its checkpoint and repeats a
batch whose end it had not noted, the folder has that batch already. A batch that died
before its version was made has left no trace.

Defined cases: an empty batch writes nothing; of a batch's rows of one key the one that
comes last by ``order`` stays; a null key is a key like any other; a folder that isn't
there has no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomwell.operators import versions
from loomwell.operators.sequence import last_wins

TABLE = "rows"


def put_batch(df: DataFrame, path: str, keys: list[str], order: list[Column], batch: str, attempts: int = 5) -> bool:
    """Upserts a batch's last rows by key; False where the folder has the batch already, or it is empty."""
    spark = df.sparkSession
    for attempt in range(attempts):
        version = versions.current(spark, path)
        if batch in version.batches:
            df.write.format("noop").mode("overwrite").save()  # the stream's own state has to go through the batch all the same
            return False
        segment = versions.new_segment(version, batch)
        if versions.put(last_wins(df, keys, order).withColumn("segment", F.lit(segment["number"])), path, segment, TABLE).isEmpty():
            return False
        try:
            versions.commit(spark, path, version, [*version.segments, segment])
            return True
        except versions.Conflict:
            if attempt == attempts - 1:
                raise
    return False


def latest(spark: SparkSession, path: str, keys: list[str], schema: str) -> DataFrame:
    """The row of each key from the newest segment that has it."""
    rows = versions.rows(spark, path, versions.current(spark, path), TABLE, schema + ", segment int")
    return last_wins(rows, keys, [F.col("segment")]).drop("segment")


def write_latest(stream: DataFrame, path: str, keys: list[str], order: list[Column], checkpoint: str, name: str, after: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Starts a query that keeps the last row of each key in the folder. ``after`` is called with each batch once it is stored."""

    def store(df: DataFrame, number: int) -> None:
        put_batch(df, path, keys, order, f"{name}:{number}")
        if after is not None:
            after(df, number)

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(store)
    return (writer.trigger(**trigger) if trigger else writer).start()
