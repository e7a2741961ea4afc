"""Importance resampling towards a target: hashed n-gram features, log ratios, Gumbel top k.

Each task has a DuckDB of its own, with a registered CRC-32 function: SQL unnests a
text's words, windows join them to n-grams, and each text's features are counted by
bucket. Those counts go to Parquet, in Spark's own commit, so that a task that is
run again counts once. Spark merges them to the corpus' counts, from which come the
buckets' gains, and scores each text by the counts already there: texts are read
once. Every text is counted and scored; the draw is an exact top k by ranges.

Defined cases: a null, empty or wordless text has no features, weight 0 and is never
drawn where ``least`` words are asked; a null key has no score, isn't drawn and
doesn't count for the share to draw; repeated rows are rows of their own and their
equal scores take neighbouring ranks; an empty target leaves the documents' own
counts against uniform smoothing; empty documents give an empty result. Texts are
taken whole; a slice of a task's texts is bounded in rows and bytes, and DuckDB
spills what is beyond its memory. Other columns don't ride along.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwell.llm.common import written
from loomwell.llm.tokens import sums
from loomwell.operators.sequence import numbered

#: A word: ASCII digits and letters, and all characters above ASCII; the text is in lower case by then.
FEATURE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def feature_sql(n: int, buckets: int) -> str:
    """Bucket counts of each row of ``slice`` (row, text): row, words, buckets, counts. Runs of 1 to n words."""
    grams = ["SELECT row, word AS feature FROM words"]
    for k in range(2, n + 1):
        run = " || ' ' || ".join(["word", *(f"lead(word, {i}) OVER w" for i in range(1, k))])
        grams.append(f"SELECT row, {run} AS feature FROM words WINDOW w AS (PARTITION BY row ORDER BY place)")
    found = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{FEATURE_WORD}')"
    return f"""
WITH found AS MATERIALIZED (SELECT row, {found} AS words FROM slice),
words AS (SELECT row, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM found),
features AS MATERIALIZED (SELECT row, feature, count(*) AS n FROM ({" UNION ALL ".join(grams)}) WHERE feature IS NOT NULL GROUP BY ALL),
hashed AS (SELECT feature, crc(feature) % {buckets} AS bucket FROM (SELECT DISTINCT feature FROM features)),
counted AS (SELECT row, bucket, sum(n)::BIGINT AS n FROM features JOIN hashed USING (feature) GROUP BY ALL),
listed AS (SELECT row, list(bucket ORDER BY bucket)::INTEGER[] AS buckets, list(n ORDER BY bucket) AS counts FROM counted GROUP BY row)
SELECT found.row, len(words)::BIGINT AS words, coalesce(buckets, []::INTEGER[]) AS buckets, coalesce(counts, []::BIGINT[]) AS counts
FROM found LEFT JOIN listed USING (row) ORDER BY found.row
"""


def _crc(words: pa.Array) -> pa.Array:
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    return pa.array([zlib.crc32(w.encode()) for w in words.to_pylist()], pa.int64())


@contextmanager
def feature_counter(memory: str = "256MB"):
    """A DuckDB with the function crc, of one thread, that spills to a folder of its own, which goes with it."""
    import duckdb

    with tempfile.TemporaryDirectory(prefix="features-") as folder:
        con = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": folder})
        try:
            con.create_function("crc", _crc, ["VARCHAR"], "BIGINT", type="arrow")
            yield con
        finally:
            con.close()


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1024, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Stretches of at most so many rows and bytes, or of one row."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(size[at - 1]) if at else 0
            to = min(max(int(np.searchsorted(size, before + most, "right")), at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def bucket_counts(docs: DataFrame, n: int, buckets: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, item (a number of the row), words, buckets, counts: each text's features by bucket, as a table."""
    if n < 1 or buckets < 1:
        raise ValueError("n and buckets are at least 1")
    sql = feature_sql(n, buckets)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        with feature_counter() as con:
            for batch in _slices(batches):
                con.register("slice", pa.table({"row": pa.array(np.arange(batch.num_rows)), "text": batch.column(1)}))
                got = con.sql(sql).to_arrow_table().combine_chunks()
                con.unregister("slice")
                columns = [got[c].chunk(0) for c in ("words", "buckets", "counts")]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arange(first, first + batch.num_rows)), *columns], ["key", "item", "words", "buckets", "counts"])
                first += batch.num_rows

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return written(rows.mapInArrow(work, f"key {kind}, item long, words long, buckets array<int>, counts array<long>"), "bucket-counts")


def merged(counted: DataFrame) -> DataFrame:
    """bucket, n: the counts of all rows together, ``buckets`` rows at most."""
    pairs = counted.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).select("x.buckets", "x.counts")
    return pairs.groupBy(F.col("buckets").alias("bucket")).agg(F.sum("counts").alias("n"))


def gains(own: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain: 1000 times the log of the smoothed target share over the own share, floored, of all ``buckets``."""
    spark = own.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(own.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
    both = both.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    totals = both.agg(F.sum("s").alias("S"), F.sum("t").alias("T")).first()
    own_all, target_all = float(totals.S or 0) + buckets, float(totals.T or 0) + buckets
    ratio = (F.col("t") + 1) * F.lit(own_all) / ((F.col("s") + 1) * F.lit(target_all))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weighed(counted: DataFrame, gain: DataFrame, buckets: int) -> DataFrame:
    """key, item, words, n_features, weight. The gains are ``buckets`` numbers, a fixed bound, and go to the tasks whole."""
    table = np.zeros(buckets, np.int64)
    for r in gain.collect():
        table[r.bucket] = r.gain
    shared = counted.sparkSession.sparkContext.broadcast(table)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, count = batch.column(3), batch.column(4).flatten().to_numpy(zero_copy_only=False)
            n = where.value_lengths().to_numpy(zero_copy_only=False)
            weight = sums(shared.value[where.flatten().to_numpy(zero_copy_only=False)] * count, n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums(count, n)), pa.array(weight)], ["key", "item", "words", "n_features", "weight"])

    rows = counted.select("key", "item", "words", "buckets", "counts")
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(work, f"key {kind}, item long, words long, n_features long, weight long")


def noise(key: Column, seed: str) -> Column:
    """1000 times a Gumbel variate, floored, from the first 32 bits of a hash of seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), key.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least: int = 20, seed: str = "2024", key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """key, words, n_features, weight, score, rank of each row; ``percent`` of those with ``least`` words or more are drawn
    without replacement in proportion to their weights (rank 1, 2, ...), the others have no rank."""
    counted = bucket_counts(docs, n, buckets, key, text)
    aims = bucket_counts(target.select(F.lit(0).alias("key"), F.col(target_text).alias("text")), n, buckets, "key", "text")
    gain = gains(merged(counted), merged(aims), buckets)
    scored = written(weighed(counted, gain, buckets).withColumn("score", F.col("weight") + noise(F.col("key"), seed)), "scored")
    fit = (F.col("words") >= least) & F.col("score").isNotNull()
    drawn = scored.filter(fit).count() * percent // 100
    ordered = numbered(scored.filter(fit).withColumn("__low", -F.col("score")), ["__low", "key", "item"], "place", 1)
    ranked = ordered.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")).cast("long"))
    names = ["key", "words", "n_features", "weight", "score", "rank"]
    return ranked.select(*names).unionByName(scored.filter(~fit).withColumn("rank", F.lit(None).cast("long")).select(*names)).withColumnRenamed("key", key)


def oracle_sql(buckets: int = 10_000, percent: int = 10, least: int = 20, seed: str = "2024") -> str:
    """The same for runs of one word, CRC-32 worked out by SQL on each distinct word."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{FEATURE_WORD}')"
    step = lambda c: f"CASE WHEN {c} & 1 = 1 THEN xor({c} >> 1, 3988292384) ELSE {c} >> 1 END"
    return f"""
WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i::BIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, {step("c")} FROM bits WHERE k < 8),
crcs AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS rn, doc_id, {words} AS ws FROM documents),
df AS (SELECT rn, unnest(ws) AS w FROM d),
bf AS (SELECT unnest({words}) AS w FROM benchmark),
distinct_words AS (SELECT DISTINCT w FROM (SELECT w FROM df UNION ALL SELECT w FROM bf)),
hashed AS (SELECT w, xor(list_reduce(list_transform(range(len(hex(encode(w))) // 2), lambda i: ('0x' || substr(hex(encode(w)), 1 + 2 * i::INTEGER, 2))::BIGINT),
    lambda acc, x: xor(acc >> 8, t[(xor(acc, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % {buckets} AS b FROM distinct_words, crcs),
s AS (SELECT b, count(*) AS s FROM df JOIN hashed USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM bf JOIN hashed USING (w) GROUP BY b),
totals AS (SELECT (SELECT count(*) FROM df)::DOUBLE + {buckets} AS sa, (SELECT count(*) FROM bf)::DOUBLE + {buckets} AS ta),
gain AS (SELECT b, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * sa / ((s::DOUBLE + 1) * ta)))::BIGINT AS gain FROM s LEFT JOIN t USING (b), totals),
weights AS (SELECT rn, sum(gain)::BIGINT AS weight FROM df JOIN hashed USING (w) JOIN gain USING (b) GROUP BY rn),
scored AS (SELECT rn, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM d LEFT JOIN weights USING (rn)),
fit AS (SELECT rn, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () * {percent} // 100 AS k FROM scored WHERE n_features >= {least} AND score IS NOT NULL)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= k THEN place END AS rank FROM scored LEFT JOIN fit USING (rn)
"""
