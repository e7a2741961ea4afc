"""Stored retrieval: chunks with their vectors and documents' postings, in segments of a versioned folder.

An upload writes its own rows only. Of each segment there are ``docs`` (a document's
terms by field), ``blocks`` (postings of some documents of like length: term, field,
their ids, counts and lengths, with the block's largest count and smallest length),
``terms`` and ``facts`` (what the segment adds to the statistics, and takes from them
for documents that it replaces) and ``gone`` (ids of earlier documents that it
replaces); of an upload of vectors ``points``, ``gone_points`` and ``failures``.
``merge`` makes one segment of all, without what was replaced.

A search for the k best reads the blocks' bounds first, scores the most promising
blocks, and reads of the others those that can still reach the k-th best score.

Defined cases: null texts have no terms and no chunks; null ids are left out, as they
can't be found again; rows that repeat an id count once, the one that a hash of its
columns picks; vectors that are null or of another dimension go to the failures; an
empty upload leaves a store as it is; a store that isn't there is empty; an upload
whose batch the store already has changes nothing.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.functions.batches import parts
from loomwell.operators import versions
from loomwell.operators.chunks import chunk_documents
from loomwell.operators.retrieval import _okapi, best, cosine, query_terms, tokens
from loomwell.operators.sequence import first_wins
from loomwell.operators.versions import Conflict, Version
from loomwell.sources.shared import shared_path, written

__all__ = ["Conflict", "written"]

POINT = "id string, original_id string, chunk_index int, total_chunks int, title string, content string, vector array<float>, segment int"
DOC = "id string, field string, dl int, longest int, terms array<string>, tfs array<int>, segment int"
BLOCK = "term string, field string, block long, ids array<string>, tfs array<int>, dls array<int>, max_tf int, min_dl int, segment int"
TERM, FACT, GONE = "term string, field string, df long", "field string, n long, total long", "id string, segment int"
FAILURE = "id string, reason string, segment int"
#: Documents whose postings are bounded together.
PER_BLOCK = 128


def create(spark: SparkSession, path: str) -> None:
    """An empty store, where there is none yet."""
    if not versions.current(spark, path).number:
        versions.commit(spark, path, Version(), [])


def known(docs: DataFrame) -> DataFrame:
    """The documents (id, title, content) that have an id, each id once."""
    rows = docs.select(F.col("id").cast("string").alias("id"), F.col("title").cast("string").alias("title"), F.col("content").cast("string").alias("content"))
    rows = rows.filter("id is not null")
    # only rows of repeated ids are put together, so that the other texts stay where they are
    repeated = written(rows.groupBy("id").count().filter("count > 1").select("id"), "repeated")
    return rows.join(repeated, "id", "left_anti").unionByName(first_wins(rows.join(repeated, "id", "left_semi"), ["id"], []))


def _live(rows: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """The rows that no later segment replaces."""
    g = gone.groupBy(F.col("id").alias("__gone")).agg(F.max("segment").alias("__by"))
    return rows.join(g, (F.col(key) == F.col("__gone")) & (F.col("segment") < F.col("__by")), "left_anti")


def _table(spark: SparkSession, path: str, version: Version, name: str, schema: str) -> DataFrame:
    return versions.rows(spark, path, version, name, schema)


def _last_gone(version: Version, gone: str) -> int:
    """The last segment that replaces rows: only those before it can have rows that are replaced."""
    return max((x["number"] for x in version.segments if gone in x["tables"]), default=0)


def _live_table(spark: SparkSession, path: str, version: Version, name: str, schema: str, gone: str, key: str) -> DataFrame:
    """A table's live rows. Segments that none comes after are read as they are, without a join."""
    last = _last_gone(version, gone)
    some = lambda old: Version(version.number, [x for x in version.segments if (x["number"] < last) == old])
    newer = _table(spark, path, some(False), name, schema)
    if not any(name in x["tables"] for x in some(True).segments):
        return newer
    return newer.unionByName(_live(_table(spark, path, some(True), name, schema), _table(spark, path, version, gone, GONE), key))


def documents(spark: SparkSession, path: str, version: Version | None = None) -> DataFrame:
    """The live documents' terms: id, field, dl, longest (field's dl), terms, their counts tfs, segment."""
    return _live_table(spark, path, version or versions.current(spark, path), "docs", DOC, "gone", "id")


def _counted(docs: DataFrame, sign: int) -> tuple[DataFrame, DataFrame]:
    """What documents add to the statistics of terms and of fields, or take from them."""
    one = F.lit(sign).cast("long")
    terms = docs.select("field", F.explode("terms").alias("term")).groupBy("term", "field").agg(F.sum(one).alias("df"))
    return terms, docs.groupBy("field").agg(F.sum(one).alias("n"), F.sum(one * F.col("dl")).alias("total"))


def _term_counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Of each list of words its distinct terms and their counts."""
    for whole in batches:
        for words in parts(whole):
            flat = words.flatten().dictionary_encode()
            size = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(words)), size)
            key, first, count = np.unique(row * max(len(flat.dictionary), 1) + flat.indices.to_numpy(), return_index=True, return_counts=True)
            ends = pa.array(np.searchsorted(row[first], np.arange(len(words) + 1)), pa.int32())
            terms = pa.ListArray.from_arrays(ends, flat.dictionary.take(flat.indices.take(pa.array(first))))
            yield pa.StructArray.from_arrays([terms, pa.ListArray.from_arrays(ends, pa.array(count, pa.int32()))], ["terms", "tfs"])


def _block(rows: pa.Table, number: int) -> pa.RecordBatch:
    """The postings of some documents: a row for each term and field."""
    rows = rows.combine_chunks()
    terms, tfs, field = rows["terms"].combine_chunks(), rows["tfs"].combine_chunks().flatten().to_numpy(), rows["field"].combine_chunks().dictionary_encode()
    flat = terms.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(rows)), pc.list_value_length(terms).to_numpy())
    term, kind = flat.indices.to_numpy(), field.indices.to_numpy()[row]
    order = np.argsort(term.astype(np.int64) * len(field.dictionary) + kind, kind="stable")  # rows stay in order
    term, kind, row, tfs = term[order], kind[order], row[order], tfs[order]
    begin = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (kind[1:] != kind[:-1])))) if len(term) else np.zeros(0, np.int64)
    dls, n = rows["dl"].to_numpy()[row], len(begin)
    ends = pa.array(np.append(begin, len(term)), pa.int32())
    listed = lambda values: pa.ListArray.from_arrays(ends, values)
    most, least = (np.maximum.reduceat(tfs, begin), np.minimum.reduceat(dls, begin)) if n else (tfs, dls)
    return pa.RecordBatch.from_arrays(
        [flat.dictionary.take(pa.array(term[begin])), field.dictionary.take(pa.array(kind[begin])), pa.array(np.full(n, number), pa.int64()), listed(rows["id"].combine_chunks().take(pa.array(row))), listed(pa.array(tfs, pa.int32())), listed(pa.array(dls, pa.int32())), pa.array(most, pa.int32()), pa.array(least, pa.int32()), pa.array(np.full(n, rows["segment"][0].as_py()), pa.int32())],
        _names(BLOCK),
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of a task's documents, which come in order; a task holds one block of them."""
    task, held, seen, last = TaskContext.get().partitionId() << 32, [], -1, None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch["id"]
        new = np.concatenate(([ids[0].as_py() != last], pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)))
        of, last = (seen + np.cumsum(new)) // PER_BLOCK, ids[-1].as_py()
        for lo, hi in itertools.pairwise([0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]):
            if held and held[-1][0] != of[lo]:
                yield _block(pa.Table.from_batches([b for _, b in held]), task + int(held[-1][0]))
                held.clear()
            held.append((of[lo], batch.slice(lo, hi - lo)))
        seen += int(new.sum())
    if held:
        yield _block(pa.Table.from_batches([b for _, b in held]), task + int(held[-1][0]))


def _index(docs: DataFrame, path: str, segment: dict, replaced: DataFrame | None) -> None:
    """The blocks and statistics of a segment whose documents are written.

    Documents go in ranges of their length, so that those of like length share a
    block, which makes the bound of its scores a close one. A document's rows have
    one key, so they come together, and move once; postings are made where they are.
    """
    ranged = docs.repartitionByRange("longest", "id").sortWithinPartitions("longest", "id", "field")
    blocks = ranged.mapInArrow(_blocks, BLOCK)
    # a search looks for terms in the files' row groups
    versions.put(blocks.sortWithinPartitions("term", "block"), path, segment, "blocks")
    terms, facts = _counted(docs, 1)
    if replaced is not None:
        less_terms, less_facts = _counted(replaced, -1)
        terms, facts = terms.unionByName(less_terms), facts.unionByName(less_facts)
    versions.put(terms.groupBy("term", "field").agg(F.sum("df").alias("df")).filter("df <> 0").sortWithinPartitions("term"), path, segment, "terms")
    versions.put(facts.groupBy("field").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), path, segment, "facts")


def index_texts(docs: DataFrame, path: str, fields: tuple[str, ...] = ("title", "content"), batch: str | None = None) -> Version:
    """Upserts the documents' postings: one new segment, and what it replaces."""
    spark, version = docs.sparkSession, versions.current(docs.sparkSession, path)
    if batch is not None and f"texts:{batch}" in version.batches:
        return version
    segment = versions.new_segment(version, batch and f"texts:{batch}")
    number = F.lit(segment["number"])
    words = known(docs).select("id", *[tokens(F.col(f)).alias(f) for f in fields])
    longest = F.greatest(*[F.size(f) for f in fields]) if len(fields) > 1 else F.size(fields[0])
    # a field without words keeps a row, so that it counts among the documents and in their mean length
    each = words.select("id", longest.alias("longest"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("words")) for f in fields])).alias("f"))
    counts = F.arrow_udf(_term_counts, "terms array<string>, tfs array<int>")
    counted = each.select("id", "f.field", F.size("f.words").alias("dl"), "longest", counts("f.words").alias("c"))
    new = versions.put(counted.select("id", "field", "dl", "longest", "c.terms", "c.tfs", number.alias("segment")), path, segment, "docs")
    if new.isEmpty():
        return version
    replaced = None
    if any("docs" in s["tables"] for s in version.segments):
        before = documents(spark, path, version)
        gone = versions.put(before.select("id").distinct().join(new.select("id"), "id", "left_semi").withColumn("segment", number), path, segment, "gone")
        replaced = before.join(gone.select("id"), "id", "left_semi")
    _index(new, path, segment, replaced)
    return versions.commit(spark, path, version, [*version.segments, segment])


@dataclass(frozen=True)
class Search:
    """A search's hits, and how many of the terms' blocks it had to read of how many."""

    hits: DataFrame
    blocks_read: int
    blocks: int


def _bound(tf: Column, dl: Column, stats: dict, boosts: dict[str, float], k1: float, b: float) -> Column:
    """The score of a count and a length for the row's term and field, from the statistics of the query's terms."""
    out = F.lit(0.0)
    for (term, field), (df, n, average) in stats.items():
        score = _okapi(tf, F.lit(df), F.lit(n), dl, F.lit(average), float(boosts[field]), k1, b)
        out = F.when((F.col("term") == term) & (F.col("field") == field), score).otherwise(out)
    return out


def searched(spark: SparkSession, path: str, query: str, boosts: dict[str, float], k: int | None, min_score: float = 0.1, k1: float = 1.2, b: float = 0.75, version: Version | None = None) -> Search:
    """The k best documents by the scores of ``retrieval.bm25``; with k None all that reach ``min_score``, from all blocks."""
    version, terms = version or versions.current(spark, path), query_terms(query)
    asked = F.col("term").isin(*terms) & F.col("field").isin(*boosts)
    counted = _table(spark, path, version, "terms", TERM).filter(asked).groupBy("term", "field").agg(F.sum("df").alias("df"))
    facts = _table(spark, path, version, "facts", FACT).groupBy("field").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    # a row for each term of the query and field
    stats = {(r.term, r.field): (r.df, r.n, r.total / r.n) for r in counted.join(facts, "field").filter("df > 0 and n > 0").collect()}
    blocks = _table(spark, path, version, "blocks", BLOCK).filter(asked)
    gone, last = _table(spark, path, version, "gone", GONE) if any("gone" in s["tables"] for s in version.segments) else None, _last_gone(version, "gone")

    def scores(some: DataFrame) -> DataFrame:
        each = some.select("term", "field", "segment", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p")).select("term", "field", "segment", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"))
        if gone is not None:
            each = each.filter(F.col("segment") >= last).unionByName(_live(each.filter(F.col("segment") < last), gone))
        return each.select("id", _bound(F.col("tf"), F.col("dl"), stats, boosts, k1, b).alias("s")).groupBy("id").agg(F.sum("s").alias("score")).filter("score > 0")

    if k is None:
        n = blocks.count()
        return Search(best(scores(blocks), "id", None, min_score), n, n)
    place = F.struct("segment", "block")
    most = blocks.select(place.alias("place"), _bound(F.col("max_tf"), F.col("min_dl"), stats, boosts, k1, b).alias("most"))
    bounds = written(most.groupBy("place").agg(F.sum("most").alias("most"), F.count(F.lit(1)).alias("n")), "bounds")
    first = bounds.orderBy(F.col("most").desc(), "place").limit(4 + 2 * k // PER_BLOCK)
    here = lambda chosen: blocks.join(chosen.select("place.segment", "place.block"), ["segment", "block"], "left_semi")
    tried = best(scores(here(first)), "id", k, min_score).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).first()
    # a block whose bound is under the k-th best score so far can't change the k best; sums may differ in their last digits
    reach = max(min_score, tried.least if tried.n == k else min_score) * (1 - 1e-9)
    left = bounds.filter(F.col("most") >= reach)
    share = bounds.agg(F.sum(F.when(F.col("most") >= reach, F.col("n"))).alias("read"), F.sum("n").alias("all")).first()
    return Search(best(scores(here(left)), "id", k, min_score), share["read"] or 0, share["all"] or 0)


def search_texts(spark: SparkSession, path: str, query: str, boosts: dict[str, float], k: int | None, min_score: float = 0.1, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) as ``retrieval.bm25``, from the blocks that can reach the k best."""
    return searched(spark, path, query, boosts, k, min_score, k1, b).hits


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def points(spark: SparkSession, path: str, version: Version | None = None) -> DataFrame:
    """The live points."""
    return _live_table(spark, path, version or versions.current(spark, path), "points", POINT, "gone_points", "original_id")


def upsert_points(docs: DataFrame, path: str, embed: Callable[[Column], Column], dimension: int, target: int = 2000, cap: int = 8000, batch: str | None = None) -> DataFrame:
    """Chunks the documents, embeds the chunks and puts them in place of the documents' old ones; gives (id, ok) of each document.

    embed: a text column to an array of floats. A document with a chunk whose
    vector isn't there or has another dimension is a row of ``failures``, and keeps
    its old points. A batch that the store has already gives (id, ok) as it was then.
    """
    spark, version, one = docs.sparkSession, versions.current(docs.sparkSession, path), known(docs)
    if batch is not None and f"points:{batch}" in version.batches:
        failed = _table(spark, path, version, "failures", FAILURE).filter(F.col("segment") == next(s["number"] for s in version.segments if s["batch"] == f"points:{batch}"))
        return one.select("id").join(failed.select("id", F.lit(False).alias("ok")), "id", "left").select("id", F.coalesce("ok", F.lit(True)).alias("ok"))
    segment = versions.new_segment(version, batch and f"points:{batch}")
    number = F.lit(segment["number"])
    chunks = chunk_documents(one, "id", "content", target, cap).join(one.select("id", "title"), "id")
    made = chunks.select(F.concat_ws("#", "id", "chunk_index").alias("id"), F.col("id").alias("original_id"), "chunk_index", "total_chunks", "title", F.col("chunk").alias("content"), embed(F.col("chunk")).cast("array<float>").alias("vector"), number.alias("segment"))
    made = written(made, "points")
    bad = made.filter(~F.coalesce(F.size("vector") == dimension, F.lit(False)))
    reason = F.when(F.col("vector").isNull(), "no vector").otherwise(F.concat(F.lit("dimension "), F.size("vector").cast("string")))
    failures = versions.put(bad.groupBy(F.col("original_id").alias("id")).agg(F.min(reason).alias("reason")).withColumn("segment", number), path, segment, "failures")
    outcome = written(one.select("id").join(failures.select("id", F.lit(False).alias("ok")), "id", "left").select("id", F.coalesce("ok", F.lit(True)).alias("ok")), "outcome")
    if outcome.isEmpty():
        return outcome
    fine = outcome.filter("ok").select("id")
    versions.put(made.join(fine.withColumnRenamed("id", "original_id"), "original_id", "left_semi").select(*_names(POINT)), path, segment, "points")
    if any("points" in s["tables"] for s in version.segments):
        before = points(spark, path, version).select(F.col("original_id").alias("id")).distinct()
        versions.put(before.join(fine, "id", "left_semi").withColumn("segment", number), path, segment, "gone_points")
    versions.commit(spark, path, version, [*version.segments, segment])
    return outcome


def failures(spark: SparkSession, path: str) -> DataFrame:
    """id, reason, segment: the documents whose vectors could not be stored, by upload."""
    return _table(spark, path, versions.current(spark, path), "failures", FAILURE)


def search_points(spark: SparkSession, path: str, query: list[float], k: int | None, threshold: float | None = None) -> DataFrame:
    """(id, original_id, chunk_index, title, content, score): the k nearest chunks by cosine."""
    usable = points(spark, path).filter(F.size("vector") == len(query))
    scored = usable.withColumn("score", cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in query]))).drop("vector", "total_chunks", "segment")
    return best(scored, "id", k, threshold)


def merge(spark: SparkSession, path: str) -> Version:
    """One segment of all, without what was replaced. Failures and the names of batches stay."""
    version = versions.current(spark, path)
    if len(version.segments) < 2:
        return version
    segment = versions.new_segment(version) | {"batches": sorted(version.batches)}
    number = F.lit(segment["number"])
    docs = versions.put(documents(spark, path, version).withColumn("segment", number), path, segment, "docs")
    _index(docs, path, segment, None)
    versions.put(points(spark, path, version).withColumn("segment", number), path, segment, "points")
    versions.put(_table(spark, path, version, "failures", FAILURE), path, segment, "failures")
    return versions.commit(spark, path, version, [segment])


def delete_all(spark: SparkSession, path: str) -> None:
    """A version without rows. The names of batches go too."""
    versions.commit(spark, path, versions.current(spark, path), [])


def info(spark: SparkSession, path: str) -> DataFrame:
    """One row: points, documents in the text index, and points for each of them (0 for none)."""
    version = versions.current(spark, path)
    stored = points(spark, path, version).agg(F.count(F.lit(1)).alias("points"))
    each = _table(spark, path, version, "facts", FACT).groupBy("field").agg(F.sum("n").alias("n"))
    indexed = each.agg(F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("documents"))
    return stored.crossJoin(indexed).withColumn("chunk_ratio", chunk_ratio(F.col("points"), F.col("documents")))  # one row each


def chunk_ratio(points: Column, documents: Column) -> Column:
    return F.when(documents > 0, F.round(points / documents, 2)).otherwise(0.0)


def new_store(spark: SparkSession) -> str:
    """A path for a store in the shared folder."""
    return shared_path(spark, "store")
