"""An index for vector search: cells around centres, with a bound for what each cell can hold.

The centres come from a documented, bounded sample (k-means on unit vectors); every
vector is then assigned to its nearest centre, and each cell keeps the widest angle
between its centre and its vectors. No vector of a cell is nearer to a query than the
angle between query and centre less that width. So a search scores the most promising
cells first, and of the others those whose bound reaches the k-th best score: the
result is exact. With ``probes`` it reads that many cells and no more.

Defined cases: null vectors, those without a direction and those of another dimension
are in no cell and are no hits; repeated rows are hits of their own; equal scores are
ordered by key; an index of an empty table finds nothing; other columns ride along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwell.operators.retrieval import best, cosine, dot
from loomwell.sources.shared import written


@dataclass(frozen=True)
class Index:
    """``vectors``: the table with column ``cell``, sorted by it; ``centres``: unit vectors by cell; ``widths``: each cell's widest angle, of cells that have vectors."""

    vectors: DataFrame
    centres: np.ndarray
    widths: dict[int, float]
    key: str
    column: str


def _unit(vector: Column) -> Column:
    """The vector at length 1; null for one without a direction."""
    v = vector.cast("array<double>")
    size = F.sqrt(dot(v, v))
    return F.when((size > 0) & (size < float("inf")), F.transform(v, lambda x: x / size))


def build(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", cells: int = 64, sample: int = 20_000, seed: int = 7) -> Index:
    """Indexes all vectors. ``sample``: so many of them at most, told by a hash of the key, fit the centres;
    cells x dimension numbers go to the tasks whole."""
    usable = vectors.withColumn("__unit", _unit(F.col(column))).filter("__unit is not null")
    sizes = usable.groupBy(F.size("__unit").alias("n")).count().orderBy(F.col("count").desc(), "n").limit(1).collect()
    if not sizes:
        return Index(vectors.limit(0).withColumn("cell", F.lit(0)), np.zeros((0, 0)), {}, key, column)
    usable = usable.filter(F.size("__unit") == sizes[0].n)
    total = sizes[0]["count"]
    chosen = usable if total <= sample else usable.filter(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int(sample / total * (1 << 30)))
    model = KMeans(k=min(cells, total), seed=seed, maxIter=10, featuresCol="__v").fit(chosen.select(array_to_vector("__unit").alias("__v")))
    centres = np.array(model.clusterCenters())
    centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("__unit")
            unit = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            near = unit @ shared.value.T
            cell = near.argmax(axis=1) if batch.num_rows else np.zeros(0, np.int64)
            angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
            rest = [batch.column(i) for i in range(batch.num_columns) if i != at]
            names = [n for n in batch.schema.names if n != "__unit"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(cell.astype(np.int32)), pa.array(angle)], [*names, "cell", "__angle"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields) + ", cell int, __angle double"
    placed = written(usable.select(*[F.col(f"`{c}`") for c in vectors.columns], "__unit").mapInArrow(work, schema).repartitionByRange("cell", F.xxhash64(key)).sortWithinPartitions("cell"), "cells")
    widths = {r.cell: r.width for r in placed.groupBy("cell").agg(F.max("__angle").alias("width")).collect()}  # a row for each cell
    return Index(placed.drop("__angle"), centres, widths, key, column)


@dataclass(frozen=True)
class Found:
    """The hits (key, score), and how many of the cells were read of how many."""

    hits: DataFrame
    cells_read: int
    cells: int


def nearest(index: Index, query: list[float], k: int, threshold: float | None = None, probes: int | None = None) -> Found:
    """The k nearest by cosine: exact, or of the ``probes`` most promising cells alone."""
    q = np.array(query, float)
    empty = index.vectors.select(index.key, F.lit(0.0).alias("score")).limit(0)
    if not len(index.centres) or len(q) != index.centres.shape[1] or not np.linalg.norm(q) > 0:
        return Found(empty, 0, len(index.widths))
    angle = np.arccos(np.clip(index.centres @ (q / np.linalg.norm(q)), -1, 1))
    bound = {c: float(np.cos(max(0.0, angle[c] - w - 1e-7))) for c, w in index.widths.items()}
    order = sorted(index.widths, key=lambda c: (-np.cos(angle[c]), c))

    def scored(cells: list[int]) -> DataFrame:
        rows = index.vectors.filter(F.col("cell").isin(cells))
        return best(rows.select(index.key, cosine(F.col(index.column), F.array(*[F.lit(float(x)) for x in q])).alias("score")), index.key, k, threshold)

    if probes is not None:
        return Found(scored(order[:probes]), min(probes, len(order)), len(order))
    first = order[: max(1, len(order) // 16)]
    tried = scored(first).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).first()
    reach = tried.least if tried.n == k else -1.0 if threshold is None else threshold
    cells = [c for c in order if bound[c] >= reach - 1e-9]
    return Found(scored(cells), len(cells), len(order))
