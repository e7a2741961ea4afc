"""Python helpers over Arrow batches in small parts.

Spark sends a task up to 10,000 rows or 64 MB at once. As Python objects, with what a
helper makes of them, such a batch is many times larger; so batches are cut into parts
of about ``MOST`` bytes first, and a task holds the objects of one part at a time,
however large the table is. A row larger than that is a part of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 1 << 20


def parts(batch: pa.RecordBatch | pa.Array, most: int = MOST) -> Iterator[pa.RecordBatch | pa.Array]:
    """The batch or array in order, halved until a part has at most ``most`` bytes or one row."""
    todo = [batch]
    while todo:
        b = todo.pop()
        if len(b) < 2 or b.nbytes <= most:
            yield b
        else:
            todo += [b.slice(len(b) // 2), b.slice(0, len(b) // 2)]


def text_udf(f: Callable[[str], object], kind: str = "string", arrow: pa.DataType = pa.string()) -> Callable[[Column], Column]:
    """A function of one text as a function of a column; null stays null. ``kind`` and ``arrow`` are its result's type."""

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in batches:
            for part in parts(whole):
                yield pa.array([None if t is None else f(t) for t in part.to_pylist()], arrow)

    return lambda c: F.arrow_udf(of, kind)(c)


def row_udf(f: Callable[..., object], kind: str, arrow: pa.DataType) -> Callable[..., Column]:
    """A function of a row's values, nulls too, as a function of two or more columns."""

    def of(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for whole in batches:
            for part in parts(pa.RecordBatch.from_arrays(list(whole), [str(i) for i in range(len(whole))])):
                yield pa.array([f(*row) for row in zip(*(c.to_pylist() for c in part.columns), strict=True)], arrow)

    return lambda *c: F.arrow_udf(of, kind)(*c)
