"""Chunking: paragraphs packed to a token target, sentences and words where one is too large.

Defined cases: a null, empty or blank text has no chunk and gives no row; texts of any
length are chunked whole; a word larger than a chunk is one; repeated rows give repeated
chunks; an empty table gives an empty result; columns other than key and text are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.functions.batches import text_udf


def count_words(text: str) -> int:
    """Stand-in for a tokenizer: words x 1.3, rounded down. Any text -> int will do instead."""
    return len(text.split()) * 13 // 10


def _packed(parts: list[str], gap: str, most: int, count: Callable[[str], int]) -> list[str]:
    """Neighbouring parts joined while the count stays within ``most``; a larger part is alone.

    Words are counted once, part by part. Of another counter it is taken that a
    joined text counts no more than its parts and gaps; only where these sum to
    more than ``most`` is the joined text itself counted.
    """
    words = count is count_words
    total = (lambda n: n * 13 // 10) if words else (lambda n: n)
    size = (lambda t: len(t.split())) if words else count
    between = 0 if words else count(gap)
    out: list[str] = []
    run: list[str] = []
    now = 0
    for part in parts:
        n = size(part)
        longer = now + between + n if run else n
        if run and total(longer) > most:
            joined = None if words else gap.join([*run, part])
            if joined is None or (longer := count(joined)) > most:
                out.append(gap.join(run))
                run, longer = [], n
        run.append(part)
        now = longer
    return out + [gap.join(run)] if run else out


def chunked(text: str | None, target: int = 2000, cap: int = 8000, forced: int = 1000, count: Callable[[str], int] = count_words) -> list[str]:
    """Chunks of a text. Sentences are cut at every '.', and end with one."""
    paragraphs = [p.strip() for p in (text or "").split("\n\n") if p.strip()]
    out: list[str] = []
    run: list[str] = []
    for p in paragraphs:
        if count(p) > target:
            out += _packed(run, "\n\n", target, count)
            run = []
            out += _packed([s.strip() + "." for s in p.split(".") if s.strip()], " ", target, count)
        else:
            run.append(p)
    out += _packed(run, "\n\n", target, count)
    return [c for chunk in out for c in (_packed(chunk.split(), " ", forced, count) if count(chunk) > cap else [chunk]) if c.strip()]


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", target: int = 2000, cap: int = 8000, count: Callable[[str], int] = count_words) -> DataFrame:
    """key, chunk_index, total_chunks, chunk."""

    split = text_udf(lambda t: chunked(t, target, cap, count=count), "array<string>", pa.list_(pa.string()))
    rows = docs.select(key, split(F.col(text)).alias("chunks"))
    return rows.select(key, F.size("chunks").alias("total_chunks"), F.posexplode("chunks").alias("chunk_index", "chunk"))
