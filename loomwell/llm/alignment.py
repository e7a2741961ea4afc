"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids meet.

Every byte of a text gets a label: 0 (no token ends here), 1 (one of A does), 2 (one
of B does) or 3 (both do). A regular expression scans the labels for spans up to each
3; how many 1s and 2s a span has tells how many tokens its group joins. All tokens of
A in a group are linked with all of B in it. Texts come in chunks at whose borders
both tokenizers end a token, so a chunk's groups are its own and are remembered.

Documents are taken in blocks of bounded size, one after another within a task. A
block has a dictionary of its id pairs; documents keep places in it. The pairs'
counts over the corpus go to the dictionaries, one row for each block and pair, and
not to the documents' pairs, so that a pair that nearly every text has is no hot key.

Defined cases: a null or empty text has no tokens, nor has one whose joined bytes
under A or B differ from a space and the text (one that holds U+2581, which B reads
as a space): zeros, an empty digest, no links. Strings of special tokens are plain
text. Repeated rows and ids are documents of their own and count as such. Texts of
any length are taken whole; one longer than a block's bound is a block of its own.
An empty table gives empty results. Other columns don't ride along.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.llm.common import written
from loomwell.llm.tokens import ByteBPE, Chunks, Pieces, Pool, byte_bpe, chunks, pieces, read_bpe, read_model, sums

A_PATH = "/opt/tokenizers/byte_bpe_50k.json"
B_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Runs of groups of one token each, and spans up to the next byte where both end.
SPAN = re.compile(rb"[03]*3|[0-2]*3")
#: Of an id pair's key, B's id takes the lower bits.
LOW = 20


@dataclass(frozen=True)
class Groups:
    """The groups of some chunks, one after another."""

    first_a: np.ndarray  # place of the group's first token of A
    n_a: np.ndarray
    first_b: np.ndarray
    n_b: np.ndarray
    end: np.ndarray  # byte where the group ends


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> Groups:
    """Groups from the byte offsets (from 1) at which tokens end; both lists end with the same offset."""
    label = np.zeros(int(ends_a[-1]) if len(ends_a) else 0, np.uint8)
    label[ends_a - 1] = 1
    label[ends_b - 1] += 2
    spans = [m.span() for m in SPAN.finditer((label + 48).tobytes())]
    begin, stop = np.array(spans, np.int64).reshape(-1, 2).T
    so_far = [np.concatenate(([0], np.cumsum(label == kind))) for kind in (1, 2, 3)]
    only_a, only_b, both = (c[stop] - c[begin] for c in so_far)
    # a span with tokens of its own is one group, any other is as many as it has 3s, of one token each
    n = np.where(only_a + only_b > 0, 1, both)
    n_a, n_b = np.repeat(only_a, n) + 1, np.repeat(only_b, n) + 1
    stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
    return Groups(stop_a - n_a, n_a, stop_b - n_b, n_b, np.flatnonzero(label == 3) + 1)


def links(g: Groups, a: np.ndarray, b: np.ndarray, at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair key, times): the links of each group, in the groups' order; those of very large groups are counted first."""
    cells = g.n_a * g.n_b
    if not len(cells) or cells.max() <= at_once:
        group = np.repeat(np.arange(len(cells)), cells)
        k = np.arange(len(group)) - np.repeat(np.cumsum(cells) - cells, cells)
        width = g.n_b[group]
        key = (a[g.first_a[group] + k // width] << LOW) | b[g.first_b[group] + k % width]
        return group, key, np.ones(len(key), np.int64)
    out = []
    for i in range(len(cells)):
        x, n = np.unique(a[g.first_a[i] : g.first_a[i] + g.n_a[i]], return_counts=True)
        y, m = np.unique(b[g.first_b[i] : g.first_b[i] + g.n_b[i]], return_counts=True)
        out.append((np.full(len(x) * len(y), i), ((x << LOW)[:, None] | y).ravel(), np.outer(n, m).ravel()))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


class Aligner(Chunks):
    """Chunks with their tokens' counts, groups (as text) and links, or marked unfit where the tokens' bytes aren't the chunk's."""

    def __init__(self, a: ByteBPE, b: Pieces, most: int = 300_000):
        self.a, self.b = a, b
        self.size_a, self.size_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (a, b))
        names = [[b"%d" % i for i in range(len(t.bytes))] for t in (a, b)]
        self.named = np.array([x + end for own, ends in zip(names, ((b",", b"|"), (b",", b";")), strict=True) for end in ends for x in own], object)
        super().__init__(most)

    def clear(self) -> None:
        super().clear()
        self.said: list[bytes | None] = []  # a chunk's groups as text, None if it is unfit
        self.counts, self.keys, self.times = Pool(np.int64), Pool(np.int64), Pool(np.int64)

    def learn(self, runs: list[str], alone: list[str]) -> None:
        if runs:
            self._align(runs, [c for r in runs for c in chunks(r)])
        for c in alone:
            self._align([c], [c])

    def _align(self, texts: list[str], parts: list[str]) -> None:
        """``parts`` are the chunks of ``texts``, whose tokens are theirs."""
        ids_a, ids_b = [self.a.encode(" " + t) for t in texts], self.b.encode(texts)
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
        whole = "".join([" " + t for t in texts]).encode()
        if not (self._joined(self.a, a) == self._joined(self.b, b) == whole):
            if len(parts) > 1:
                for c in parts:
                    self._align([c], [c])
                return
            self.said.append(None)
            self.counts.add(np.zeros(3, np.int64), np.array([3]))
            for pool in (self.keys, self.times):
                pool.add(np.zeros(0, np.int64), np.array([0]))
            return
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        g = groups(ends_a, ends_b)
        # tokens in the order of the text: a group's of A, then its of B
        na, nb = len(self.a.bytes), len(self.b.bytes)
        code_a, code_b = a.copy(), b + 2 * na
        code_a[g.first_a + g.n_a - 1] += na
        code_b[g.first_b + g.n_b - 1] += nb
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + np.repeat(g.first_b, g.n_a)] = code_a
        code[np.arange(len(b)) + np.repeat(g.first_a + g.n_a, g.n_b)] = code_b
        said = self.named[code].tolist()
        group, key, times = links(g, a, b)
        # where each chunk's bytes, groups, tokens and links end
        ends = np.cumsum([len(p.encode()) + 1 for p in parts])
        stop = np.searchsorted(g.end, ends) + 1
        if not np.array_equal(g.end[stop - 1], ends):
            raise ValueError("a token goes over a chunk's border")
        stop_a, stop_b = ((first + n)[stop - 1] for first, n in ((g.first_a, g.n_a), (g.first_b, g.n_b)))
        self.counts.add(np.diff(np.stack((stop_a, stop_b, stop), 1), axis=0, prepend=0).ravel(), np.full(len(parts), 3))
        stop_k = np.searchsorted(group, stop)
        n_k = np.diff(stop_k, prepend=0)
        self.keys.add(key, n_k)
        self.times.add(times, n_k)
        p = 0
        for s in (stop_a + stop_b).tolist():
            self.said.append(b"".join(said[p:s]))
            p = s

    def _joined(self, tokens: ByteBPE | Pieces, ids: np.ndarray) -> bytes:
        return b"".join(map(tokens.bytes.__getitem__, ids.tolist()))

    def texts(self, texts: list[str | None]) -> list[tuple | None]:
        """For each text (counts, digest of the groups, distinct pair keys, their times); None for one without tokens."""
        some = [t for t in texts if t]
        if not some:
            return [None] * len(texts)
        number, n = self.of(some)
        said = list(map(self.said.__getitem__, number.tolist()))
        counts = self.counts.of(number)[0].reshape(-1, 3)
        key, size = self.keys.of(number)
        times = self.times.of(number)[0]
        stop = np.cumsum(n)
        stop_k = np.concatenate(([0], np.cumsum(size)))[stop]
        found = []
        for i, (s, m, k, j) in enumerate(zip(stop.tolist(), n.tolist(), stop_k.tolist(), [0, *stop_k.tolist()], strict=False)):
            own = said[s - m : s]
            if None in own:
                found.append(None)
                continue
            digest = hashlib.sha256(b"".join(own)[:-1]).hexdigest()
            place, keys = pd.factorize(key[j:k])
            found.append((counts[s - m : s].sum(axis=0), digest, keys, np.bincount(place, times[j:k], len(keys)).astype(np.int64)))
        known = iter(found)
        return [next(known) if t else None for t in texts]

    def spans(self, text: str | None) -> list[dict]:
        """The groups of one text: start and end among the bytes of a space and the text, and the ids of both."""
        if not text:
            return []
        a, b = np.array(self.a.encode(" " + text), np.int64), np.array(self.b.encode([text])[0], np.int64)
        if not self._joined(self.a, a) == self._joined(self.b, b) == (" " + text).encode():
            return []
        g = groups(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))
        starts = [0, *g.end.tolist()]
        rows = zip(starts, starts[1:], g.first_a.tolist(), g.n_a.tolist(), g.first_b.tolist(), g.n_b.tolist(), strict=False)
        return [{"start": s, "end": e, "a": a[i : i + n].tolist(), "b": b[j : j + m].tolist()} for s, e, i, n, j, m in rows]


@lru_cache(maxsize=2)
def aligner(a: str, b: bytes) -> Aligner:
    return Aligner(byte_bpe(a), pieces(b))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _list(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]), kind))


def _blocks(batches: Iterator[pa.RecordBatch], one: Aligner, most: int) -> Iterator[pa.RecordBatch]:
    """Documents of a block, then the pairs of its dictionary. A block ends at ``most`` pairs of documents or more."""
    task, n, rows, held = TaskContext.get().partitionId(), 0, [], 0
    names = ["key", "block", "n_a", "n_b", "n_groups", "digest", "places", "times", "pair", "documents"]

    def block() -> Iterator[pa.RecordBatch]:
        number = (task << 24) + n
        place, keys = pd.factorize(np.concatenate([r[2][2] for r in rows if r[2]] or [np.zeros(0, np.int64)]))
        for at in range(0, len(rows), 1024):
            part = rows[at : at + 1024]
            size = [len(r[2][2]) if r[2] else 0 for r in part]
            begin = sum(len(r[2][2]) for r in rows[:at] if r[2])
            cut = begin + np.concatenate(([0], np.cumsum(size)))
            places = [place[x:y] for x, y in zip(cut, cut[1:], strict=False)]
            times = [r[2][3] if r[2] else np.zeros(0, np.int64) for r in part]
            three = np.array([r[2][0] if r[2] else (0, 0, 0) for r in part], np.int64).reshape(-1, 3)
            key = pa.concat_arrays([r[0].slice(r[1], 1) for r in part])
            columns = [pa.array(three[:, i]) for i in range(3)]
            digest = pa.array([r[2][1] if r[2] else "" for r in part], pa.string())
            nothing = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([key, pa.array([number] * len(part), pa.int64()), *columns, digest, _list(places, pa.int32()), _list(times, pa.int64()), nothing, nothing], names)
        count = np.bincount(place, minlength=len(keys))
        for at in range(0, len(keys), 65536):
            k = keys[at : at + 65536]
            none = [pa.nulls(len(k), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()))]
            # the place of a dictionary's pair stands where documents have their tokens' count
            none[0] = pa.array(np.arange(at, at + len(k)), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(k), rows[0][0].type), pa.array([number] * len(k), pa.int64()), *none, pa.array(k), pa.array(count[at : at + 65536], pa.int64())], names)

    for batch in _slices(batches):
        for i, got in enumerate(one.texts(batch.column(1).to_pylist())):
            rows.append((batch.column(0), i, got))
            held += len(got[2]) if got else 0
        if held >= most or len(rows) >= 65536:
            yield from block()
            n, rows, held = n + 1, [], 0
    if rows:
        yield from block()


@dataclass(frozen=True)
class Linked:
    """``documents``: key, n_a, n_b, n_groups, n_links, n_best, count_sum, digest. ``pairs``: a, b, documents (how many hold the pair linked), best (whether no pair of that a has more)."""

    documents: DataFrame
    pairs: DataFrame


def _scored(key: tuple, docs: pa.Table, dictionary: pa.Table) -> pa.Table:
    """A block's documents with what their links' counts come to."""
    count, best = np.zeros(dictionary.num_rows, np.int64), np.zeros(dictionary.num_rows, bool)
    at = dictionary["place"].to_numpy()
    count[at], best[at] = dictionary["documents"].to_numpy(), dictionary["best"].to_numpy()
    places, times = (docs[c].combine_chunks() for c in ("places", "times"))
    n = places.value_lengths().to_numpy()
    place, time = places.flatten().to_numpy(), times.flatten().to_numpy()
    totals = [sums(v, n) for v in (time, time * best[place], time * count[place])]
    columns = [docs["key"], docs["n_a"], docs["n_b"], docs["n_groups"], *map(pa.array, totals), docs["digest"]]
    return pa.table(columns, names=["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "digest"])


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", a: str = A_PATH, b: str = B_PATH, block: int = 2_000_000) -> Linked:
    """Aligns all texts of ``docs`` and counts their links over the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast((read_bpe(a), read_model(b)))
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, block long, n_a long, n_b long, n_groups long, digest string, places array<int>, times array<long>, pair long, documents long"
    both = written(rows.mapInArrow(lambda it: _blocks(it, aligner(*shared.value), block), schema), "aligned")
    own = both.filter("pair is not null").select("block", F.col("n_a").cast("int").alias("place"), "pair", "documents")
    counted = own.groupBy("pair").agg(F.sum("documents").alias("documents")).withColumn("a", F.shiftright("pair", LOW))
    most = counted.groupBy("a").agg(F.max("documents").alias("most"))
    counted = written(counted.join(most, "a").select("pair", "documents", (F.col("documents") == F.col("most")).alias("best")), "pairs")
    dictionary = own.drop("documents").join(counted, "pair").select(F.col("block").alias("of_block"), "place", "documents", "best")
    held = both.filter("pair is null").select("key", "block", "n_a", "n_b", "n_groups", "digest", "places", "times")
    out = held.groupBy("block").cogroup(dictionary.groupBy("of_block")).applyInArrow(_scored, f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, digest string")
    pairs = counted.select(F.shiftright("pair", LOW).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit((1 << LOW) - 1)).cast("int").alias("b"), "documents", "best")
    return Linked(out.withColumnRenamed("key", key), pairs)


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", a: str = A_PATH, b: str = B_PATH) -> DataFrame:
    """key, groups: each text's groups with their byte ranges (of a space and the text) and ids; an empty list for texts without tokens."""
    shared = docs.sparkSession.sparkContext.broadcast((read_bpe(a), read_model(b)))
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    group = pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64(), "a": pa.list_(pa.int32()), "b": pa.list_(pa.int32())}))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = aligner(*shared.value)
        for batch in _slices(batches, 16):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one.spans(t) for t in batch.column(1).to_pylist()], group)], ["key", "groups"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(work, f"key {kind}, groups array<struct<start:bigint,end:bigint,a:array<int>,b:array<int>>>").withColumnRenamed("key", key)
