"""Best-fit packing of tokenized documents into sequences by a grouping genetic algorithm.

A solution is a grouping: which bin each document is in. Crossover injects whole
well-filled bins of one parent into the other, removes that parent's bins that hold
any of the injected documents, and best-fits the documents that lost their bin, the
longest first. Documents are dealt out at random into blocks of bounded size. Each
block evolves on several islands; after each round an island's elite goes to the next
island of its block. A block whose bins are as few as its tokens need stops early.
Bins that stay with room give their documents to fewer, new blocks, level after level,
so what blocks waste by being apart is packed again.

Only documents longer than a sequence are cut: their last pieces fill whole sequences,
their first piece may be shorter and is packed like a document.

Defined cases: a null text is empty; each document ends with one end token, so an
empty one has one token; null and repeated keys and repeated rows are documents of
their own; texts are tokenized whole, whatever their length; an empty table gives an
empty result. Other columns don't ride along.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.llm.common import written
from loomwell.llm.tokens import ByteBPE, Chunks, Pool, byte_bpe, chunks, read_bpe

MODEL = "/opt/tokenizers/byte_bpe_50k.json"
CAPACITY = 2048


class Encoder(Chunks):
    """Texts' ids by remembered chunks. A text begins without a space of its own, so its first chunk is encoded apart."""

    def __init__(self, bpe: ByteBPE, most: int = 300_000):
        self.bpe, self.size = bpe, np.array([len(x) for x in bpe.bytes], np.int64)
        super().__init__(most)

    def clear(self) -> None:
        super().clear()
        self.tokens = Pool(np.uint32)

    def learn(self, runs: list[str], alone: list[str]) -> None:
        for r in runs:
            ids = np.array(self.bpe.encode(" " + r), np.uint32)
            ends = np.cumsum([len(c.encode()) + 1 for c in chunks(r)])
            reached = np.cumsum(self.size[ids])
            stop = np.searchsorted(reached, ends) + 1
            if not np.array_equal(reached[stop - 1], ends):
                raise ValueError("a token goes over a chunk's border")
            self.tokens.add(ids, np.diff(stop, prepend=0))
        for c in alone:
            ids = np.array(self.bpe.encode(" " + c), np.uint32)
            self.tokens.add(ids, np.array([len(ids)]))

    def texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; strings of special tokens stand for those tokens, as in the tokenizer by default."""
        heads, tails = zip(*map(self._parted, texts), strict=True) if texts else ((), ())
        rest = [t for t in tails if t]
        if not rest:
            return [np.array(h, np.uint32) for h in heads]
        number, per_text = self.of(rest)
        ids, size = self.tokens.of(number)
        stop = np.concatenate(([0], np.cumsum(size)))[np.cumsum(per_text)]
        found = iter(np.split(ids, stop[:-1]))
        return [np.concatenate((np.array(h, np.uint32), next(found))) if t else np.array(h, np.uint32) for h, t in zip(heads, tails, strict=True)]

    def _parted(self, text: str | None) -> tuple[list[int], str]:
        """The ids up to the first chunk's border, and what comes behind its space."""
        if not text:
            return [], ""
        if any(s in text for s in self.bpe.special):
            return self.bpe.with_special(text), ""
        head, _, tail = text.partition(" ")
        if tail and head and not head[-1].isspace():
            return self.bpe.encode(head), tail
        return self.bpe.encode(text), ""


@lru_cache(maxsize=2)
def encoder(source: str) -> Encoder:
    return Encoder(byte_bpe(source))


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter than a sequence."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces_of(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, capacity: int = CAPACITY, end: int = 0, ids: bool = False) -> DataFrame:
    """key, item (a number of the piece), piece, start, length, ids_crc32 of each document's pieces, and their ids if asked for."""
    shared = docs.sparkSession.sparkContext.broadcast(read_bpe(model))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, one = TaskContext.get().partitionId() << 33, encoder(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                row, number, start, length, crc, tokens = [], [], [], [], [], []
                for i, found in enumerate(one.texts(batch.column(1).to_pylist())):
                    all_ids = np.append(found, np.uint32(end)).astype("<u4")
                    for k, (s, n) in enumerate(cut(len(all_ids), capacity)):
                        row.append(i), number.append(k), start.append(s), length.append(n)
                        crc.append(zlib.crc32(all_ids[s : s + n].tobytes()))
                        if ids:
                            tokens.append(all_ids[s : s + n].astype(np.int32))
                columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(np.arange(item, item + len(row)))]
                columns += [pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["key", "item", "piece", "start", "length", "ids_crc32"]
                if ids:
                    columns, names = [*columns, pa.array(tokens, pa.list_(pa.int32()))], [*names, "ids"]
                item += len(row)
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(work, f"key {kind}, item long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if ids else ""))


# a grouping of one block's documents: the bin of each


def best_fit(size: np.ndarray, order: np.ndarray, where: np.ndarray, room: list[int], capacity: int) -> int:
    """Puts the documents of ``order``, one after another, into the bin that they leave with the least room, or a new one.
    ``where`` is changed in place; ``room`` has what the bins so far leave free. Returns the number of bins."""
    bins = len(room)
    free = sorted((r, b) for b, r in enumerate(room) if r > 0)
    for i, n in zip(order.tolist(), size[order].tolist(), strict=True):
        k = bisect_left(free, (n, -1))
        if k < len(free):
            r, b = free.pop(k)
        else:
            r, b, bins = capacity, bins, bins + 1
        where[i] = b
        if r > n:
            insort(free, (r - n, b))
    return bins


def filled(size: np.ndarray, where: np.ndarray) -> np.ndarray:
    return np.bincount(where, size).astype(np.int64)


def fitness(size: np.ndarray, where: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins are better; of as many, those whose fill is less even."""
    fill = filled(size, where)
    return -len(fill), float(np.square(fill / capacity).mean())


def crossover(size: np.ndarray, one: np.ndarray, other: np.ndarray, capacity: int, draw: np.random.Generator) -> np.ndarray:
    """Injects well-filled bins of ``other`` into ``one``."""
    fill = filled(size, other)
    full = np.argsort(-fill, kind="stable")
    full = full[: max(1, len(full) // 2)]
    inject = np.zeros(len(fill), bool)
    inject[full[draw.random(len(full)) < 0.5]] = True
    injected = inject[other]
    broken = np.zeros(one.max() + 1, bool)
    broken[one[injected]] = True
    displaced = broken[one] & ~injected
    kept = ~broken[one]
    where = np.empty(len(one), np.int64)
    where[kept] = np.unique(one[kept], return_inverse=True)[1]
    n = int(where[kept].max()) + 1 if kept.any() else 0
    where[injected] = n + np.unique(other[injected], return_inverse=True)[1]
    loose = np.flatnonzero(displaced)
    held = ~displaced
    room = (capacity - np.bincount(where[held], size[held])).astype(np.int64).tolist() if held.any() else []
    best_fit(size, loose[np.argsort(-size[loose], kind="stable")], where, room, capacity)
    return where


def mutated(size: np.ndarray, where: np.ndarray, capacity: int, draw: np.random.Generator) -> np.ndarray:
    """Takes the emptiest bins and a few others apart and best-fits their documents."""
    fill = filled(size, where)
    gone = np.zeros(len(fill), bool)
    gone[np.argsort(fill, kind="stable")[: max(1, len(fill) // 50)]] = True
    gone[draw.random(len(fill)) < 0.02] = True
    loose, held = np.flatnonzero(gone[where]), ~gone[where]
    out = np.empty(len(where), np.int64)
    out[held] = np.unique(where[held], return_inverse=True)[1]
    room = (capacity - np.bincount(out[held], size[held])).astype(np.int64).tolist() if held.any() else []
    best_fit(size, loose[np.argsort(-size[loose] * draw.uniform(0.9, 1.1, len(loose)), kind="stable")], out, room, capacity)
    return out


def fewest(size: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: by all tokens, and by documents of which no two fit together."""
    return max(-(-int(size.sum()) // capacity), int((size * 2 > capacity).sum()))


def evolved(size: np.ndarray, start: list[np.ndarray], capacity: int, seed: int, population: int = 6, children: int = 24) -> list[np.ndarray]:
    """The population after some generations, the fittest first. It ends once no better grouping can be."""
    draw, least = np.random.default_rng(seed), fewest(size, capacity)
    people = [(fitness(size, w, capacity), w) for w in start]
    while len(people) < population and (not people or max(f for f, _ in people)[0] < -least):
        spread = 0.1 * len(people)
        where = np.empty(len(size), np.int64)
        best_fit(size, np.argsort(-size * draw.uniform(1 - spread, 1 + spread, len(size)), kind="stable"), where, [], capacity)
        people.append((fitness(size, where, capacity), where))
    people.sort(key=lambda p: p[0], reverse=True)
    for _ in range(children):
        if people[0][0][0] == -least:
            break
        x, y = draw.choice(len(people), 2, replace=False) if len(people) > 1 else (0, 0)
        where = crossover(size, people[x][1], people[y][1], capacity, draw)
        if draw.random() < 0.5:
            where = mutated(size, where, capacity, draw)
        people.append((fitness(size, where, capacity), where))
        people.sort(key=lambda p: p[0], reverse=True)
        people = people[:population]
    return [w for _, w in people]


_STATE = "block long, island int, items array<long>, sizes array<int>, wheres array<array<int>>"


def _round(capacity: int, islands: int, number: int):
    """One round of an island: evolves its people and the elite that came from the island before it, and sends its own on."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        block, island = int(rows["block"].iloc[0]), int(rows["island"].iloc[0])
        size = np.asarray(rows["sizes"].iloc[0], np.int64)
        people = [np.asarray(w, np.int64) for r in rows["wheres"] for w in r]
        done = any(fitness(size, w, capacity)[0] == -fewest(size, capacity) for w in people)
        got = [max(people, key=lambda w: fitness(size, w, capacity))] if done else evolved(size, people, capacity, hash((block, island, number)) & 0xFFFFFFFF)
        sent = [(block, island, got)]
        if islands > 1 and not done:
            sent.append((block, (island + 1) % islands, got[:1]))
        items = rows["items"].iloc[0]
        return pd.DataFrame([(b, i, items, rows["sizes"].iloc[0], [w.tolist() for w in g]) for b, i, g in sent], columns=["block", "island", "items", "sizes", "wheres"])

    return work


def _founded(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("item")
    return pd.DataFrame({"block": rows["block"].iloc[:1], "island": rows["island"].iloc[:1], "items": [rows["item"].to_numpy()], "sizes": [rows["length"].to_numpy(np.int32)], "wheres": [[]]})


def _best(capacity: int):
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        size = np.asarray(rows["sizes"].iloc[0], np.int64)
        people = [np.asarray(w, np.int64) for r in rows.sort_values("island")["wheres"] for w in r]
        where = max(people, key=lambda w: fitness(size, w, capacity))
        fill = filled(size, where)
        order = np.argsort(where, kind="stable")
        before = np.cumsum(size[order]) - size[order]
        offset = np.empty(len(size), np.int64)
        offset[order] = before - (np.cumsum(fill) - fill)[where[order]]
        return pd.DataFrame({"item": rows["items"].iloc[0], "length": size, "block": rows["block"].iloc[0], "bin": where, "offset": offset, "room": (capacity - fill)[where]})

    return work


def grouped(items: DataFrame, blocks: int, capacity: int, islands: int = 2, rounds: int = 3, level: int = 0) -> DataFrame:
    """item, length, block, bin, offset, room: the items (item, length) packed in so many blocks."""
    dealt = items.select("item", "length", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(blocks)).alias("block"))
    dealt = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    state = dealt.groupBy("block", "island").applyInPandas(_founded, _STATE)
    for number in range(rounds):
        state = state.groupBy("block", "island").applyInPandas(_round(capacity, islands, number), _STATE)
    return state.groupBy("block").applyInPandas(_best(capacity), "item long, length long, block long, bin long, offset long, room long")


def placed(items: DataFrame, capacity: int = CAPACITY, block: int = 2000, slack: int = 64, levels: int = 4) -> DataFrame:
    """item, sequence_id, offset of each item (item, length <= capacity).

    A bin with more than 1/slack of its room left is packed again on the next level,
    with others of its kind, until one block is left, a level saves nothing or there
    were ``levels``.
    """
    out = items.filter(F.col("length") >= capacity).select("item", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = items.filter(F.col("length") < capacity).select("item", "length")
    n, bins_before = rest.count(), None
    for level in range(levels):
        if not n:
            break
        blocks = -(-n // block)
        packed = written(grouped(rest, blocks, capacity, level=level), "packed")
        loose = F.col("room") * slack > capacity
        found = packed.agg(F.count_if(loose).alias("n"), F.count_distinct(F.struct("block", "bin")).alias("bins"), F.count_distinct(F.when(loose, F.struct("block", "bin"))).alias("loose")).first()
        last = blocks == 1 or level == levels - 1 or (bins_before is not None and found.bins >= bins_before)
        done = packed if last else packed.filter(~loose)
        number = F.lit(level).cast("long") * (1 << 59) + F.col("block") * (1 << 24) + F.col("bin")
        out = out.unionByName(done.select("item", number.alias("sequence_id"), "offset"))
        if last:
            break
        rest, n, bins_before = packed.filter(loose).select("item", "length"), found.n, found.loose
    return out


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, capacity: int = CAPACITY, end: int = 0, block: int = 2000) -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset of each document's pieces."""
    pieces = written(pieces_of(docs, key, text, model, capacity, end), "pieces")
    where = placed(pieces, capacity, block)
    return pieces.join(where, "item").select(F.col("key").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, capacity: int = CAPACITY, end: int = 0, block: int = 2000) -> DataFrame:
    """sequence_id, ids, parts (key, piece, offset): what a trainer reads, each sequence's tokens in one row."""
    pieces = written(pieces_of(docs, key, text, model, capacity, end, ids=True), "pieces")
    rows = pieces.join(placed(pieces, capacity, block), "item")
    part = F.array_sort(F.collect_list(F.struct("offset", "key", "piece", "ids")))
    whole = rows.groupBy("sequence_id").agg(part.alias("parts"))
    return whole.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.transform("parts", lambda p: F.struct(p["key"].alias(key), p["piece"].alias("piece"), p["offset"].alias("offset"))).alias("parts"))
