"""SimHash near-duplicates: fingerprints linked by a self-join of binary tries.

Each text gets 64 bits from the hashes of its word shingles. Two fingerprints
that differ in at most ``errors`` bits agree wholly in one of ``errors + 1``
equal blocks of bits, so every fingerprint goes once for each block into the trie
of those that share the block, turned so that the block comes first. A task
walks its tries in pairs of nodes, level by level: it adds up the bits in which
two nodes differ, and drops a pair once the budget is spent. A trie with many
fingerprints is dealt out as pairs of its subtrees to many tasks. Each task
returns a spanning star for each of its components instead of all links, and the
stars are merged by label propagation over tables in the shared folder.

Defined cases: a null, empty or blank text has the fingerprint zero, linked like
any other; a text with fewer words than a shingle has is one shingle; rows with
equal fingerprints are one component however many they are; a null id is a member
but never the component's id, which is null only if all members' ids are; repeated
rows get equal results; an empty table gives an empty result; texts are read
whole; other columns of the table are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwell.llm.common import written

SEED = 42


def fingerprint(text: str | None, size: int = 3) -> int:
    """64 bits of a text; bit i is 1 if set in over half of its shingles' hashes."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: lower() and split() know ASCII only
    if not words:
        return 0
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    return majority(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64))


def majority(h: np.ndarray) -> int:
    """64 bits of hashes; bit i is 1 if set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">u8")[0])


def simhash(text: Column, size: int = 3) -> Column:
    """The fingerprint as a long, the topmost bit as its sign."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64))

    return of(text)


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node of its component, given links a - b."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (up := root[root] != root).any():
            root[up] = root[root[up]]
    return root


def trie_links(value: np.ndarray, starts: list[np.ndarray], bit: int, errors: int, at_once: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between leaves of tries over ``value``, sorted within each trie node.

    starts: arrays (lo, hi, lo', hi', differing bits) of node pairs to begin with,
    nodes as ranges of ``value``; a node paired with itself stands for the pairs
    inside it. bit: the first bit (from the top) below the start nodes.
    """
    alo, ahi, blo, bhi, diff = starts
    while len(alo):
        if len(alo) > at_once:  # bounds the memory: one half after the other
            for part in (slice(None, len(alo) // 2), slice(len(alo) // 2, None)):
                yield from trie_links(value, [x[part] for x in (alo, ahi, blo, bhi, diff)], bit, errors, at_once)
            return
        # few leaves below a pair: compare them all
        small = (ahi - alo) * (bhi - blo) <= 32
        if bit == 64:
            small[:] = True
        if small.any():
            n = ((ahi - alo) * (bhi - blo))[small]
            ends = np.cumsum(n)
            cuts = [0, *np.searchsorted(ends, np.arange(at_once * 4, ends[-1], at_once * 4)).tolist(), len(n)]
            for p, q in zip(cuts, cuts[1:], strict=False):
                m = n[p:q]
                pair = np.repeat(np.flatnonzero(small)[p:q], m)
                k = np.arange(len(pair)) - np.repeat(np.cumsum(m) - m, m)
                width = (bhi - blo)[pair]
                x, y = alo[pair] + k // width, blo[pair] + k % width
                ok = ((alo[pair] != blo[pair]) | (x < y)) & (np.bitwise_count(value[x] ^ value[y]) <= errors)
                yield x[ok], y[ok]
            alo, ahi, blo, bhi, diff = (v[~small] for v in (alo, ahi, blo, bhi, diff))
            if not len(alo):
                return
        # split both nodes of each pair by the next bit
        ones = np.concatenate(([0], np.cumsum((value >> np.uint64(63 - bit)) & np.uint64(1), dtype=np.int64)))
        am, bm = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        own = alo == blo
        pairs = [(alo, am, blo, bm, diff), (am, ahi, bm, bhi, diff), (alo, am, bm, bhi, diff + 1), (am[~own], ahi[~own], blo[~own], bm[~own], diff[~own] + 1)]
        alo, ahi, blo, bhi, diff = (np.concatenate(v) for v in zip(*pairs, strict=True))
        keep = (ahi > alo) & (bhi > blo) & (diff <= errors) & ~((alo == blo) & (ahi - alo == 1))
        alo, ahi, blo, bhi, diff = (v[keep] for v in (alo, ahi, blo, bhi, diff))
        bit += 1


def _walk(batches: Iterator[pd.DataFrame], width: int, errors: int) -> Iterator[pd.DataFrame]:
    """Stars of one task's tries. Columns: job, depth, a, b (its two subtrees), turned, fp."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True)
    rows["turned"] = rows["turned"].to_numpy(np.int64).view(np.uint64)
    rows = rows.sort_values(["depth", "job", "a", "b", "turned"], kind="stable", ignore_index=True)
    fp, index = np.unique(rows["fp"].to_numpy(np.int64), return_inverse=True)
    left, right = [], []
    for depth, part in rows.groupby("depth", sort=True):
        value, first = part["turned"].to_numpy(np.uint64), part.index[0]
        head = (value >> np.uint64(64 - width - depth)) if depth else value >> np.uint64(64 - width)
        head = head & np.uint64((1 << int(depth)) - 1)
        job = part[["job", "a", "b"]].to_numpy(np.int64)
        begin = np.flatnonzero(np.concatenate(([True], (job[1:] != job[:-1]).any(axis=1))))
        end = np.append(begin[1:], len(part))
        a, b = job[begin, 1].astype(np.uint64), job[begin, 2].astype(np.uint64)
        # within a job the rows of subtree a stand before those of b
        is_a = np.concatenate(([0], np.cumsum(head == np.repeat(a, end - begin), dtype=np.int64)))
        mid = begin + is_a[end] - is_a[begin]
        own = a == b
        starts = [begin, mid, np.where(own, begin, mid), np.where(own, mid, end), np.bitwise_count(a ^ b).astype(np.int64)]
        keep = (starts[1] > starts[0]) & (starts[3] > starts[2]) & (starts[4] <= errors) & ~(own & (mid - begin == 1))
        for x, y in trie_links(value, [s[keep] for s in starts], width + int(depth), errors):
            # merge as links come, so that dense tries don't pile them up
            u, v = index[x + first], index[y + first]
            left.append(u), right.append(v)
            if sum(map(len, left)) > 4_000_000:
                root = _roots(len(fp), np.concatenate(left), np.concatenate(right))
                left, right = [np.flatnonzero(root != np.arange(len(fp)))], [root[root != np.arange(len(fp))]]
    if left:
        root = _roots(len(fp), np.concatenate(left), np.concatenate(right))
        moved = np.flatnonzero(root != np.arange(len(fp)))
        yield pd.DataFrame({"u": fp[moved], "v": fp[root[moved]]})


def stars(distinct: DataFrame, errors: int = 3, heavy: int = 2048) -> DataFrame:
    """(u, v), u > v: links that span the components of column fp's values within each task."""
    blocks, width = errors + 1, 64 // (errors + 1)
    turned = lambda r: F.col("fp") if r == 0 else F.shiftleft("fp", r * width).bitwiseOR(F.shiftrightunsigned("fp", 64 - r * width))
    rows = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(r).alias("r"), turned(r).alias("turned")) for r in range(blocks)])).alias("x"))
    rows = rows.select("fp", "x.turned", (F.col("x.r") * (1 << width) + F.shiftrightunsigned("x.turned", 64 - width)).alias("job"))
    # tries with more than `heavy` leaves: so many bits below the block tell the subtree
    depth = F.least(F.ceil(F.log2(F.col("n") / F.lit(heavy))), F.lit(10)).cast("int")
    large = rows.groupBy("job").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > heavy).select("job", depth.alias("depth"))
    rows = rows.join(large, "job", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    own = F.expr(f"shiftrightunsigned(turned, 64 - {width} - depth) & (shiftleft(1L, depth) - 1)")
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, depth) - 1")), lambda q: F.bit_count(q.bitwiseXOR(F.col("own"))) <= errors)
    rows = rows.withColumn("own", F.when(F.col("depth") > 0, own).otherwise(F.lit(0).cast("long"))).withColumn("q", F.explode(others))
    rows = rows.select("job", "depth", F.least("own", "q").alias("a"), F.greatest("own", "q").alias("b"), "turned", "fp")
    # a task holds its tries in memory: about half a million of a small table's rows, whatever the table's size
    tasks = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-distinct.count() * blocks // 500_000))
    return rows.repartition(tasks, "job", "a", "b").mapInPandas(lambda it: _walk(it, width, errors), "u long, v long")


def components(links: DataFrame, name: str = "labels") -> DataFrame:
    """(node, label): the smallest node of each component, for the nodes that have links.

    Each round takes the smallest label among a node and its neighbours, then
    that label's own label; rounds go on until none changes. Every round's
    labels are a table in the shared folder.
    """
    both = written(links.select(F.col("u"), F.col("v")).union(links.select(F.col("v"), F.col("u"))).distinct(), name + "-links")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")), name)
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "node").select("node", F.least("label", "near").alias("step"), "label")
        jump = labels.select(F.col("node").alias("step"), F.col("label").alias("far"))
        new = written(stepped.join(jump, "step", "left").select("node", F.least("step", F.coalesce("far", "step")).alias("label"), F.col("label").alias("old")), name)
        labels = new.select("node", "label")
        if new.filter("label <> old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", errors: int = 3, size: int = 3) -> DataFrame:
    """key, fp (long), component_id and label (the component's smallest fingerprint) for each row of ``docs``."""
    rows = written(docs.select(F.col(key).alias("__key"), simhash(F.col(text), size).alias("fp")), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("__key").alias("id")), "distinct")
    labels = components(stars(distinct, errors))
    labelled = distinct.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("label", "fp").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("id").alias("component_id"))
    by_fp = labelled.join(smallest, "label").select("fp", "component_id", "label")
    return rows.join(by_fp, "fp").select(F.col("__key").alias(key), "fp", "component_id", "label")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", errors: int = 3, size: int = 3) -> DataFrame:
    """One row of each component of ``docs``, with its own columns: the one whose id names the component.

    Of rows that repeat both id and fingerprint that with the smallest hash of its
    columns stays. A component whose ids are all null keeps the row with its smallest
    fingerprint.
    """
    found = near_duplicates(docs, key, text, errors, size)
    chosen = found.filter(F.col(key).eqNullSafe(F.col("component_id"))).groupBy("label").agg(F.min("component_id").alias("__id"), F.min("fp").alias("__fp"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(key).alias("__id"), simhash(F.col(text), size).alias("__fp"))
    kept = keyed.join(chosen.withColumnsRenamed({"__id": "__c", "__fp": "__f"}), F.col("__id").eqNullSafe(F.col("__c")) & (F.col("__fp") == F.col("__f")), "left_semi")
    one = kept.groupBy("__id", "__fp").agg(F.min_by("__row", F.xxhash64("__row")).alias("__row"))
    return one.select(*[F.col("__row")[c].alias(c) for c in docs.columns])
