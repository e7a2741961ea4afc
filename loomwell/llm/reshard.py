"""Sharding: a new number of shards with the fewest bytes moved, by minimum-cost flow.

Old shard sizes are supplies, the new shards' capacities demands; staying costs
nothing, each byte moved costs its arc's price. Successive shortest paths give
the transfers between shards, on a graph of shards alone (its size is the number
of shards, not of rows). Each old shard's rows have a fixed order, so that a transfer
is a range of it: rows too large to even out come first, by class of size, then all
others by a hash, so that every transfer gets rows of all sizes and the borders lie
among small ones. Positions in the order are prefix sums in two steps, over stretches
of the order of about 16 MB and inside them, so that a shard with most of the rows is
many tasks' work and no task's grows with the table. The shards that rows enter or
leave are written anew; others stay as they are.

Defined cases: a null text is 0 bytes long with checksum 0; rows that repeat an
id and text are placed one by one, alike but for their slots; null ids come
are ids like any other; rows equal in id and text lie in one stretch; an old shard
without rows supplies nothing; an empty table gives empty shards; capacities that
sum to less than the rows raise ``ValueError``; other columns ride along into the
files, and only their names ``size``, ``text_crc32``, ``shard`` and ``slot`` are
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.llm.common import shared_path, written

ROW_OVERHEAD = 16


@dataclass(frozen=True)
class Transfer:
    source: int
    target: int
    size: int


def min_cost_transfers(sizes: list[int], capacities: list[int], cost: np.ndarray | None = None) -> list[Transfer]:
    """The cheapest way to fit old shards into new ones, rows that stay included.

    cost[i, j]: of a byte from old shard i in new shard j; as default 0 where
    i = j, else 1. Successive shortest paths in the residual graph.
    """
    if sum(sizes) > sum(capacities):
        raise ValueError("the new shards can't hold the rows")
    n, m = len(sizes), len(capacities)
    price = np.ones((n, m)) if cost is None else np.asarray(cost, float)
    if cost is None:
        price[np.arange(min(n, m)), np.arange(min(n, m))] = 0
    flow, supply, room = np.zeros((n, m), np.int64), np.array(sizes, np.int64), np.array(capacities, np.int64)
    while supply.any():
        # distances of old and new shards from the supplies; a label changes only where it gets less
        left, from_right = np.where(supply > 0, 0.0, np.inf), np.full(n, -1)
        right, from_left = np.full(m, np.inf), np.full(m, -1)
        while True:
            ways = left[:, None] + price
            nearer = ways.min(axis=0) < right - 1e-12
            right[nearer], from_left[nearer] = ways.min(axis=0)[nearer], ways.argmin(axis=0)[nearer]
            back = np.where(flow > 0, right[None, :] - price, np.inf)
            best = back.min(axis=1)
            better = best < left - 1e-12
            if not better.any():
                break
            left[better], from_right[better] = best[better], back.argmin(axis=1)[better]
        j = int(np.where(room > 0, right, np.inf).argmin())
        path, amount, at = [], int(room[j]), j
        while True:
            i = int(from_left[at])
            path.append((i, at, 1))
            if from_right[i] < 0:
                amount = min(amount, int(supply[i]))
                break
            at = int(from_right[i])
            path.append((i, at, -1))
            amount = min(amount, int(flow[i, at]))
        for i, at, sign in path:
            flow[i, at] += sign * amount
        supply[path[-1][0]] -= amount
        room[j] -= amount
    return [Transfer(int(i), int(j), int(flow[i, j])) for i, j in zip(*np.nonzero(flow), strict=True)]


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def sized(docs: DataFrame, old_shard: Column, text: str, key: str) -> DataFrame:
    """The columns that place a row: id, size, checksum, old shard and class of size."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    size = (F.octet_length(t) + F.lit(ROW_OVERHEAD)).cast("long")
    return docs.select("*", F.struct(F.col(key).alias("id"), size.alias("size"), F.crc32(t.cast("binary")).alias("crc"), old_shard.cast("int").alias("old")).alias("__p"))


def _class(size: Column, fine: int) -> Column:
    """0 for rows of at most ``fine`` bytes, else smaller for larger rows; at most a hundred different values."""
    return F.when(size <= fine, 0).otherwise(-F.floor(2 * F.log2(size.cast("double")))).cast("int")


def _stretched(rows: DataFrame, splits: DataFrame, fine: int) -> DataFrame:
    """Adds the row's place: class, one of many slices of it by a hash, and the stretch of the order that holds the slice."""
    p = F.col("__p")
    rows = rows.withColumn("__old", p["old"]).withColumn("__class", _class(p["size"], fine))
    rows = rows.join(F.broadcast(splits), ["__old", "__class"])
    rows = rows.withColumn("__hash", F.xxhash64(p["id"], p["crc"])).withColumn("__slice", F.pmod("__hash", F.col("__slices").cast("long")))
    return rows.withColumn("__part", F.col("__first") + F.floor((F.col("__before") + F.col("__bytes") * F.col("__slice") / F.col("__slices")) / F.col("__unit")).cast("int"))


def _placed(rows: DataFrame, offsets: DataFrame, cuts: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """Adds rank and target: the row's place in its old shard's order, and the new shard there."""
    p = F.col("__p")
    inside = Window.partitionBy("__part").orderBy("__class", "__slice", "__hash", p["id"], p["crc"])
    rows = rows.select("*", F.sum(p["size"]).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("__sum"), F.row_number().over(inside).alias("__rank"))
    rows = rows.join(offsets, "__part")
    middle = F.col("__bytes_before") + F.col("__sum") - p["size"] / 2
    table = F.create_map(*[x for i, c in cuts.items() for x in (F.lit(i), F.array(*[F.struct(F.lit(hi).cast("double").alias("hi"), F.lit(j).alias("to")) for hi, j in c]))])
    own = F.try_element_at(table, F.col("__old"))
    target = F.get(F.filter(own, lambda c: middle < c["hi"]), F.lit(0))["to"]
    return rows.withColumn("__rank", F.col("__rank") + F.col("__rows_before") - 1).withColumn("__target", F.coalesce(target, F.element_at(own, -1)["to"]))


def reshard(docs: DataFrame, old_shard: Column, shards: int, key: str = "doc_id", text: str = "text", capacities: list[int] | None = None, block_rows: int = 1_000, path: str | None = None, unit: int = 16 << 20) -> tuple[DataFrame, list[Transfer]]:
    """``docs`` with columns size, text_crc32, shard and slot, from the new files; and the transfers.

    old_shard: the shard, from 0, where a row lies now. A slice holds about
    ``block_rows`` rows and an eighth of ``unit`` bytes at most, a stretch about
    ``unit`` bytes; a task gets one stretch. What comes to the driver are sizes and
    counts for each shard and pair of shards; what is broadcast is a few numbers for
    each old shard and class of size (fewer than 100 classes).
    """
    spark = docs.sparkSession
    clean = docs.drop("shard", "slot", "size", "text_crc32")
    narrow = written(sized(clean, old_shard, text, key).select("__p"), "sizes")
    p = F.col("__p")
    total = narrow.agg(F.sum(p["size"])).first()[0] or 0
    # rows that can spoil the balance by more than a 64th of a shard's share are evened out by class
    fine = max(1, total // max(1, shards) // 64)
    counts = narrow.groupBy(p["old"].alias("old"), _class(p["size"], fine).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.sum(p["size"]).alias("bytes"))
    counts = sorted(counts.collect())
    old_count = max([r["old"] for r in counts], default=-1) + 1
    sizes = [sum(r["bytes"] for r in counts if r["old"] == i) for i in range(old_count)]
    transfers = min_cost_transfers(sizes, capacities or equal_capacities(sum(sizes), shards))
    cuts: dict[int, list[tuple[int, int]]] = {}
    for t in sorted(transfers, key=lambda t: (t.source, t.target != t.source, t.target)):
        before = cuts.setdefault(t.source, [])
        before.append(((before[-1][0] if before else 0) + t.size, t.target))
    cuts = cuts or {0: [(0, 0)]}
    places, parts = [], 0
    for i in range(old_count):
        before = 0
        for r in (r for r in counts if r["old"] == i):
            slices = max(-(-r["n"] // block_rows), -(-8 * r["bytes"] // unit))
            places.append((i, r["class"], slices, parts, before, r["bytes"], unit))
            before += r["bytes"]
        parts += before // unit + 1
    splits = spark.createDataFrame(places, "__old int, __class int, __slices int, __first int, __before long, __bytes long, __unit long")
    # prefix sums over the stretches: one row for each
    sums = _stretched(narrow, splits, fine).groupBy("__old", "__part").agg(F.sum(p["size"]).alias("b"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("__old").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(sums.select("__part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("__bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__rows_before")), "stretches")
    pieces = _placed(_stretched(narrow, splits, fine), offsets, cuts).groupBy("__old", "__target").agg(F.count(F.lit(1)).alias("n"), F.min("__rank").alias("first")).collect()
    # a new shard's slots: the pieces that it gets, one after the other
    start, filled = {}, dict.fromkeys(range(shards), 0)
    for r in sorted(pieces, key=lambda r: (r["__target"], r["__old"] != r["__target"], r["__old"])):
        start[r["__old"], r["__target"]] = filled[r["__target"]] - r["first"]
        filled[r["__target"]] += r["n"]
    shift = F.create_map(*[x for (i, j), v in (start or {(0, 0): 0}).items() for x in (F.lit(i * shards + j), F.lit(v).cast("long"))])
    dealt = _stretched(sized(clean, old_shard, text, key), splits, fine).repartitionById(max(1, parts), F.col("__part"))
    full = _placed(dealt, offsets, cuts)
    slot = F.col("__rank") + F.try_element_at(shift, F.col("__old") * shards + F.col("__target"))
    full = full.select(*[F.col(f"`{c}`") for c in clean.columns], p["size"].alias("size"), p["crc"].alias("text_crc32"), F.col("__target").alias("shard"), slot.alias("slot"))
    affected = sorted({x for t in transfers if t.source != t.target for x in (t.source, t.target)} | {r["__target"] for r in pieces if r["__old"] != r["__target"]})
    path = path or shared_path(spark, "shards")
    full.filter(F.col("shard").isin(affected)).write.partitionBy("shard").option("compression", "zstd").parquet(path)
    files = spark.read.schema(full.schema).parquet(path)
    if all(i in affected for i in range(shards) if filled[i]):
        return files, transfers
    return files.unionByName(full.filter(~F.col("shard").isin(affected))), transfers
