"""First and last of a key, take-while, runs, control breaks: loops over ordered rows as windows.

Defined cases: null keys are a key like any other; of rows with equal order, first and last
are told by a hash of all columns, while windows take them in any order, so their order has
to tell rows apart; empty tables give empty results. Names of this module's own columns begin
with two underscores; all others ride along. Windows run inside one key, which is one
conversation, list or task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.sources.shared import written


def _tie(df: DataFrame) -> Column:
    """Parts rows of equal order: a hash of their columns (maps can't be hashed and don't count). Rows equal in all are alike."""
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*plain) if plain else F.lit(0)


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``; of rows with equal order one, told by a hash of all columns.

    min_by combines before the shuffle, so a key with most of the rows is no hot task.
    Null keys are a key like any other; an empty table gives an empty result.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order, _tie(df))).alias("__row"))
    return best.select(*[F.col("__row")[c].alias(c) for c in df.columns])


def last_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by ``order``; ties as in ``first_wins``."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = df.groupBy(*keys).agg(F.max_by(row, F.struct(*order, _tie(df))).alias("__row"))
    return best.select(*[F.col("__row")[c].alias(c) for c in df.columns])


def first_wins_if_keyed(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """As first_wins, but rows without a key all stay."""
    return first_wins(df.filter(F.col(key).isNotNull()), [key], order).unionByName(df.filter(F.col(key).isNull()))


def first_page_wins(df: DataFrame, keys: list[str], page: str) -> DataFrame:
    """A key's rows stay on the first page that has it; repeats inside that page survive."""
    return df.join(df.groupBy(*keys).agg(F.min(page).alias(page)), [*keys, page], "left_semi")


def take_while(df: DataFrame, keys: list[str], order: list[Column], holds: Column) -> DataFrame:
    """Each key's rows before the first for which ``holds`` isn't true."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__ended", F.max(F.when(F.coalesce(holds, F.lit(False)), 0).otherwise(1)).over(w)).filter("__ended = 0").drop("__ended")


def stop_after_run(df: DataFrame, keys: list[str], order: list[Column], bad: Column, run: int = 3) -> DataFrame:
    """Each key's rows up to the ``run``-th bad one in a row, that one included."""
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn("__bad", F.coalesce(bad, F.lit(False)).cast("int")).withColumn("__island", F.sum(1 - F.col("__bad")).over(w))
    length = F.sum("__bad").over(Window.partitionBy(*keys, "__island").orderBy(*order))
    reached = numbered.withColumn("__hit", (length >= run).cast("int"))
    before = F.coalesce(F.max("__hit").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return reached.withColumn("__before", before).filter("__before = 0").drop("__bad", "__island", "__hit", "__before")


def stop_at_repeat(df: DataFrame, keys: list[str], order: list[Column], value: Column) -> DataFrame:
    """Each key's rows before the first whose value an earlier one had: a walk that has come back to where it was. Null values never repeat."""
    w = Window.partitionBy(*keys).orderBy(*order)
    seen = df.withColumn("__value", value)
    again = F.row_number().over(Window.partitionBy(*keys, "__value").orderBy(*order)) > 1
    marked = seen.withColumn("__again", (again & F.col("__value").isNotNull()).cast("int"))
    return marked.withColumn("__ended", F.max("__again").over(w)).filter("__ended = 0").drop("__value", "__again", "__ended")


def capped(df: DataFrame, keys: list[str], kind: str, order: list[Column], caps: dict[str, int]) -> DataFrame:
    """The first rows of each kind under each key, as many as its cap; kinds without a cap are left out."""
    place = F.row_number().over(Window.partitionBy(*keys, kind).orderBy(*order))
    cap = F.try_element_at(F.create_map(*[F.lit(x) for pair in caps.items() for x in pair]), F.col(kind))
    return df.filter(F.col(kind).isin(*caps)).withColumn("__place", place).filter(F.col("__place") <= cap).drop("__place")


def control_break(df: DataFrame, keys: list[str], order: list[Column], value: str, into: str = "is_break") -> DataFrame:
    """Marks rows whose value differs from the one before them: where a heading goes."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(into, ~F.col(value).eqNullSafe(before) | F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).eqNullSafe(F.lit(1)))


def carried_forward(df: DataFrame, keys: list[str], order: list[Column], value: Column, into: str) -> DataFrame:
    """The last value so far that isn't null."""
    return df.withColumn(into, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order)))


def walk(edges: DataFrame, starts: DataFrame, most: int | None = None, flag: bool = False) -> DataFrame:
    """(start, step, node): follows node -> next from each start, all starts at once, each node of a list once.

    Pointer doubling: after k rounds a table holds every node's 2^k-th follower,
    and positions fill in by powers of two, so a list of n nodes takes log n joins.
    A list that comes back to a node of its own ends there: a round that finds only
    nodes that their lists have already is the last. ``flag`` adds ``cyclic``, whether
    the start's list does so. ``most`` nodes of each list at most, if given.
    """
    hop = edges.select("node", "next").filter("next is not null")
    found = starts.select(F.col("node").alias("start"), F.lit(0).alias("step"), "node").distinct()
    jump, span, n = hop, 1, found.count()
    while True:
        further = found.join(jump, "node").select("start", (F.col("step") + span).alias("step"), F.col("next").alias("node"))
        both = found.unionByName(further).groupBy("start", "node").agg(F.min("step").alias("step")).select("start", "step", "node")
        found = written(both if most is None else both.filter(F.col("step") < most), "walk")
        span *= 2
        before, n = n, found.count()
        if n == before or (most is not None and span >= most):
            break
        second = jump.select(F.col("node").alias("next"), F.col("next").alias("far"))
        jump = written(jump.join(second, "next").select("node", F.col("far").alias("next")), "jump")
    if not flag:
        return found
    # the last node of a list that ends has no follower
    back = found.join(hop, "node", "left").groupBy("start").agg(F.bool_and(F.col("next").isNotNull()).alias("cyclic"))
    return found.join(back, "start")


def numbered(df: DataFrame, order: list[str], into: str = "n", start: int = 0) -> DataFrame:
    """Rows numbered from ``start`` by ``order``, without one task that sees all rows.

    Ranges are sorted in many tasks; each range's offset comes from a table with
    one row for each range.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("__range").count().select("__range", "count")
    before = F.coalesce(F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__range", before.alias("__offset"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.withColumn("__place", place).join(offsets, "__range").withColumn(into, F.col("__offset") + F.col("__place") - 1 + start).drop("__range", "__place", "__offset")
