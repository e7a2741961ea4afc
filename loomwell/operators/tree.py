"""Menu trees: paths parted by ^, counted at each node without recursion.

Defined cases: a null, empty or blank path has no node; blank segments are dropped unless
told otherwise; rows with equal paths each count; an empty table has no nodes (a rooted
tree its root); columns other than those named are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hierarchy(path: Column) -> Column:
    """The path's segments, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(F.coalesce(path, F.lit("")), r"\^"), lambda x: F.trim(x)), lambda x: x != "")


def last_segment(path: Column) -> Column:
    return F.try_element_at(hierarchy(path), F.lit(-1))


def prefixes(segments: Column) -> Column:
    """All nodes on the way to a path, each as a joined path."""
    n = F.size(segments)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(segments, 1, i), "^"))).otherwise(F.array().cast("array<string>"))


def rollup(links: DataFrame, path: str = "menu_path", drop_blank: bool = True) -> DataFrame:
    """(node, parent, depth, own, total): rows at a node, and with its descendants.

    Equal paths are counted before they are expanded, so what is expanded are
    distinct paths.
    """
    segments = hierarchy(F.col(path)) if drop_blank else F.split(F.coalesce(F.col(path), F.lit("")), r"\^")
    leaves = links.groupBy(segments.alias("segments")).agg(F.count(F.lit(1)).alias("n"))
    nodes = leaves.select("n", F.array_join("segments", "^").alias("leaf"), F.explode(prefixes(F.col("segments"))).alias("node"))
    counted = nodes.groupBy("node").agg(F.sum(F.when(F.col("leaf") == F.col("node"), F.col("n")).otherwise(0)).alias("own"), F.sum("n").alias("total"))
    depth = F.size(F.split("node", r"\^"))
    parent = F.when(depth > 1, F.regexp_replace("node", r"\^[^^]*$", ""))
    return counted.select("node", parent.alias("parent"), depth.alias("depth"), "own", "total")


def descendants(links: DataFrame, nodes: DataFrame, path: str = "menu_path") -> DataFrame:
    """(node, id): the links at or below each of the nodes, by equality with one of a path's prefixes."""
    expanded = links.select("id", F.explode(F.array_distinct(prefixes(hierarchy(F.col(path))))).alias("node"))
    return nodes.select("node").distinct().join(expanded, "node")


def rooted(nodes: DataFrame, root: str = "") -> DataFrame:
    """A rollup with a root above the first level: levels from 2 on, the root's own row at 1 with the sum of all."""
    below = nodes.select("node", F.coalesce("parent", F.lit(root)).alias("parent"), (F.col("depth") + 1).alias("level"), "own", "total")
    top = nodes.filter(F.col("depth") == 1).agg(F.coalesce(F.sum("total"), F.lit(0)).cast("long").alias("total"))
    return below.unionByName(top.select(F.lit(root).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(1).alias("level"), F.lit(0).cast("long").alias("own"), "total"))


def node_count(nodes: DataFrame) -> DataFrame:
    """One row: the number of different nodes."""
    return nodes.agg(F.count_distinct("node").alias("nodes"))


def managed(links: DataFrame, managers: DataFrame, path: str = "menu_path") -> DataFrame:
    """(node, managers): the links with a manager at each node or below; a link with several counts for each."""
    both = links.select("id", path).join(managers.select(F.col("menu_id").alias("id")), "id")
    nodes = both.groupBy(hierarchy(F.col(path)).alias("segments")).agg(F.count(F.lit(1)).alias("n")).select("n", F.explode(prefixes(F.col("segments"))).alias("node"))
    return nodes.groupBy("node").agg(F.sum("n").alias("managers"))


def in_display_order(nodes: DataFrame, first_seen: DataFrame) -> DataFrame:
    """Nodes with their place among their parent's children: larger totals first, then whichever was seen first.

    first_seen: node, seen. Window partitions are the children of one node.
    """
    w = Window.partitionBy("parent").orderBy(F.col("total").desc(), "seen")
    return nodes.join(first_seen, "node").withColumn("place", F.row_number().over(w))
