"""Near copies by the Jaccard similarity of word shingles, each link confirmed.

First op 5's method: every text gets a SimHash fingerprint of 64 bits from its
shingles, ``simhash.stars`` joins the fingerprints with themselves by tries, within a
budget of ``ERRORS`` bits, and the links found are confirmed by the shingle sets.
A pair at a similarity of 0.8 differs in about 10 bits, more than any budget that
still prunes a trie, so the tries alone would lose links between different texts.
What they leave apart goes through an exact rest: every text gets 32 independent
values, each hashed from 5 minima over its shingles' hashes; texts with an equal value
are candidates. A pair at 0.8 is one with probability 1 - (1 - 0.8^5)^32, all but 3 in
a million, and a likelier one above. A group of texts with an equal value is never held
by one task, and one that the tries have made one component is done. In the others the
text with the most candidates is compared with each text outside its component. Of the
groups that are still parted, the texts outside the group's largest component are
compared with all others of it, in blocks of bounded size, each pair in the first group
that both share. So every link that merges texts is confirmed, and no link within a
group is missed.

Defined cases: words and case are those of ``simhash.fingerprint``; texts with the
same words in the same order are one (told by 64 bits of their hash); a text with fewer
words than a shingle has is one shingle; null, empty and blank texts are one
another's copies and no other's; a null id is a member but never stands for its
component, unless all members' ids are null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwell.llm.common import written
from loomwell.llm.simhash import SEED, components, majority, stars

#: Bits in which the tries' fingerprints may differ.
ERRORS = 5
BANDS, MINIMA = 32, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DRAWN = np.random.default_rng(SEED)
_FACTOR = _DRAWN.integers(0, 1 << 63, BANDS * MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _DRAWN.integers(0, 1 << 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)


def words(text: Column) -> Column:
    """The text's words in ASCII lower case with one space between."""
    t = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.trim(F.regexp_replace(t, r"[\x20\x09-\x0D]+", " "))


def shingles(text: str, size: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; the words stand as ``words`` gives them."""
    import xxhash

    w = text.encode("utf-8", "surrogatepass").split(b" ") if text else []
    if not w:
        return np.zeros(0, np.uint64)
    parts = [b" ".join(w)] if len(w) <= size else map(b" ".join, zip(*(w[i:] for i in range(size))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in parts), np.uint64))


def bands(h: np.ndarray) -> np.ndarray:
    """The fingerprints of a shingle set: minima under independent orders, hashed in groups."""
    least = np.full(len(_FACTOR), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 256):  # small enough for the processor's cache
        x = h[None, at : at + 256] * _FACTOR[:, None]
        # the product's upper half depends on all bits of the hash
        np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=1), out=least)
    x = (least.reshape(BANDS, MINIMA) * _MIX).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def _fingerprints(text: Column, size: int) -> Column:
    """The SimHash of a text's shingle set and its values of minima; null without words."""

    def one(t: str) -> tuple[int | None, np.ndarray | None]:
        h = shingles(t, size)
        return (int(np.uint64(majority(h)).astype(np.int64)), bands(h)) if len(h) else (None, None)

    @F.pandas_udf("fp long, bands array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        found = {t: one(t) for t in texts.unique()}  # copies in a batch once
        return pd.DataFrame({"fp": pd.array([found[t][0] for t in texts], "Int64"), "bands": pd.Series([found[t][1] for t in texts], dtype=object)})

    return of(text)


def _sets(text: Column, size: int) -> Column:
    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.sort(shingles(t, size).view(np.int64)) for t in texts], dtype=object)

    return of(text)


def trie_pairs(distinct: DataFrame, errors: int = ERRORS) -> DataFrame:
    """(a, b): pairs of nodes that span what the trie self-join of their fingerprints links. Columns: node, fp (null: no words)."""
    prints = written(distinct.filter("fp is not null").groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    first = lambda fp, name: prints.select(F.col("fp").alias(fp), F.col("first").alias(name))
    linked = stars(prints.select("fp"), errors).distinct().join(first("u", "b"), "u").join(first("v", "a"), "v").select("a", "b")
    equal = distinct.join(prints, "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return linked.unionByName(equal)


def _confirmed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(u, v), u > v: those of the pairs (a, b) whose shingle sets have the similarity."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    common = both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), (F.size("x") + F.size("y")).alias("total"), F.size(F.array_intersect("x", "y")).alias("common"))
    return common.filter(F.col("common") >= F.lit(least) * (F.col("total") - F.col("common")) - 1e-9).select("u", "v")


@dataclass
class _Block:
    """Rows of one group: of two of its parts, or of one."""

    part: np.ndarray
    node: np.ndarray
    label: np.ndarray
    bands: np.ndarray  # rows x BANDS
    hashes: np.ndarray  # all rows' sets, one after the other
    begin: np.ndarray

    def links(self, at: int, least: float) -> tuple[list[int], list[int]]:
        """Pairs of nodes with the similarity, across the parts or inside the one, but for those of one component."""
        size = np.diff(self.begin)
        two = self.part.min() != self.part.max()
        label, out = self.label.copy(), ([], [])
        for i in range(len(self.node)):
            ok = (label != label[i]) & (size >= least * size[i] - 1e-6) & (size * least <= size[i] + 1e-6)
            ok &= self.part > self.part[i] if two else np.arange(len(label)) > i
            other = np.flatnonzero(ok)
            if not len(other):
                continue
            # pairs that share an earlier fingerprint are compared there
            other = other[~(self.bands[other, :at] == self.bands[i, :at]).any(axis=1)]
            if not len(other):
                continue
            own, n = self.hashes[self.begin[i] : self.begin[i + 1]], size[other]
            ends = np.cumsum(n)
            flat = self.hashes[np.repeat(self.begin[other] - ends + n, n) + np.arange(ends[-1])]
            place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            common = np.add.reduceat((own[place] == flat).astype(np.int64), ends - n)
            for j in other[common >= least * (size[i] + n - common) - 1e-9].tolist():
                out[0].append(int(self.node[i]))
                out[1].append(int(self.node[j]))
                label[label == label[j]] = label[i]
        return out


def _compared(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links of a task's groups. Rows come sorted by band, x, y: one block after the other."""
    held: list[pa.RecordBatch] = []

    def block() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        lists = whole["hashes"].combine_chunks()
        number = lambda c: whole[c].to_numpy()
        flat = lists.flatten().to_numpy()
        begin = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        b = _Block(number("part"), number("node"), number("label"), whole["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS), flat, begin)
        u, v = b.links(int(number("at")[0]), least)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("band", "x", "y")])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            now = batch.slice(lo, hi - lo)
            if held and any(held[-1].column(c)[0] != now.column(c)[0] for c in ("band", "x", "y")):
                yield block()
            held.append(now)
    if held:
        yield block()


def _open_links(members: DataFrame, labels: DataFrame, sets: DataFrame, least: float, most_rows: int = 2_000, most_hashes: int = 1 << 20) -> DataFrame:
    """(u, v): links within the groups whose texts still lie in several components, all but those of one component.

    A group is cut into parts of about ``most_rows`` rows and ``most_hashes`` hashes:
    parts of its largest component, and of the others. Each part of the others meets
    every part; the largest component's never meet one another.
    """
    now = members.join(labels, "node", "left").select("band", "at", "node", "size", F.coalesce("label", "node").alias("label"))
    classes = now.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("m"))
    facts = classes.groupBy("band").agg(F.max_by(F.struct("label", "n", "m"), F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.sum("m").alias("m"), F.count(F.lit(1)).alias("several")).filter("several > 1")
    parts = lambda n, m: F.greatest(F.ceil(n / F.lit(most_rows)), F.ceil(m / F.lit(most_hashes)), F.lit(1)).cast("int")
    facts = facts.select("band", F.col("top.label").alias("top"), parts(F.col("top.n"), F.col("top.m")).alias("of_top"), parts(F.col("n") - F.col("top.n"), F.col("m") - F.col("top.m")).alias("of_rest"))
    rows = now.join(facts, "band")
    rest = F.col("label") != F.col("top")
    mixed = F.xxhash64("node", F.lit(1))
    part = F.when(rest, F.pmod(mixed, F.col("of_rest"))).otherwise(F.col("of_rest") + F.pmod(mixed, F.col("of_top"))).cast("int")
    met = F.sequence(F.lit(0), F.when(rest, F.col("of_rest") + F.col("of_top")).otherwise(F.col("of_rest")) - 1)
    rows = rows.select("band", "at", "node", "label", part.alias("part"), F.explode(met).alias("other"))
    rows = rows.select("band", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "at", "node", "label", "part")
    whole = rows.join(sets.select("node", "bands", "hashes"), "node").repartition("band", "x", "y").sortWithinPartitions("band", "x", "y")
    return whole.mapInArrow(lambda it: _compared(it, least), "u long, v long").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, least: float = 0.8, most_rows: int = 2_000, errors: int = ERRORS) -> tuple[DataFrame, DataFrame]:
    """id and node (of its words) of each row; and node, id (its smallest) and label (its component's smallest node) of each distinct text."""
    node = F.xxhash64("__words").alias("node")
    plain = docs.select(F.col(key).alias("id"), words(F.col(text)).alias("__words"))
    found = plain.select("id", node, _fingerprints(F.col("__words"), size).alias("of"))
    rows = written(found.select("id", "node", "of.fp", "of.bands"), "bands")
    distinct = written(rows.groupBy("node").agg(F.min("id").alias("id"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands")), "distinct")
    tried = written(trie_pairs(distinct.select("node", "fp"), errors), "tries")
    keyed = distinct.select("node", F.posexplode("bands").alias("at", "band"))
    several = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = written(keyed.join(several, "band"), "candidates")
    in_tries = tried.select(F.explode(F.array("a", "b")).alias("node"), F.lit(0).cast("long").alias("n"))
    known = members.select("node", "n").unionByName(in_tries).groupBy("node").agg(F.sum("n").alias("candidates"))
    # a text is taken from the row with its smallest id, so that a text that many rows have is no hot key
    wanted = distinct.join(known, "node").select(F.col("node").alias("__node"), F.col("id").alias("__id"), "candidates", "bands")
    texts = plain.select("id", node, "__words").join(wanted, (F.col("node") == F.col("__node")) & F.col("id").eqNullSafe(F.col("__id")))
    texts = texts.groupBy("node").agg(F.any_value("candidates").alias("candidates"), F.any_value("bands").alias("bands"), F.any_value("__words").alias("__words"))
    sets = written(texts.select("node", "candidates", "bands", _sets(F.col("__words"), size).alias("hashes")), "sets")
    links = written(_confirmed(tried, sets, least), "links")
    facts = sets.select("node", "candidates", F.size("hashes").alias("size")).join(components(links, "labels"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    members = written(members.join(facts, "node"), "members")

    # groups that the tries have made one component need no more
    lead = members.groupBy("band").agg(F.max_by(F.struct("node", "size", "label"), F.struct("candidates", "node")).alias("lead"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    pairs = members.join(lead, "band").filter(F.col("lead.label") != F.col("label")).select(F.col("lead.node").alias("a"), F.col("node").alias("b"), F.least("lead.size", "size").alias("small"), F.greatest("lead.size", "size").alias("large"))
    # a size outside this can't reach the similarity
    pairs = pairs.filter(F.col("small") >= F.lit(least) * F.col("large") - 1e-6).select("a", "b").distinct()
    links = written(links.unionByName(_confirmed(pairs, sets, least)), "links")
    further = written(_open_links(members.drop("label"), components(links, "labels"), sets, least, most_rows), "links")
    labels = components(links.unionByName(further), "labels")
    return rows.select("id", "node"), distinct.select("node", "id").join(labels, "node", "left").select("node", "id", F.coalesce("label", "node").alias("label"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each component of ``docs``, with its own columns: the one with the smallest id, then the smallest node.

    Of rows that repeat id and words that with the smallest hash of its columns stays.
    """
    rows, found = near_copies(docs, key, text, size, least)
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("best")
    chosen = found.groupBy("label").agg(best).select(F.col("best.id").alias("__c"), F.col("best.node").alias("__f"))
    repeated = rows.groupBy("id", "node").count().filter("count > 1").select(F.col("id").alias("__i"), F.col("node").alias("__n"), F.lit(True).alias("__again"))
    chosen = chosen.join(repeated, F.col("__c").eqNullSafe(F.col("__i")) & (F.col("__f") == F.col("__n")), "left").select("__c", "__f", F.coalesce("__again", F.lit(False)).alias("__again"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(key).alias("__id"), F.xxhash64(words(F.col(text))).alias("__node"))
    kept = keyed.join(chosen, F.col("__id").eqNullSafe(F.col("__c")) & (F.col("__node") == F.col("__f")))
    one = kept.filter("__again").groupBy("__id", "__node").agg(F.min_by("__row", F.xxhash64("__row")).alias("__row"))
    both = kept.filter("not __again").select("__row").unionByName(one.select("__row"))
    return both.select(*[F.col("__row")[c].alias(c) for c in docs.columns])
