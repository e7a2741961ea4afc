"""Retrieval: vector search, BM25, fusion, context.

Windows without a key run over lists of k hits alone, which ``best`` bounds. Defined cases:
null vectors, and those of another dimension, are no hits; null texts have no words; equal
scores are ordered by key; an id in both lists is one hit; empty lists give empty results.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.sources.shared import written

TOKEN_BREAK = r"[^\p{L}\p{N}]+"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def vector_topk(vectors: DataFrame, query: list[float], k: int | None, threshold: float | None = None, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, score): the k nearest by cosine; vectors that are null or of another dimension are left out.

    One pass; each task keeps k rows, so that k rows a task are all that moves.
    """
    usable = vectors.filter(F.col(column).isNotNull() & (F.size(column) == len(query)))
    q = F.array(*[F.lit(float(x)) for x in query])
    return best(usable.select(key, cosine(F.col(column), q).alias("score")), key, k, threshold)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits. (A stand-in for a morphological analyser.)"""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_BREAK), "")


def query_terms(query: str) -> list[str]:
    return sorted({t for t in re.split(r"[\W_]+", query.lower()) if t})


def _okapi(tf: Column, df: Column, n: Column, dl: Column, avg: Column, boost: float, k1: float, b: float) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return F.when(tf > 0, boost * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avg))).otherwise(0.0)


def best(scores: DataFrame, key: str, k: int | None, min_score: float | None) -> DataFrame:
    """The k rows with the largest scores, ``key`` for ties; all in no order where k is None."""
    if min_score is not None:
        scores = scores.filter(F.col("score") >= min_score)
    return scores if k is None else scores.orderBy(F.col("score").desc(), F.col(key)).limit(k)


def bm25(docs: DataFrame, query: str, fields: dict[str, float], k: int | None, min_score: float = 0.1, key: str = "id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score): Okapi scores summed over boosted fields; at least one term must match.

    One pass counts only the query's terms in each text, in place, and writes the
    counts; the corpus statistics, one row, and the scores come from that narrow
    table. No posting of a term that isn't asked for is made. Null texts are empty.
    """
    terms = query_terms(query)
    letter = r"[\p{L}\p{N}]"
    columns = []
    for f in fields:
        t = F.lower(F.coalesce(f, F.lit("")))
        columns.append(F.regexp_count(t, F.lit(f"{letter}+")).alias(f"__{f}_dl"))
        columns += [F.regexp_count(t, F.lit(rf"(?<!{letter})\Q{x}\E(?!{letter})")).alias(f"__{f}_tf{i}") for i, x in enumerate(terms)]
    counted = written(docs.select(key, *columns), "term-counts")
    facts = counted.agg(F.count(F.lit(1)).alias("__n"), *[F.avg(f"__{f}_dl").alias(f"__{f}_avg") for f in fields], *[F.count_if(F.col(f"__{f}_tf{i}") > 0).alias(f"__{f}_df{i}") for f in fields for i in range(len(terms))])
    joined = counted.crossJoin(facts)  # the facts are one row
    score = sum((_okapi(F.col(f"__{f}_tf{i}"), F.col(f"__{f}_df{i}"), F.col("__n"), F.col(f"__{f}_dl"), F.col(f"__{f}_avg"), boost, k1, b) for f, boost in fields.items() for i in range(len(terms))), F.lit(0.0))
    return best(joined.select(key, score.alias("score")).filter("score > 0"), key, k, min_score)


def fuse(vector: DataFrame, text: DataFrame, weights: tuple[float, float] = (0.7, 0.3), normalize: bool = False) -> DataFrame:
    """(id, combined_score, source_type): hits of both lists weighted together, others with their own score.

    Best first; equal scores keep the order vector hits, then text hits.
    """
    if normalize:
        vector, text = (d.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy(F.lit(1)))) for d in (vector, text))
    v = vector.select("id", F.col("score").alias("v"), F.col("rank").alias("vr"))
    t = text.select("id", F.col("score").alias("t"), F.col("rank").alias("tr"))
    both = v.join(t, "id", "full_outer")
    score = F.when(F.col("t").isNull(), F.col("v")).when(F.col("v").isNull(), F.col("t")).otherwise(F.col("v") * weights[0] + F.col("t") * weights[1])
    kind = F.when(F.col("t").isNull(), "vector").when(F.col("v").isNull(), "text").otherwise("both")
    return both.select("id", score.alias("combined_score"), kind.alias("source_type"), F.col("vr").isNull().cast("int").alias("late"), F.coalesce("vr", "tr").alias("place")).orderBy(F.col("combined_score").desc(), "late", "place")


def ranked(hits: DataFrame) -> DataFrame:
    """Adds rank, from 1, to a list of k hits (so one task is enough)."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("id"))))


def search_api(vector: DataFrame, text: DataFrame, limit: int, score_mode: str = "similarity") -> DataFrame:
    """(id, similarity_score, search_type): both lists scaled to 0..1 by their best; an id's first list wins.

    score_mode 'reference' takes a vector's score for a distance, as a known system does.
    """
    raw = F.col("score") if score_mode == "similarity" else F.greatest(F.lit(0.0), 1 - F.col("score"))
    top = F.max("score").over(Window.partitionBy(F.lit(1)))
    scaled = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(top > 0, c / top).otherwise(c)))
    v = vector.select("id", scaled(raw).alias("similarity_score"), F.lit("vector").alias("search_type"), F.lit(0).alias("late"), "rank")
    t = text.select("id", scaled(F.col("score")).alias("similarity_score"), F.lit("text").alias("search_type"), F.lit(1).alias("late"), "rank")
    first = F.row_number().over(Window.partitionBy("id").orderBy("late", "rank"))
    merged = v.unionByName(t).withColumn("__first", first).filter("__first = 1")
    return merged.orderBy(F.col("similarity_score").desc(), "late", "rank").limit(limit).select("id", "similarity_score", "search_type")


def score_range(hits: DataFrame) -> DataFrame:
    """One row: the largest and smallest score of a list, 1 and 0 for an empty one."""
    return hits.agg(F.coalesce(F.max("score"), F.lit(1.0)).alias("most"), F.coalesce(F.min("score"), F.lit(0.0)).alias("least"))


def min_max(hits: DataFrame) -> DataFrame:
    """Scores of a list of k hits put between 0 and 1; 1 where all are equal."""
    w = Window.partitionBy(F.lit(1))
    most, least = F.max("score").over(w), F.min("score").over(w)
    return hits.withColumn("score", F.when(most > least, (F.col("score") - least) / (most - least)).otherwise(1.0))


def tools_of_intents(intents: DataFrame, mapping: DataFrame, available: DataFrame, fallback: int = 10) -> DataFrame:
    """(question, tool): the available tools of a question's intents; the first ``fallback`` ones where none fits.

    intents: question, intent; mapping: intent, tool; available: ord, tool, a list of at most some hundred.
    """
    fitting = intents.join(mapping, "intent").join(available.select("tool"), "tool", "left_semi").select("question", "tool").distinct()
    first = available.orderBy("ord").limit(fallback).select("tool")
    none = intents.select("question").distinct().join(fitting.select("question").distinct(), "question", "left_anti")
    return fitting.unionByName(none.join(F.broadcast(first), F.lit(True)))


def context(hits: DataFrame, keyword: str, max_results: int, budget: float = 15000.0) -> DataFrame:
    """Rows of (id, title, content, place) that fit the context: keyword hits first, 2 x max_results at most, then the token budget.

    Tokens are words x 1.3; the first chunk over the budget ends the context.
    """
    first = F.when(F.contains(F.coalesce("title", F.lit("")), F.lit(keyword)), 0).otherwise(1)
    top = hits.withColumn("first", first).orderBy("first", "place").limit(2 * max_results)
    chunk = F.concat(F.lit("Title: "), F.coalesce("title", F.lit("")), F.lit("\nContent: "), F.coalesce("content", F.lit("")))
    words = F.size(F.filter(F.split(chunk, r"\s+"), lambda w: w != ""))
    w = Window.orderBy("first", "place")
    used = top.withColumn("n_words", words).withColumn("used_words", F.sum("n_words").over(w)).withColumn("position", F.row_number().over(w))
    return used.filter(F.col("used_words") * 1.3 <= budget).select("id", "position", "n_words", "used_words")


def intents_by_similarity(scores: DataFrame, threshold: float = 0.6, most: int = 3) -> DataFrame:
    """scores: question, intent, score of one example sentence each. The best intents of each question."""
    best = scores.groupBy("question", "intent").agg(F.max("score").alias("score")).filter(F.col("score") > threshold)
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.col("score").desc(), "intent"))
    return best.withColumn("place", place).filter(F.col("place") <= most)
