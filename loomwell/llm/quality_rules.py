"""Quality rules: a decision list learned by sequential covering.

``text_statistics`` measures whole texts with built-in functions only. The
learner bins the statistics of labelled documents, and grows one conjunction of
thresholds at a time from grouped counts, prunes it on rows held out from the
growing, and goes on with the rows that no earlier rule covers. The result is an
ordered list of rules, which ``DecisionList.verdict`` turns into one Spark
conditional expression.

Defined cases: a null or empty text has no words and fails the base rule; texts
of any length are measured whole; repeated rows are judged one by one and alike;
labels that are null or that contradict each other for one id are left out; with
no usable labels the list is empty, so that only the base rule rejects; other
columns of the documents are never looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwell.llm.common import WORD, let

#: What a rule may test, each as an expression over the struct of statistics.
FEATURES = ("symbols_per_word", "capital_share", "shouts_per_word", "repeat_share", "dup_line_share", "distinct_share", "mean_word", "digit_share", "log_words")


def _windows(words: Column, make) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - 5), make)


def _next(a: Column) -> Column:
    """The array from its second element on."""
    return F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))


def _repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more, from the words.

    Sorting the windows brings equal ones together; the places of those with an
    equal neighbour, in order, cover five words each less the overlap.
    """
    windows = F.sort_array(_windows(words, lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, F.lit(5))).alias("g"), i.alias("i"))))

    def places(s: Column) -> Column:
        equal = F.zip_with(s, _next(s), lambda a, b: F.coalesce(a["g"] == b["g"], F.lit(False)))
        twin = let(equal, lambda e: F.zip_with(e, F.concat(F.array(F.lit(False)), e), lambda a, b: F.coalesce(a, F.lit(False)) | b))
        return F.sort_array(F.array_compact(F.zip_with(s, twin, lambda x, d: F.when(d, x["i"]))))

    def covered(p: Column) -> Column:
        steps = F.zip_with(p, _next(p), lambda a, b: F.least(F.lit(5), F.coalesce(b - a, F.lit(5))))
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

    exact = let(let(windows, places), covered)
    # equal windows have equal hashes: only texts with a repeated hash are looked at closely
    hashes = _windows(words, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)]))
    repeated = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.when(F.size(words) >= 5, repeated).otherwise(F.lit(False)), exact).otherwise(F.lit(0))


def text_statistics(text: Column) -> Column:
    """A struct of counts over the whole text."""
    count = lambda x: x.cast("long")
    t = F.coalesce(text.cast("string"), F.lit(""))

    def measured(w: Column, lines: Column) -> Column:
        return F.struct(
            count(F.size(w)).alias("n_words"),
            count(F.length(F.array_join(w, ""))).alias("word_chars"),
            count(F.regexp_count(t, F.lit("[#*$%&|<>]"))).alias("n_symbols"),
            count(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            count(_repeat_words(w)).alias("n_repeat_words"),
            count(F.size(lines)).alias("n_lines"),
            count(F.size(F.array_distinct(w))).alias("n_distinct"),
            count(F.regexp_count(t, F.lit("[A-Z]"))).alias("n_capitals"),
            count(F.regexp_count(t, F.lit("!"))).alias("n_shouts"),
            count(F.regexp_count(t, F.lit("[0-9]"))).alias("n_digits"),
        )

    words = F.regexp_extract_all(t, F.lit(f"({WORD})"), F.lit(1))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    return let(F.struct(words.alias("w"), lines.alias("l")), lambda x: let(x["w"], lambda w: let(x["l"], lambda li: measured(w, li))))


def features(stats: Column) -> dict[str, Column]:
    words, chars = F.greatest(stats["n_words"], F.lit(1)), F.greatest(stats["word_chars"], F.lit(1))
    return {
        "symbols_per_word": stats["n_symbols"] / words,
        "capital_share": stats["n_capitals"] / chars,
        "shouts_per_word": stats["n_shouts"] / words,
        "repeat_share": stats["n_repeat_words"] / words,
        "dup_line_share": stats["n_dup_lines"] / F.greatest(stats["n_lines"], F.lit(1)),
        "distinct_share": stats["n_distinct"] / words,
        "mean_word": stats["word_chars"] / words,
        "digit_share": stats["n_digits"] / chars,
        "log_words": F.log1p(stats["n_words"].cast("double")),
    }


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, values: dict[str, Column]) -> Column:
        return values[self.feature] > F.lit(self.threshold) if self.above else values[self.feature] <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Rules in order; the first that holds rejects, none keeps."""

    rules: list[list[Condition]] = field(default_factory=list)

    def fired(self, stats: Column) -> Column:
        """The rule that holds first, as text; null if none does."""
        values = features(stats)
        out = F.lit(None).cast("string")
        for rule in reversed(self.rules):
            holds = reduce(lambda a, b: a & b, (c.column(values) for c in rule))
            out = F.when(holds, F.lit(" and ".join(map(str, rule)))).otherwise(out)
        return out

    def verdict(self, stats: Column) -> Column:
        """True for a text that is kept."""
        return ~base_failed(stats) & self.fired(stats).isNull()


def labelled_sample(labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(doc_id, y), y = 1 for bad: about ``bound`` ids at most, picked by hash."""
    one = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("lo"), F.max(label).alias("hi"))
    one = one.filter("lo = hi").select("doc_id", (F.col("lo") == 0).cast("int").alias("y"))
    n = labels.count()
    return one if n <= bound else one.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < F.lit(bound * (1 << 20) // n))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    sample_bound: int = 20_000,
    cuts: int = 24,
    max_rules: int = 8,
    max_conditions: int = 3,
    precision: float = 0.95,
    least_cover: int = 3,
) -> DecisionList:
    """Sequential covering over the labelled documents that pass the base rule.

    ``sample_bound`` bounds the labelled rows that are used (the join's small
    side is therefore of bounded size); everything the driver sees are counts
    for each feature and bin, so at most features x (cuts + 1) x 4 rows a step.
    """
    sample = labelled_sample(labels, label, sample_bound)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = rows.select("doc_id", "y", text_statistics(F.col("text")).alias("stats")).persist()
    grow = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(3)) > 0
    passed = rows.filter(~base_failed(F.col("stats"))).select("y", grow.alias("grow"), *[v.alias(k) for k, v in features(F.col("stats")).items()])
    try:
        quantiles = passed.agg(*[F.percentile_approx(k, [i / cuts for i in range(1, cuts)], 10_000).alias(k) for k in FEATURES], *[F.percentile_approx(F.when(F.col("y") == 1, F.col(k)), [i / 8 for i in range(9)], 10_000).alias(f"{k}_bad") for k in FEATURES]).first()
        points = {k: _with_middles({float(x) for x in [*(quantiles[k] or []), *(quantiles[f"{k}_bad"] or [])] if x is not None}) for k in FEATURES}
        binned = passed.select("y", "grow", *[_bin(F.col(k), points[k]).alias(k) for k in FEATURES])
        binned = binned.groupBy("y", "grow", *FEATURES).agg(F.count(F.lit(1)).alias("n")).persist()
        try:
            return DecisionList(_cover(binned, points, max_rules, max_conditions, precision, least_cover))
        finally:
            binned.unpersist()
    finally:
        rows.unpersist()


def _with_middles(points: set[float]) -> list[float]:
    """The points and the middles between them: a threshold may then lie in a gap, away from the rows on either side."""
    p = sorted(points)
    return sorted({*p, *((a + b) / 2 for a, b in zip(p, p[1:], strict=False))})


def _bin(value: Column, points: list[float]) -> Column:
    """How many of the points the value lies above."""
    return F.size(F.filter(F.array(*map(F.lit, points)).cast("array<double>"), lambda x: value > x))


def _counts(binned: DataFrame, where: Column) -> dict[tuple[str, bool], dict[int, list[int]]]:
    """For each feature and half of the rows, by bin: [good, bad] rows."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(k).alias("b")) for k in FEATURES]))
    out: dict = {}
    for r in binned.filter(where).select("y", "grow", "n", cells.alias("c")).groupBy("c.f", "c.b", "grow", "y").agg(F.sum("n").alias("n")).collect():
        out.setdefault((r["f"], r["grow"]), {}).setdefault(r["b"], [0, 0])[r["y"]] += r["n"]
    return out


def _holds(conditions: list[tuple[str, bool, int]]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f) > F.lit(b) if above else F.col(f) <= F.lit(b) for f, above, b in conditions], F.lit(True))


def _side(bins: dict[int, list[int]], above: bool, cut: int) -> tuple[int, int]:
    chosen = [v for b, v in bins.items() if (b > cut) == above]
    return sum(v[1] for v in chosen), sum(v[0] for v in chosen)


def _cover(binned: DataFrame, points: dict[str, list[float]], max_rules: int, max_conditions: int, precision: float, least_cover: int) -> list[list[Condition]]:
    from math import log2

    rules: list[list[tuple[str, bool, int]]] = []
    remaining = F.lit(True)
    for _ in range(max_rules):
        grown: list[tuple[str, bool, int]] = []
        pruned_score: list[tuple[float, int, int]] = []
        while len(grown) < max_conditions:
            counts = _counts(binned, remaining & _holds(grown))
            some = next((v for (_, grow), v in sorted(counts.items()) if grow), {})
            p0, n0 = (sum(v[1] for v in some.values()), sum(v[0] for v in some.values())) if some else (0, 0)
            if not p0 or grown and not n0:
                break
            best: tuple = (0.0, None)
            for f in FEATURES:
                bins = counts.get((f, True), {})
                for cut in range(len(points[f])):
                    for above in (True, False):
                        p, n = _side(bins, above, cut)
                        if p >= least_cover:
                            gain = p * (log2(p / (p + n)) - log2(p0 / (p0 + n0)))
                            if gain > best[0] + 1e-9:
                                best = (gain, (f, above, cut))
            if best[1] is None:
                break
            f, above, cut = best[1]
            # of the thresholds that part the rows alike, the middle one
            bins = counts[f, True]
            alike = [c for c in range(cut, len(points[f])) if _side(bins, above, c) == _side(bins, above, cut)]
            cut = alike[len(alike) // 2]
            grown.append((f, above, cut))
            held = _side(counts.get((f, False), {}), above, cut)
            p, n = _side(counts[f, True], above, cut)
            # the rule so far on rows held out; few of those leave it to the rows it grew on
            hp, hn = held if sum(held) >= least_cover else (p, n)
            pruned_score.append(((hp - hn) / (hp + hn), hp, len(grown)))
        if not grown:
            break
        score, _, keep = max(pruned_score, key=lambda x: (x[0], -x[2]))
        if (score + 1) / 2 < precision:
            break
        rules.append(grown[:keep])
        remaining = remaining & ~_holds(grown[:keep])
    return [[Condition(f, above, points[f][cut]) for f, above, cut in rule] for rule in rules]


def quality_rules(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """One row for each document: its counts, ``base_failed``, ``kept`` and the rule that rejects it."""
    s = F.col("__stats")
    return docs.select(F.col("doc_id"), text_statistics(F.col("text")).alias("__stats")).select(
        F.col("doc_id"),
        *[s[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed(s).alias("base_failed"),
        rules.verdict(s).alias("kept"),
        F.when(base_failed(s), F.lit("base")).otherwise(rules.fired(s)).alias("rule"),
    )


def keep_good(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns."""
    return docs.filter(let(text_statistics(F.col("text")), rules.verdict))
