"""Mixing sources to target weights by soft membership.

A multinomial logistic regression over hashed words, fitted on a labelled table,
gives each document a probability for each domain. Each document then gets a
nonnegative rate such that the expected tokens of the domains, the sum over
documents of rate x tokens x probability, come as near the targets as can be:
least squares on the relative errors, with a small pull of all rates towards 1
that makes the solution unique. Projected gradient steps solve for all rates at
once. A step needs of the other documents only the domains' errors, a few numbers,
so a document's rate is what the steps so far make of its own probabilities: rates
are never joined or collected, and a pass over the documents is one aggregate that
can apply several steps. Goals, what is reached and the size of the projected
gradient are in the result, as a table too, and in the log.

The budget is by default the one that asks of the domain with the largest target
just the tokens that it has, so that its documents have a rate near 1. A scarcer
domain is then repeated, as far as least squares goes, and never makes the mix smaller.

Defined cases: a null or empty text has no tokens and no words, its rate comes
from the classifier's intercept like any other's; a domain without labelled
documents has probability 0 everywhere and is left out; if one domain alone is
labelled, or none, all documents belong to it (to the first target) with rate 1;
labels that contradict each other for one id are left out; repeated rows get
equal rates; an empty table gives an empty result; null sources are kept; the
columns of the documents ride along, and other names of this operator begin
with two underscores.
"""

from __future__ import annotations

import logging
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.llm.common import WORD, let, written

log = logging.getLogger(__name__)

# The domains of the labelled table and their target weights.
TARGETS = {"clean": 0.97, "low": 0.02, "toxic": 0.01}


def domain_of_labels() -> Column:
    """The domain that a row of ``labels`` (quality, toxic) stands for."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")


def _tokens(text: Column) -> Column:
    """Lower-case letter runs, and runs of other signs than letters, digits, stops and white space."""
    t = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    words = F.filter(F.split(t, r"[^\p{L}]+"), lambda w: w != "")
    return F.concat(words, F.regexp_extract_all(t, F.lit(r"([^\p{L}\p{N}\s.,]+)"), F.lit(1)))


def n_tokens(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(f"({WORD})"), F.lit(1))).cast("long")


@dataclass
class Membership:
    """A fitted classifier: probabilities of ``domains`` in their order."""

    domains: list[str]
    model: LogisticRegressionModel | None
    n_features: int

    def with_posterior(self, docs: DataFrame, text: str = "text", into: str = "__posterior") -> DataFrame:
        if self.model is None:
            return docs.withColumn(into, F.array(*[F.lit(float(i == 0)) for i in range(len(self.domains))]))
        hashed = HashingTF(inputCol="__tokens", outputCol="__features", numFeatures=self.n_features, binary=True)
        scored = self.model.transform(hashed.transform(docs.withColumn("__tokens", _tokens(F.col(text)))))
        return scored.withColumn(into, vector_to_array("__probability")).drop("__tokens", "__features", "__raw", "__probability", "__prediction")


def fit_membership(docs: DataFrame, labelled: DataFrame, domains: list[str], sample_bound: int = 8_000, n_features: int = 1 << 15, rounds: int = 40) -> Membership:
    """Fits the classifier on at most about ``sample_bound`` labelled ids, picked by hash.

    labelled: doc_id, domain. The bound is what makes the sample's ids small
    enough to broadcast, whatever the size of the labelled table.
    """
    known = labelled.filter(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("lo"), F.max("domain").alias("hi"))
    known = known.filter("lo = hi").select(F.col("doc_id").alias("__id"), F.col("lo").alias("__domain"))
    n = labelled.count()
    if n > sample_bound:
        known = known.filter(F.pmod(F.xxhash64("__id", F.lit(3)), F.lit(1 << 20)) < F.lit(sample_bound * (1 << 20) // n))
    sample = docs.select(F.col("doc_id").alias("__id"), "text").join(F.broadcast(known), "__id")
    sample = written(sample.select("__domain", _tokens(F.col("text")).alias("__tokens")), "sample")
    found = {r[0] for r in sample.select("__domain").distinct().collect()}
    present = [d for d in domains if d in found]
    if len(present) < 2:
        return Membership(present or domains[:1], None, n_features)
    index = F.coalesce(*[F.when(F.col("__domain") == d, F.lit(float(i))) for i, d in enumerate(present)])
    hashed = HashingTF(inputCol="__tokens", outputCol="__features", numFeatures=n_features, binary=True).transform(sample.select("__tokens", index.alias("__label")))
    lr = LogisticRegression(featuresCol="__features", labelCol="__label", probabilityCol="__probability", rawPredictionCol="__raw", predictionCol="__prediction", family="multinomial", maxIter=rounds, regParam=0.003, elasticNetParam=0.5)
    return Membership(present, lr.fit(hashed.select("__features", "__label")), n_features)


@dataclass
class Rates:
    """A solved mix: the projected gradient steps that take every document's rate from 1 to its solution."""

    domains: list[str]
    steps: list[tuple[list[float], float]]  # (each domain's weighted error, (reached - goal) / share; the step's length)
    pull: float
    shares: list[float]  # expected tokens of each domain before, of all tokens
    goals: list[float]  # targets, of all tokens before
    reached: list[float]  # expected tokens after, of all tokens before
    residual: float = 0.0  # a bound for the largest entry of the projected gradient

    def column(self, posterior: Column) -> Column:
        """The rate for these probabilities: from 1, each step against the gradient, projected on what isn't negative."""
        rate = F.lit(1.0)
        for errors, length in self.steps:
            slope = sum((F.get(posterior, F.lit(d)) * F.lit(length * e) for d, e in enumerate(errors)), F.lit(-length * self.pull))
            rate = F.greatest(F.lit(0.0), rate * F.lit(1 - length * self.pull) - slope)
        return rate

    def of(self, posterior: np.ndarray) -> np.ndarray:
        """The rates of rows of probabilities."""
        rate = np.ones(len(posterior))
        for errors, length in self.steps:
            rate = np.maximum(0.0, rate * (1 - length * self.pull) - (posterior @ (length * np.array(errors)) - length * self.pull))
        return rate

    def table(self, spark: SparkSession) -> DataFrame:
        """domain, share, goal, reached: a row for each domain, as shares of all tokens before."""
        return spark.createDataFrame(list(zip(self.domains, self.shares, self.goals, self.reached, strict=True)), "domain string, share double, goal double, reached double")


def _passed(narrow: DataFrame, rates: Rates, errors: np.ndarray, total: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """One pass over all documents after the steps so far: what is reached; of the documents with a rate over 0 the
    expected tokens and the products of probabilities; the squared distance of the rates from 1; and the largest entry
    of the projected gradient at these errors. Each batch sends its sums alone."""
    n = len(rates.domains)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            w = batch.column(0).to_numpy(zero_copy_only=False).astype(float) / total
            p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            rate = rates.of(p)
            free = w * (rate > 0)
            far = np.abs(rate - np.maximum(0.0, rate - p @ errors - rates.pull * (rate - 1)))[w > 0].max(initial=0.0)
            sums = [*((w * rate) @ p), *(free @ p), *(p.T @ (free[:, None] * p)).ravel(), w @ np.square(rate - 1)]
            yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.float64())), pa.array([far])], ["sums", "far"])

    parts = narrow.select(F.col("__tokens").cast("double"), F.col("__posterior").cast("array<double>")).mapInArrow(work, "sums array<double>, far double")
    size = 2 * n + n * n + 1
    row = parts.agg(*[F.sum(F.get("sums", F.lit(i))) for i in range(size)], F.max("far")).first()
    sums = np.array(row[:size], float)
    return sums[:n], sums[n : 2 * n], sums[2 * n : -1].reshape(n, n), float(sums[-1]), float(row[size])


def solve(narrow: DataFrame, domains: list[str], targets: dict[str, float], budget: float | None = None, pull: float = 1e-3, most_steps: int = 60, tolerance: float = 1e-8) -> Rates:
    """The least-squares rates of ``narrow`` (__tokens, __posterior), by projected gradient steps over all documents.

    budget: tokens after mixing. A pass over the documents applies several steps and
    gives what is reached and the curvature among the documents whose rate isn't at 0;
    from these follow the next steps' errors as long as no more rates come to 0 or
    leave it, and their lengths, the inverse of each curvature in turn, the steepest
    first. If the pass finds that they made the objective larger, they are taken back
    for fewer of them, at last for the one step that always lowers it. It ends where
    no entry of the projected gradient is over ``tolerance``, and warns if ``most_steps``
    passes don't get there.
    """
    dims = range(len(domains))
    t = F.col("__tokens").cast("double")
    first = narrow.agg(F.sum(t), *[F.sum(t * F.get("__posterior", F.lit(d))) for d in dims]).first()
    total = first[0] or 0.0
    if not total:
        return Rates(domains, [], pull, [0.0] * len(domains), [0.0] * len(domains), [0.0] * len(domains))
    shares = [x / total for x in first[1:]]
    weight = sum(targets[d] for d in domains)
    wanted = [targets[d] / weight for d in domains]
    # the domain to be kept: the one with the largest target among those that have tokens
    most = max(((w, s / w) for s, w in zip(shares, wanted, strict=True) if w > 0 and s > 0), default=(0.0, 1.0))[1]
    goals = [w * (most if budget is None else budget / total) for w in wanted]
    out = Rates(domains, [], pull, shares, goals, list(shares))
    scale, goal = np.array([s if s > 0 else 1.0 for s in shares]), np.array([g if s > 0 else 0.0 for g, s in zip(goals, shares, strict=True)])

    def at(steps: list, foreseen: np.ndarray):
        """The objective, errors, curvature's parts and a bound of the projected gradient after these steps."""
        reached, held, gram, apart, far = _passed(narrow, replace(out, steps=steps), foreseen, total)
        errors = (reached - goal) / scale
        value = float(scale @ np.square(errors)) / 2 + pull / 2 * apart
        return value, errors, reached, held, gram, far + float(np.abs(errors - foreseen).max())

    def sweep(state) -> list[tuple[list[float], float, np.ndarray]]:
        """Steps from here with the errors foreseen after each."""
        _, errors, reached, held, gram, _ = state
        steep = np.sort(np.linalg.eigvalsh(gram / np.sqrt(np.outer(scale, scale))).clip(0) + pull)[::-1]
        planned = []
        for length in 1 / np.append(steep, pull):
            planned.append((errors.tolist(), float(length), None))
            reached = reached - length * (gram @ errors + pull * (reached - held))
            errors = (reached - goal) / scale
            planned[-1] = (*planned[-1][:2], errors)
        return planned

    state = at([], (np.array(shares) - goal) / scale)
    steepest = float(np.linalg.eigvalsh(state[4] / np.sqrt(np.outer(scale, scale))).max()) + pull  # of all documents: none is steeper
    passes = 1
    while state[-1] > tolerance and passes < most_steps:
        planned = sweep(state)
        while True:
            new = at([*out.steps, *[s[:2] for s in planned]], planned[-1][2])
            passes += 1
            if new[0] <= state[0] * (1 + 1e-12) or len(planned) == 1 and planned[0][1] <= 1 / steepest or passes >= most_steps:
                break
            planned = planned[: len(planned) // 2] if len(planned) > 1 else [(state[1].tolist(), 1 / steepest, state[1])]
        if new[0] > state[0] * (1 + 1e-9):
            break  # no step helps any more
        out.steps, state = [*out.steps, *[s[:2] for s in planned]], new
    out.reached, out.residual = state[2].tolist(), state[-1]
    said = f"mix after {passes} passes, {len(out.steps)} steps: goals {dict(zip(domains, goals, strict=True))}, reached {dict(zip(domains, out.reached, strict=True))}, projected gradient {out.residual:.2g}"
    log.info(said)
    if out.residual > tolerance:
        warnings.warn("the rates are not the optimum; " + said, stacklevel=2)
    return out


def fit(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, **options) -> tuple[Membership, Rates, DataFrame]:
    """The classifier, the solved rates, and a table of each row's id, source, tokens and probabilities."""
    targets = targets or TARGETS
    membership = fit_membership(docs, labelled, list(targets))
    keyed = membership.with_posterior(docs.select("doc_id", "source", "text"))
    narrow = written(keyed.select("doc_id", "source", n_tokens(F.col("text")).alias("__tokens"), "__posterior"), "posteriors")
    return membership, solve(narrow, membership.domains, targets, **options), narrow


def copies(rate: Column, key: Column) -> Column:
    """How often a row with this rate appears: its whole part, and once more with its fraction's probability, by a hash of its id."""
    chance = F.pmod(F.xxhash64(key, F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("long")


def document_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, **options) -> DataFrame:
    """doc_id, source, n_tokens, one p_<domain> for each target, rate and copies for each row of ``docs``;
    goal_<domain> and reached_<domain>, as shares of all tokens before, are the same in each row."""
    targets = targets or TARGETS
    membership, rates, narrow = fit(docs, labelled, targets, **options)
    place = {d: i for i, d in enumerate(membership.domains)}
    return narrow.withColumn("__rate", rates.column(F.col("__posterior"))).select(
        "doc_id", "source", F.col("__tokens").alias("n_tokens"),
        *[(F.get("__posterior", F.lit(place[d])) if d in place else F.lit(0.0)).alias(f"p_{d}") for d in targets],
        F.col("__rate").alias("rate"), copies(F.col("__rate"), F.col("doc_id")).alias("copies"),
        *[F.lit(rates.goals[place[d]] if d in place else 0.0).alias(f"goal_{d}") for d in targets],
        *[F.lit(rates.reached[place[d]] if d in place else 0.0).alias(f"reached_{d}") for d in targets],
    )


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, **options) -> DataFrame:
    """Each row of ``docs`` as often as its rate says, with its own columns.

    The rows are written with their probabilities, so that each text goes through
    the classifier once; solving reads its two columns alone.
    """
    targets = targets or TARGETS
    membership = fit_membership(docs, labelled, list(targets))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    scored = membership.with_posterior(docs.select(whole, F.col("doc_id").alias("__id"), F.col("text").alias("__text")), "__text")
    rows = written(scored.select("__row", "__id", n_tokens(F.col("__text")).alias("__tokens"), "__posterior"), "posteriors")
    rates = solve(rows.select("__tokens", "__posterior"), membership.domains, targets, **options)
    count = let(F.col("__posterior"), lambda p: copies(rates.column(p), F.col("__id")))
    repeated = rows.withColumn("__copies", count).filter("__copies > 0").withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies").cast("int"))))
    return repeated.select(*[F.col("__row")[c].alias(c) for c in docs.columns])
