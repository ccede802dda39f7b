"""Mixing sources to target weights by temperature.

The token share of each source is raised to an exponent and normalised. The exponent is bisected so that the weights reach a target
entropy, or are as even as a repetition limit allows. The weights times a budget of tokens are then realised: each source is dealt as
permutations of its documents (epochs), whole ones first and of the last as many as its budget holds.

A permutation is the order of a hash of the row and the epoch. It is cut into blocks, ranges of the hash that hold a bounded number of
rows on average, so that running sums need one pass over block totals and one over the single block of each source in which the budget
ends. The decision on a row then is a comparison with its source's cut: one row for each source is joined, texts are not shuffled.

Defined results: a null source is a source of its own; null or empty texts have no tokens and cost nothing; identical rows of a source
stand or fall together in the last epoch; a null doc_id is an id like others; other columns pass through, those named like the
results are replaced. The budget of a source is
never exceeded, and what is left of it is smaller than its next group of identical rows. One row for each source reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointpanel.llm.line_rules import words_of
from pointpanel.session import stored

BLOCK_ROWS = 4096
SEED = 20
TOP = 1 << 62


@dataclass(frozen=True)
class Weights:
    exponent: float
    weights: np.ndarray
    budget: float


def tempered(totals: np.ndarray, exponent: float) -> np.ndarray:
    """Token shares raised to the exponent and normalised; sources without tokens have no weight."""
    logs = np.where(totals > 0, exponent * np.log(np.maximum(totals, 1)), -np.inf)
    powers = np.exp(logs - logs.max()) if np.isfinite(logs).any() else np.zeros(len(totals))
    return powers / max(powers.sum(), 1e-300)


def entropy(weights: np.ndarray) -> float:
    own = weights[weights > 0]
    return float(-(own * np.log(own)).sum())


def bisected(holds, steps: int = 60) -> float:
    """The smallest exponent in 0 to 1 at which ``holds`` is true, given that it stays true above; 1 if it never is."""
    if holds(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if holds(middle) else (middle, high)
    return high


def target_weights(
    totals: np.ndarray, budget: float | None = None, repetition: float | None = None, target_entropy: float | None = None
) -> Weights:
    """Weights of sources that hold ``totals`` tokens.

    ``target_entropy`` (nats): the exponent at which the entropy comes down to it. Otherwise ``repetition``: the smallest exponent at
    which no source is seen more than that many times. Without a budget, the budget is the least that shows every source once.
    """
    totals = np.asarray(totals, dtype=float)
    full = totals > 0

    def budget_of(weights: np.ndarray) -> float:
        if budget is not None:
            return float(budget)
        return float((totals[full] / weights[full]).max()) if full.any() else 0.0

    def seen(exponent: float) -> float:
        weights = tempered(totals, exponent)
        return float((budget_of(weights) * weights[full] / totals[full]).max()) if full.any() else 0.0

    if target_entropy is not None:
        exponent = bisected(lambda e: entropy(tempered(totals, e)) <= target_entropy)
    elif repetition is not None:
        exponent = bisected(lambda e: seen(e) <= repetition)
    else:
        exponent = 1.0
    weights = tempered(totals, exponent)
    allowed = budget_of(weights)
    if repetition is not None and seen(exponent) > repetition:
        allowed *= repetition / seen(exponent)  # more tokens than the limit allows at any exponent
    return Weights(exponent, weights, allowed)


def _place(epoch: Column) -> Column:
    """The row's place in an epoch's permutation, from 0 below ``TOP``."""
    return F.xxhash64(F.lit(SEED), epoch, "doc_id", "source", F.length("text")).bitwiseAND(F.lit(TOP - 1))


def mix(
    docs: DataFrame, budget: float | None = None, repetition: float | None = None, target_entropy: float | None = None
) -> DataFrame:
    """``docs`` realised at their sources' weights: a row for each time a document is seen, with ``epoch`` (from 0), ``place`` (its
    rank in the epoch as a fraction) and ``weight`` (of its source)."""
    spark = docs.sparkSession
    sized = docs.select("source", "doc_id", "text", F.size(words_of(F.col("text"))).cast("long").alias("tokens"))
    totals = sized.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).orderBy("source").collect()
    goal = target_weights(np.array([r["t"] for r in totals]), budget, repetition, target_entropy)
    rows = []
    for row, weight in zip(totals, goal.weights):
        times = goal.budget * weight / row["t"] if row["t"] else 1.0
        whole = int(times + 1e-9)
        rows.append((row["source"], float(weight), whole, int(max(times - whole, 0) * row["t"] + 1e-6)))
    plan = spark.createDataFrame(rows, "s string, weight double, whole int, rest long")
    blocks = max(1, -(-max((r["n"] for r in totals), default=1) // BLOCK_ROWS))
    width = TOP // blocks + 1
    own = plan["s"].eqNullSafe(F.col("source"))
    narrow = stored(sized.join(plan, own).select(
        "source", "rest", _place(F.col("whole")).alias("place"), "tokens").withColumn("block", F.floor(F.col("place") / F.lit(width))), "mixing")
    of_source = Window.partitionBy("source")
    ranked = narrow.groupBy("source", "rest", "block").agg(F.sum("tokens").alias("t")).withColumn(
        "up_to", F.sum("t").over(of_source.orderBy("block")))
    # The block in which the budget ends: all before it are taken whole.
    ends = ranked.where("up_to > rest").groupBy("source").agg(
        F.min_by(F.struct("block", (F.col("rest") - F.col("up_to") + F.col("t")).alias("left")), "block").alias("e")).select(
        F.col("source").alias("s"), "e.*")
    inside = narrow.join(ends, narrow["source"].eqNullSafe(ends["s"]) & (narrow["block"] == ends["block"])).select(
        "source", "place", "tokens", "left", ends["block"])
    cut = inside.withColumn("up_to", F.sum("tokens").over(of_source.orderBy("place"))).groupBy("source", "block").agg(
        F.max(F.when(F.col("up_to") <= F.col("left"), F.col("place"))).alias("last")).select(
        F.col("source").alias("s"), F.coalesce("last", F.col("block") * F.lit(width) - 1).alias("cut"))
    cuts = {r["s"]: r["cut"] for r in cut.collect()}
    final = spark.createDataFrame(
        [(s, w, n, int(cuts.get(s, TOP))) for s, w, n, _ in rows], "_source string, weight double, _whole int, _cut long")
    docs = docs.drop("weight", "epoch", "place", *final.columns)
    times = F.col("_whole") + (_place(F.col("_whole")) <= F.col("_cut")).cast("int")
    dealt = docs.join(final, final["_source"].eqNullSafe(docs["source"])).where(times > 0)
    dealt = dealt.withColumn("epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    return dealt.withColumn("place", _place(F.col("epoch")) / F.lit(float(TOP))).drop("_source", "_whole", "_cut")
