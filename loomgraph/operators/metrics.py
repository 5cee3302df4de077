"""Ranking metrics, agreement, bootstrap, losses and run bookkeeping."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.operators.ranking import running_position
from loomgraph.session import cut


def hits(ranks: DataFrame, rank: str = "rank", *by: str) -> DataFrame:
    """Hit@1, 3, 10 and MRR rounded to 4 places, 0 on empty input."""
    r = F.col(rank)
    z = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    g = ranks.groupBy(*by) if by else ranks
    return g.agg(F.count("*").alias("n"), *[z(F.avg((r <= k).cast("double"))).alias(f"hit{k}") for k in (1, 3, 10)], z(F.avg(1.0 / r)).alias("mrr"))


def latency(df: DataFrame, col: str) -> DataFrame:
    """Mean, median and 95th percentile by linear interpolation between ranks; null on empty input, nulls do not count.

    Ranks come from a range partition, so no task holds all values.
    """
    v = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("v"))
    ranked = cut(running_position(v, [], ["v"]))
    n = ranked.count()

    def at(share: float) -> Column:
        where, rest = divmod(share * (n - 1), 1)
        low, high = (F.max(F.when(F.col("rn") == int(where) + k, F.col("v"))) for k in (1, 2))
        return low if not rest else low + (high - low) * rest

    return ranked.agg(F.round(F.avg("v"), 6).alias("mean"), F.round(at(0.5), 6).alias("p50"), F.round(at(0.95), 6).alias("p95"))


def kappa(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Cohen's kappa of two 0/1 raters, raw agreement and pass rates in percent; kappa is null where chance agreement is 1."""
    x, y = a.cast("double"), b.cast("double")
    po, pa, pb = F.avg((x == y).cast("double")), F.avg(x), F.avg(y)
    pe = pa * pb + (1 - pa) * (1 - pb)
    return df.agg(F.round(F.when(pe < 1, (po - pe) / (1 - pe)), 6).alias("kappa"), F.round(100 * po, 2).alias("agreement"), F.round(100 * pa, 2).alias("pass_a"), F.round(100 * pb, 2).alias("pass_b"), F.count("*").alias("n"))


def best_by(df: DataFrame, group: list[str], score: str, *ties: str) -> DataFrame:
    """First strict maximum per group: highest score, then the tie columns in order. A two-phase minimum, no sort of a group."""
    rest = [c for c in df.columns if c not in group]
    m = df.where(F.col(score).isNotNull()).groupBy(*group) if group else df.where(F.col(score).isNotNull()).groupBy()
    best = m.agg(F.min(F.struct((-F.col(score)).alias("__s"), *ties, *[c for c in rest if c not in ties])).alias("b"))
    return best.where("b is not null").select(*group, *[F.col(f"b.{c}").alias(c) for c in rest])


#: Poisson(1): 2^48 times the probability of at most k, for k = 0, 1, ...
POISSON = tuple(int(2**48 * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(16))


def bootstrap(ranks: DataFrame, n_boot: int = 1000, seed: int = 0, centered: bool = False) -> DataFrame:
    """Share of resamples whose difference in mean reciprocal rank is at least the observed one in size.

    ranks: i (a key), rank_a, rank_b. Every row has in every resample a Poisson(1) weight, drawn by md5(seed|resample|key) and so the same in every engine; resample means are sums of
    weighted differences over sums of weights. Rows meet no other rows: one pass with a map-side aggregate of n_boot sums. centered subtracts the observed difference from each
    resample, which makes it a test; without, p stays near 0.5 for any large effect.
    """
    diff = ranks.select("i", (1.0 / F.col("rank_a") - 1.0 / F.col("rank_b")).alias("d"))
    obs = diff.agg(F.avg("d").alias("obs"))
    reps = diff.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), F.col("i").cast("string"))), 1, 12), 16, 10).cast("long")
    weighted = reps.withColumn("u", draw).withColumn("w", sum((F.col("u") >= t).cast("int") for t in POISSON))
    per = weighted.groupBy("rep").agg((F.sum(F.col("w") * F.col("d")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    x = per.join(F.broadcast(obs), how="inner")  # one row
    base = F.col("obs") if centered else F.lit(0.0)
    return x.agg(F.round(F.max("obs"), 6).alias("observed"), F.round(F.avg((F.round(F.abs(F.col("m") - base), 9) >= F.round(F.abs("obs"), 9)).cast("double")), 6).alias("p"))


def qa_loss(p_target: Column) -> Column:
    return F.avg(-F.log(F.greatest(p_target, F.lit(1e-12))))


def margin_loss(s_pos: Column, s_neg: Column, margin: float = 1.0) -> Column:
    return F.avg(F.greatest(F.lit(0.0), margin + s_pos - s_neg))


def masked_bce(pred: Column, target: Column, mask: Column) -> Column:
    """Mean over masked rows, 0 when there is none."""
    p = F.least(F.greatest(pred, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.coalesce(F.avg(F.when(mask, -(target * F.log(p) + (1 - target) * F.log(1 - p)))), F.lit(0.0))


def total_loss(qa: Column, kg: Column, vg: Column) -> Column:
    """Weighted sum 1.0, 0.5, 0.3."""
    return 1.0 * qa + 0.5 * kg + 0.3 * vg


def early_stop(history: DataFrame, patience: int, run: str = "run", epoch: str = "epoch", score: str = "mrr") -> DataFrame:
    """Adds best so far, epochs without a strict improvement, and whether training stops at this epoch (histories are short: one row per epoch)."""
    w = W.partitionBy(run).orderBy(epoch)
    before = F.max(score).over(w.rowsBetween(W.unboundedPreceding, -1))
    h = history.withColumn("improved", before.isNull() | (F.col(score) > before))
    last = F.max(F.when(F.col("improved"), F.col(epoch))).over(w.rowsBetween(W.unboundedPreceding, 0))
    h = h.withColumn("waited", (F.col(epoch) - last).cast("int"))
    stops = F.min(F.when(F.col("waited") >= patience, F.col(epoch))).over(W.partitionBy(run))
    return h.withColumn("stop", F.coalesce(F.col(epoch) == stops, F.lit(False))).withColumn("trained", F.coalesce(F.col(epoch) <= stops, F.lit(True)))


def nan_guard(steps: DataFrame, share: float = 0.05, least: int = 20) -> DataFrame:
    """Running share of NaN losses; abort from the first step with `least` steps seen and more than `share` NaN."""
    w = W.partitionBy("run").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    n, bad = F.count("*").over(w), F.sum(F.isnan("loss").cast("int")).over(w)
    return steps.select("run", "step", n.alias("seen"), bad.alias("n_nan"), ((n >= least) & (bad / n > share)).alias("abort"))


def loss_trend(steps: DataFrame, k: int = 10) -> DataFrame:
    """Mean of the first and the last k losses per run, whether it falls, NaN count."""
    a = F.row_number().over(W.partitionBy("run").orderBy("step"))
    b = F.row_number().over(W.partitionBy("run").orderBy(F.desc("step")))
    ok = F.when(~F.isnan("loss"), F.col("loss"))
    t = steps.withColumn("a", a).withColumn("b", b).withColumn("ok", ok)
    first, last = F.avg(F.when(F.col("a") <= k, F.col("ok"))), F.avg(F.when(F.col("b") <= k, F.col("ok")))
    return t.groupBy("run").agg(F.round(first, 6).alias("first_mean"), F.round(last, 6).alias("last_mean"), (last < first).alias("falls"), F.sum(F.isnan("loss").cast("int")).alias("n_nan"))


def run_status(expected: DataFrame, results: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Status of every expected (tag, seed): completed, in_progress_interrupted or not_started. results: tag, seed, converged."""
    j = expected.join(results.select("tag", "seed", "converged", F.lit(True).alias("has")), ["tag", "seed"], "left").join(checkpoints.select("tag", "seed", F.lit(True).alias("ck")), ["tag", "seed"], "left")
    s = F.when(F.col("has") & F.coalesce("converged", F.lit(False)), "completed").when(F.col("has").isNotNull() | F.col("ck").isNotNull(), "in_progress_interrupted").otherwise("not_started")
    return j.select("tag", "seed", s.alias("status"))


def list_rank(predictions: Column, answer: Column) -> Column:
    """Position of the answer in a ranked list, or one past its end."""
    return F.coalesce(F.nullif(F.array_position(predictions, answer), F.lit(0)), (F.size(predictions) + 1).cast("long"))


def complete(df: DataFrame, cols: list[str]) -> DataFrame:
    """Number of missing grades per column; all zero means the sheet may be scored."""
    return df.agg(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in cols])
