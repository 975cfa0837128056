"""Distributions of rewards: summary, histogram, comparison and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .ordering import running_counts

PERCENTILES = (5, 25, 50, 75, 95)


def percentiles(df: DataFrame, column: str, points: tuple[float, ...], by: list[str] | None = None) -> DataFrame:
    """(by..., point, value): exact linear percentiles of all rows or groups, without gathering a group in one task.

    Values are counted and the counts get running totals; only the two values around each point go on.
    """
    by = by or []
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("v")).agg(F.count("*").alias("c"))
    ranked = running_counts(counts, by, "v")
    # a value holds the places from upto - c to upto - 1
    holds = lambda r: (r >= F.col("upto") - F.col("c")) & (r < F.col("upto"))
    lo = lambda p: F.floor(p * (F.col("n") - 1))
    hi = lambda p: F.least(lo(p) + 1, F.col("n") - 1)
    at = F.filter(F.array(*(F.lit(float(p)) for p in points)), lambda p: holds(lo(p)) | holds(hi(p)))
    near = ranked.select(*by, "v", "c", "upto", "n", F.explode(at).alias("point"))
    q = F.col("point")
    near = near.select(*by, "point", "v", holds(lo(q)).alias("low"), holds(hi(q)).alias("high"), (q * (F.col("n") - 1) - lo(q)).alias("f"))
    g = near.groupBy(*by, "point").agg(F.max(F.when(F.col("low"), F.col("v"))).alias("a"), F.max(F.when(F.col("high"), F.col("v"))).alias("b"), F.first("f").alias("f"))
    return g.select(*by, "point", (F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias("value"))


def distribution(df: DataFrame, reward: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean, population deviation, extremes, median and linear percentiles, over all rows or by groups."""
    x, by = F.col(reward), by or []
    base = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    p = percentiles(df, reward, tuple(q / 100 for q in PERCENTILES), by)
    wide = p.groupBy(*by).agg(*(F.max(F.when(F.abs(F.col("point") - q / 100) < 1e-9, F.col("value"))).alias(f"p{q}") for q in PERCENTILES))
    if not by:
        return base.join(F.broadcast(wide))
    same = [base[c].eqNullSafe(wide[c]) for c in by]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return base.join(wide, cond, "left").select(*(base[c] for c in base.columns), *(wide[f"p{q}"] for q in PERCENTILES))


def histogram(df: DataFrame, reward: str, bins: int = 50) -> DataFrame:
    """(bin, lo, hi, n): equal bins from least to greatest, the last closed at the right; around a constant, half a unit to either side."""
    x = F.col(reward).cast("double")
    lim = df.where(x.isNotNull()).agg(F.min(x).alias("a"), F.max(x).alias("b")).select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    placed = df.where(x.isNotNull()).join(F.broadcast(lim)).select(F.least(F.floor((x - F.col("a")) / ((F.col("b") - F.col("a")) / bins)), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = placed.groupBy("bin").agg(F.count("*").alias("n"))
    grid = lim.where("a is not null").select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "a", "b")
    step = (F.col("b") - F.col("a")) / bins
    return grid.join(counts, "bin", "left").select("bin", (F.col("a") + F.col("bin") * step).alias("lo"), (F.col("a") + (F.col("bin") + 1) * step).alias("hi"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Differences of two one-row distributions, b less a."""
    x, y = a.select(*(F.col(c).alias(f"a_{c}") for c in a.columns)), b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns))
    return x.join(F.broadcast(y)).select((F.col("b_mean") - F.col("a_mean")).alias("mean_diff"), (F.col("b_p50") - F.col("a_p50")).alias("median_diff"), (F.col("b_std") / F.greatest("a_std", F.lit(1e-8))).alias("std_ratio"), (F.col("a_max") - F.col("a_min")).alias("range_a"), (F.col("b_max") - F.col("b_min")).alias("range_b"))


def drift(baseline: DataFrame, current: DataFrame, reward: str, bins: int = 50, epsilon: float = 1e-10) -> DataFrame:
    """Shift of mean, spread and range, divergence of the histograms by bin number, and whether it is significant."""
    base = materialize(distribution(baseline, reward), "distribution")  # one row, read twice
    d = compare(base, distribution(current, reward)).join(F.broadcast(base.select(F.col("mean").alias("base_mean"))))
    p, q = histogram(baseline, reward, bins), histogram(current, reward, bins)
    tp, tq = p.agg(F.sum("n").alias("tp")), q.agg(F.sum("n").alias("tq"))
    both = p.select("bin", F.col("n").alias("np")).join(q.select("bin", F.col("n").alias("nq")), "bin").join(F.broadcast(tp)).join(F.broadcast(tq))
    a, b = F.col("nq") / F.col("tq") + epsilon, F.col("np") / F.col("tp") + epsilon
    k = both.agg(F.sum(a * F.ln(a / b)).alias("kl"))
    x = d.join(F.broadcast(k))
    relative = F.col("mean_diff") / F.greatest(F.abs("base_mean"), F.lit(1e-8))
    return x.select(F.col("mean_diff").alias("mean_shift"), relative.alias("relative_shift"), "std_ratio", (F.col("range_b") / F.greatest("range_a", F.lit(1e-8))).alias("range_ratio"), "kl", ((F.abs(relative) > 0.1) | (F.col("kl") > 0.5)).alias("significant"))


def distribution_of(prompts: DataFrame, scorer, text_column: str = "text", reward_column: str = "reward") -> DataFrame:
    """Distribution of the rewards that an injected scorer gives; a text's reward doesn't depend on its batch."""
    from .models import score

    return distribution(score(prompts, scorer, text_column, reward_column), reward_column)
