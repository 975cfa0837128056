"""Metrics by model size: coherence, perplexity, tax, scaling laws, jumps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numeric import ratio, share


def coherence(text: Column) -> Column:
    """0.3 for 10 to 500 words, 0.3 for a full stop, 0.4 where more than half of the words (case-sensitive) differ."""
    ws = T.tokens(text)
    n = F.size(ws)
    return F.when(n.between(10, 500), 0.3).otherwise(0.0) + F.when(F.contains(text, F.lit(".")), 0.3).otherwise(0.0) + F.when(n > 0, F.when(F.size(F.array_distinct(ws)) / F.greatest(n, F.lit(1)) > 0.5, 0.4).otherwise(0.0)).otherwise(0.0)


def response_metrics(df: DataFrame, size: str = "size", response: str = "response") -> DataFrame:
    """(size, completion_rate, avg_length, coherence)."""
    return df.groupBy(size).agg(share(F.length(T.trimmed(F.col(response))) > 10).alias("completion_rate"), F.avg(T.word_count(F.col(response))).alias("avg_length"), F.avg(coherence(F.col(response))).alias("coherence"))


def perplexity(df: DataFrame, loss: str = "loss", tokens: str = "tokens", by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.exp(ratio(F.sum(F.col(loss) * F.col(tokens)), F.sum(tokens))).alias("perplexity"))


def alignment_tax(base: DataFrame, aligned: DataFrame) -> DataFrame:
    """(size, metric, tax): relative loss of long metrics (size, metric, value); the sign turns for perplexity, a base of 0 is left out."""
    x = base.select("size", "metric", F.col("value").alias("b")).join(aligned.select("size", "metric", F.col("value").alias("a")), ["size", "metric"]).where("b <> 0")
    return x.select("size", "metric", F.when(F.col("metric") == "perplexity", (F.col("a") - F.col("b")) / F.col("b")).otherwise((F.col("b") - F.col("a")) / F.col("b")).alias("tax"))


def log_linear(df: DataFrame) -> DataFrame:
    """(metric, slope, intercept) of value against log size, per metric."""
    return df.groupBy("metric").agg(F.regr_slope("value", F.ln("size")).alias("slope"), F.regr_intercept("value", F.ln("size")).alias("intercept"))


def power_law(sizes: list[float], values: list[float]) -> dict[str, float]:
    """a * x**b + c with b in [-3, 3]: a and c in closed form for each b, b by a grid that is refined around its best; log-linear where that isn't defined. A handful of numbers, on the driver."""
    x, y = np.asarray(sizes, float), np.asarray(values, float)
    scale = x / x.max() if len(x) and x.max() > 0 else x

    def fit(b: float) -> tuple[float, tuple[float, float, float] | None]:
        m = np.stack([scale**b, np.ones_like(x)], axis=1)
        if not np.isfinite(m).all() or np.linalg.matrix_rank(m) < 2:
            return np.inf, None
        coef, *_ = np.linalg.lstsq(m, y, rcond=None)
        return float(((m @ coef - y) ** 2).sum()), (float(coef[0] / x.max() ** b), float(b), float(coef[1]))

    grid = np.concatenate([np.linspace(-3, -0.01, 300), np.linspace(0.01, 3, 300)])
    best = min((fit(b) for b in grid), key=lambda r: r[0], default=(np.inf, None))
    for width in (0.01, 0.001, 0.0001, 0.00001):
        if best[1] is not None:
            around = best[1][1] + np.linspace(-width, width, 21)
            best = min([best, *(fit(b) for b in around if -3 <= b <= 3 and abs(b) >= 1e-3)], key=lambda r: r[0])
    if best[1] is None:
        slope, intercept = np.polyfit(np.log(x), y, 1)
        return {"slope": float(slope), "intercept": float(intercept)}
    return dict(zip("abc", best[1]))


def predict(law: dict[str, float], size: float) -> float:
    return law["a"] * size ** law["b"] + law["c"] if "a" in law else law["slope"] * float(np.log(size)) + law["intercept"]


def emergence(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(metric, size, previous_size, previous, value, improvement): jumps between consecutive sizes above the threshold."""
    w = Window.partitionBy("metric").orderBy("size")
    x = df.select("metric", "size", "value", F.lag("value").over(w).alias("previous"), F.lag("size").over(w).alias("previous_size")).where("previous is not null")
    up = F.when(F.col("previous") > 0, (F.col("value") - F.col("previous")) / F.col("previous")).otherwise(F.col("value"))
    return x.withColumn("improvement", up).where(F.col("improvement") > threshold)


def largest_jump(df: DataFrame) -> DataFrame:
    """(metric, size, jump, notable): the largest step of each metric; notable above twice the mean step."""
    w = Window.partitionBy("metric").orderBy("size")
    d = df.select("metric", "size", F.abs(F.col("value") - F.lag("value").over(w)).alias("step")).where("step is not null")
    return d.groupBy("metric").agg(F.max_by("size", F.struct("step", (-F.col("size")).alias("k"))).alias("size"), F.max("step").alias("jump"), F.avg("step").alias("m")).select("metric", "size", "jump", (F.col("jump") > 2 * F.col("m")).alias("notable"))


def metric_at(metrics: DataFrame, wanted: DataFrame) -> DataFrame:
    """(size, metric, value) for each wanted (size, metric); null where there is none."""
    return wanted.select("size", "metric").join(metrics.select("size", "metric", "value"), ["size", "metric"], "left")


def exponent_notes(laws: dict[str, dict[str, float]]) -> list[str]:
    """What the exponents of fitted power laws say, by metric; a handful of numbers, on the driver."""
    out = []
    for metric, law in laws.items():
        b = law.get("b")
        if b is not None and b > 0:
            out.append(f"{metric}: Shows positive scaling (exponent={b:.3f})")
        elif b is not None and b < -0.1:
            out.append(f"{metric}: Shows diminishing returns (exponent={b:.3f})")
    return out


def jump_notes(metrics: DataFrame) -> DataFrame:
    """(metric, note) of metrics of three sizes or more whose largest step is above twice the mean step."""
    enough = metrics.groupBy("metric").agg(F.count("*").alias("n")).where("n >= 3").select("metric")
    x = largest_jump(metrics).where("notable").join(enough, "metric", "left_semi")
    return x.select("metric", F.concat("metric", F.lit(": Potential emergence detected at size "), F.col("size").cast("string")).alias("note"))


def fit_laws(metrics: DataFrame, least_sizes: int = 3) -> dict[str, dict[str, float]]:
    """Power laws of the metrics with enough sizes; (size, metric, value) is a row a size of a model."""
    by: dict[str, list[tuple[float, float]]] = {}
    for r in metrics.where("size is not null and value is not null").select("metric", "size", "value").collect():
        by.setdefault(r[0], []).append((float(r[1]), float(r[2])))
    return {m: power_law(*map(list, zip(*sorted(v)))) for m, v in sorted(by.items()) if len(v) >= least_sizes}


def analyse(responses: DataFrame, losses: DataFrame | None = None) -> tuple[DataFrame, dict[str, dict[str, float]], list[str]]:
    """Long metrics (size, metric, value) of responses (size, response) and losses (size, loss, tokens), fitted laws, notes.

    A metric that can't be fitted gets a note instead of a law.
    """
    wide = response_metrics(responses)
    long = wide.unpivot("size", ["completion_rate", "avg_length", "coherence"], "metric", "value")
    if losses is not None:
        long = long.unionByName(perplexity(losses, by=["size"]).select("size", F.lit("perplexity").alias("metric"), F.col("perplexity").alias("value")))
    laws, notes = {}, []
    for r in long.select("metric").distinct().collect():
        try:
            laws |= fit_laws(long.where(F.col("metric") == r[0]))
        except (ValueError, np.linalg.LinAlgError) as e:
            notes.append(f"{r[0]}: no fit ({e})")
    notes += exponent_notes(laws) + [r.note for r in jump_notes(long).orderBy("metric").collect()]
    return long, laws, notes
