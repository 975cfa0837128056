"""Two models side by side: rewards, wins, lengths, paired tests, samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numeric import share
from .models import Generator, Scorer, generate, score
from .ordering import running_counts


def summary(df: DataFrame, value: str, by: str = "model") -> DataFrame:
    return df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def win_rates(df: DataFrame, a: str, b: str) -> DataFrame:
    x, y = F.col(a), F.col(b)
    return df.where(x.isNotNull() & y.isNotNull()).agg(F.count("*").alias("n"), share(x > y).alias("win_a"), share(y > x).alias("win_b"), share(x == y).alias("tie"))


def verdict(text: Column) -> Column:
    """A, B or tie from a judge's answer that names one of both only."""
    a, b = F.contains(F.upper(text), F.lit("A")), F.contains(F.upper(text), F.lit("B"))
    return F.when(a & ~b, "A").when(b & ~a, "B").otherwise("tie")


def char_lengths(df: DataFrame, response: str, by: str = "model") -> DataFrame:
    n = F.length(response)
    return df.groupBy(by).agg(F.avg(n).alias("mean"), F.stddev_pop(n).alias("std"), F.min(n).alias("min"), F.max(n).alias("max"))


def word_lengths(df: DataFrame, response: str, by: str = "model") -> DataFrame:
    n = T.word_count(F.col(response))
    return df.groupBy(by).agg(F.avg(n).alias("mean"), F.stddev_pop(n).alias("std"), F.min(n).alias("min"), F.max(n).alias("max"), share(F.length(T.trimmed(F.coalesce(response, F.lit("")))) == 0).alias("empty_rate"))


def paired_stats(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, mean_diff, t, cohens_d, effect): sufficient for a paired t-test."""
    d = F.col(a) - F.col(b)
    x = df.where(d.isNotNull()).agg(F.count("*").alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("s"), F.stddev_pop(d).alias("p"))
    e = F.try_divide("mean_diff", "p")
    size = F.abs(e)
    return x.select("n", "mean_diff", F.try_divide(F.col("mean_diff"), F.col("s") / F.sqrt("n")).alias("t"), e.alias("cohens_d"), F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large").alias("effect"))


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, w_plus, w_minus): signed-rank sums of non-zero differences, ties by mean rank.

    Ranks come from counts of distinct absolute differences, so equal ones never meet in one task.
    """
    d = F.col(a) - F.col(b)
    by = df.where(d.isNotNull() & (d != 0)).groupBy(F.abs(d).alias("m")).agg(F.count_if(d > 0).alias("up"), F.count_if(d < 0).alias("down"))
    c = running_counts(by.withColumn("c", F.col("up") + F.col("down")), [], "m")
    r = F.col("upto") - (F.col("c") - 1) / 2
    return c.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(r * F.col("up")), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(r * F.col("down")), F.lit(0.0)).alias("w_minus"))


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def t_p_value(t: float, n: int) -> float:
    """Two-sided p-value of a paired t statistic over ``n`` pairs."""
    v = n - 1
    if v <= 0 or math.isnan(t):
        return float("nan")
    x = v / (v + t * t)
    a, b = v / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (a * math.log(x) + b * math.log1p(-x) if 0 < x < 1 else 0.0)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    if x <= 0:
        return 0.0
    return front * _betacf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _betacf(b, a, 1 - x) / b


def wilcoxon_p_value(w_plus: float, w_minus: float, n: int) -> float:
    """Two-sided normal approximation."""
    if n == 0:
        return 1.0
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return math.erfc(abs(min(w_plus, w_minus) - n * (n + 1) / 4) / sd / math.sqrt(2))


def samples(df: DataFrame, a: str, b: str, key: str, n: int = 10) -> DataFrame:
    """(key, diff, winner, region): clear wins of either side and close calls, at most ``n``.

    The top takes one more than a third where ``n`` isn't divisible by 3. Places come from running counts over the
    differences, ties by key.
    """
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(key).alias("key"), (F.col(a) - F.col(b)).alias("diff"))
    top, bottom, mid = -(-n // 3), n // 3, n // 6
    order = F.struct("diff", "key")
    x = running_counts(d.withColumn("c", F.lit(1)).withColumn("v", order), [], "v").withColumn("half", F.floor(F.col("n") / 2))
    regions = (
        (F.col("upto") > F.col("n") - top, F.lit("A"), "top"), (F.col("upto") <= bottom, F.lit("B"), "bottom"),
        ((F.col("upto") > F.greatest(F.col("half") - mid, F.lit(0))) & (F.col("upto") <= F.col("half") + mid), F.when(F.abs("diff") < 0.1, "Tie").when(F.col("diff") > 0, "A").otherwise("B"), "middle"),
    )
    hits = F.filter(F.array(*(F.when(cond, F.struct(w.alias("winner"), F.lit(name).alias("region"))) for cond, w, name in regions)), lambda r: r.isNotNull())
    return x.select("key", "diff", F.explode(hits).alias("r")).select("key", "diff", "r.winner", "r.region")


def merged_metrics(*metrics: DataFrame, by: str = "model") -> DataFrame:
    """(model, metric, value): the metrics of all tables, a row a model each, as long rows by the model's own name."""
    out = None
    for k, df in enumerate(metrics):
        names = [c for c in df.columns if c != by]
        x = df.select(by, *(F.col(c).cast("double").alias(c) for c in names)).unpivot(by, names, "metric", "value")
        out = x if out is None else out.unionByName(x)
    return out


def generate_responses(prompts: DataFrame, generators: dict[str, Generator], scorer: Scorer | None = None, prompt: str = "prompt") -> DataFrame:
    """(prompt, model, response, reward) of several named models on the same prompts; without a scorer the reward is null."""
    out = None
    for name, g in generators.items():
        x = generate(prompts.select(prompt), g, prompt).withColumn("model", F.lit(name))
        x = score(x.withColumn("__text", F.concat_ws("\n", prompt, "response")), scorer, "__text", "reward").drop("__text") if scorer else x.withColumn("reward", F.lit(None).cast("double"))
        out = x if out is None else out.unionByName(x)
    return out.select(prompt, "model", "response", "reward")


def side_by_side(long: DataFrame, a: str, b: str, prompt: str = "prompt") -> DataFrame:
    """(prompt, response_a, response_b, reward_a, reward_b) of two models' rows; prompts that one of them lacks are left out."""
    one = lambda name, side: long.where(F.col("model") == name).select(prompt, F.col("response").alias(f"response_{side}"), F.col("reward").alias(f"reward_{side}"))
    return one(a, "a").join(one(b, "b"), prompt)
