"""Training losses and metrics as column formulas over rewards and log-probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import log_sigmoid, share, softplus


def bradley_terry(chosen: Column, rejected: Column, margin: float = 0.0, smoothing: float = 0.0) -> Column:
    x = chosen - rejected - margin
    return (1 - smoothing) * softplus(-x) + smoothing * softplus(x) if smoothing else softplus(-x)


def margin_loss(chosen: Column, rejected: Column, margin: float) -> Column:
    return F.greatest(margin - (chosen - rejected), F.lit(0.0))


def hinge(chosen: Column, rejected: Column, margin: float = 1.0) -> Column:
    return margin_loss(chosen, rejected, margin if margin > 0 else 1.0)


def reward_loss(kind: str, chosen: Column, rejected: Column, margin: float = 0.0) -> Column:
    """Loss by name; an unknown name is Bradley-Terry."""
    return {"margin": margin_loss, "hinge": hinge}.get(kind, bradley_terry)(chosen, rejected, margin)


def preference_metrics(df: DataFrame, chosen: str, rejected: str) -> DataFrame:
    """Accuracy (strictly greater), means, sample deviations and mean margin."""
    return df.agg(share(F.col(chosen) > F.col(rejected)).alias("accuracy"), F.avg(chosen).alias("chosen_mean"), F.stddev_samp(chosen).alias("chosen_std"), F.avg(rejected).alias("rejected_mean"), F.stddev_samp(rejected).alias("rejected_std"), F.avg(F.col(chosen) - F.col(rejected)).alias("margin"))


def mean_of_batches(df: DataFrame, batch: str, value: Column) -> DataFrame:
    """Mean of the batches' means; a short batch weighs as much as any."""
    return df.groupBy(batch).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("value"))


def dpo_logits(pc: Column, pr: Column, rc: Column, rr: Column) -> Column:
    return (pc - rc) - (pr - rr)


def dpo_sigmoid(logits: Column, beta: float = 0.1, smoothing: float = 0.0) -> Column:
    x = logits * beta
    return -log_sigmoid(x) * (1 - smoothing) - log_sigmoid(-x) * smoothing


def dpo_hinge(logits: Column, beta: float = 0.1) -> Column:
    return F.greatest(1 - logits * beta, F.lit(0.0))


def dpo_ipo(logits: Column, beta: float = 0.1) -> Column:
    return F.pow(logits - 1 / (2 * beta), F.lit(2.0))


def whitened(df: DataFrame, column: str, out: str, epsilon: float = 1e-8) -> DataFrame:
    """Whitened over all rows by a one-row aggregate, so rows stay where they are."""
    m = df.agg(F.avg(column).alias("__m"), F.stddev_samp(column).alias("__s"))
    return df.join(F.broadcast(m)).withColumn(out, (F.col(column) - F.col("__m")) / (F.col("__s") + epsilon)).drop("__m", "__s")


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def ppo_policy(logp: Column, old: Column, advantage: Column, epsilon: float = 0.2) -> tuple[Column, Column]:
    """Clipped policy loss and whether the ratio was clipped."""
    r = F.exp(logp - old)
    return F.greatest(-advantage * r, -advantage * clip(r, 1 - epsilon, 1 + epsilon)), (F.abs(r - 1) > epsilon).cast("double")


def ppo_value(value: Column, old: Column, returns: Column, epsilon: float = 0.2) -> Column:
    clipped = old + clip(value - old, -epsilon, epsilon)
    return 0.5 * F.greatest(F.pow(value - returns, F.lit(2.0)), F.pow(clipped - returns, F.lit(2.0)))


def kl(logp: Column, ref: Column, kind: str = "kl") -> Column:
    d = logp - ref
    return {"abs": F.abs(d), "mse": 0.5 * F.pow(d, F.lit(2.0))}.get(kind, d)


def adaptive_coefficient(kls: Column, start: float, target: float) -> Column:
    """Coefficient after a series of divergences: x 1.5 above 1.5 times the target, / 1.5 below it, within [0.001, 10]."""
    return F.aggregate(kls, F.lit(start), lambda c, k: clip(F.when(k > target * 1.5, c * 1.5).when(k < target / 1.5, c / 1.5).otherwise(c), 1e-3, 10.0))


def gae(rewards: Column, values: Column, gamma: float = 0.99, lam: float = 0.95) -> Column:
    """Generalised advantages of one trajectory (arrays of equal length), the value after the end being 0."""
    n = F.size(rewards)
    ahead = F.concat(F.slice(values, 2, F.greatest(n - 1, F.lit(0))), F.array(F.lit(0.0)))
    delta = F.reverse(F.zip_with(F.zip_with(rewards, ahead, lambda r, v: r + gamma * v), values, lambda x, v: x - v))
    start = F.struct(F.lit(0.0).alias("a"), F.array().cast("array<double>").alias("out"))
    step = lambda s, d: F.struct((d + gamma * lam * s["a"]).alias("a"), F.concat(F.array(d + gamma * lam * s["a"]), s["out"]).alias("out"))
    return F.aggregate(delta, start, step, lambda s: s["out"])


def full_kl(p: Column, q: Column, epsilon: float = 1e-10) -> Column:
    """Divergence of two arrays of probabilities."""
    return F.aggregate(F.zip_with(p, q, lambda a, b: a * F.ln((a + epsilon) / (b + epsilon))), F.lit(0.0), lambda s, x: s + x)


def length_normalised(reward: Column, length: Column) -> Column:
    """Reward by tokens; a length of 0 counts as 1."""
    return reward / F.greatest(length, F.lit(1))


def advantages(df: DataFrame, reward: str, value: str) -> DataFrame:
    """Add ``returns``, which are the rewards, and ``advantage``, reward less value, whitened over all rows."""
    return whitened(df.withColumn("returns", F.col(reward)).withColumn("__raw", F.col(reward) - F.col(value)), "__raw", "advantage").drop("__raw")


def last_value(values: Column, mask: Column) -> Column:
    """The value at the last token that the mask keeps; null if it keeps none."""
    return F.try_element_at(F.filter(F.zip_with(values, mask, lambda v, m: F.when(m == 1, v)), lambda v: v.isNotNull()), F.lit(-1))


def policy_evaluation(df: DataFrame, reward: str, response: str) -> DataFrame:
    """(mean_reward, std_reward, mean_length): sample deviation, characters."""
    return df.agg(F.avg(reward).alias("mean_reward"), F.stddev_samp(reward).alias("std_reward"), F.avg(F.length(response)).alias("mean_length"))


def dpo_evaluation(df: DataFrame, batch: str, pc: str, pr: str, rc: str, rr: str, beta: float = 0.1) -> DataFrame:
    """(loss, accuracy, chosen_reward, rejected_reward): means of the batches' means, a short batch weighing as much as any."""
    c, r = beta * (F.col(pc) - F.col(rc)), beta * (F.col(pr) - F.col(rr))
    loss = dpo_sigmoid(dpo_logits(F.col(pc), F.col(pr), F.col(rc), F.col(rr)), beta)
    by = df.groupBy(batch).agg(F.avg(loss).alias("loss"), share(c > r).alias("accuracy"), F.avg(c).alias("chosen_reward"), F.avg(r).alias("rejected_reward"))
    return by.agg(*(F.avg(x).alias(x) for x in ("loss", "accuracy", "chosen_reward", "rejected_reward")))
