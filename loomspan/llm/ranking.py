"""One ranking from pairwise comparisons: probit strengths by iteratively reweighted least squares.

The first of two items wins with a probability of Phi(s_first - s_second + place), ``place`` being the advantage of
standing first; a tie is half a win of each. Comparisons are summed to one row for each ordered pair, a table that stays
on the executors. Every round writes the weights and scores of its rows under the current strengths and solves the
ridge-regularised normal equations by conjugate gradients, in which the matrix, a weighted graph Laplacian, only ever
meets vectors: one pass over the rows and one aggregate a product, for all right-hand sides at once. A round is solved
to a hundredth, so every round leaves a hundredth of the error. Only vectors of one number an item (and a few more at a time for the errors) are on the driver.

Standard errors are the diagonal of the inverse on strengths less their mean, by probing: right-hand sides of signs from the rows of a Hadamard
matrix, whose columns go to the items in turn. Up to ``probes`` items the probes are orthogonal and the errors exact;
with more items those that share a column get independent signs, and the same formula is an unbiased estimate.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import running_counts
from ..scratch import materialize

# Coefficients of a Chebyshev fit of the complementary error function (fractional error below 1.2e-7).
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_cdf(x: np.ndarray) -> np.ndarray:
    """Phi(x)."""
    z = np.abs(x) / np.sqrt(2)
    t = 1 / (1 + 0.5 * z)
    tail = 0.5 * t * np.exp(-z * z + np.polynomial.polynomial.polyval(t, _ERFC))
    return np.where(x > 0, 1 - tail, tail)


def probit_terms(margin: np.ndarray, won: np.ndarray, lost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight and score of each row (Fisher scoring)."""
    margin = np.clip(margin, -6, 6)
    p = np.clip(normal_cdf(margin), 1e-9, 1 - 1e-9)
    dens = np.exp(-0.5 * margin**2) / np.sqrt(2 * np.pi)
    n = won + lost
    return n * dens**2 / (p * (1 - p)), (won - n * p) * dens / (p * (1 - p))


def _scatter(i: np.ndarray, j: np.ndarray, d: np.ndarray, size: int, sign: float = -1.0) -> np.ndarray:
    """Add each row of ``d`` to item i, with a sign to item j, and to the last place (standing first). A column a vector."""
    out = np.empty((size, d.shape[1]))
    for c in range(d.shape[1]):
        out[:, c] = np.bincount(i, d[:, c], size) + sign * np.bincount(j, d[:, c], size)
    out[-1] += d.sum(axis=0)
    return out


def _partial(v: np.ndarray):
    """A partial sum as rows (place, values), places without any left out."""
    at = np.nonzero(v.any(axis=1))[0]
    return pa.record_batch([pa.array(at), *(pa.array(v[at, c]) for c in range(v.shape[1]))], names=["at", *(f"v{c}" for c in range(v.shape[1]))])


class Edges:
    """The comparisons as a sparse matrix that stays on the executors."""

    def __init__(self, rows: DataFrame, size: int, task_rows: int = 500_000):
        """``task_rows`` comparisons make a task; the sums of a single task need no shuffle."""
        self.parts = -(-max(rows.count(), 1) // task_rows)
        self.rows, self.size, self.spark = rows.coalesce(self.parts), size, rows.sparkSession

    def _sum(self, source: DataFrame, f, width: int) -> np.ndarray:
        names = [f"v{c}" for c in range(width)]
        got = source.mapInArrow(f, "at long, " + ", ".join(f"{c} double" for c in names)).groupBy("at").agg(*(F.sum(c).alias(c) for c in names)).toPandas()  # a row an item
        out = np.zeros((self.size, width))
        out[got["at"].to_numpy(np.int64)] = got[names].to_numpy(np.float64)
        return out

    def weigh(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Write the weights at ``s``; the gradient there and the diagonal, both without the prior."""
        sent, size = self.spark.sparkContext.broadcast(s), self.size

        def run(batches):
            x = sent.value
            for b in batches:
                i, j = b.column("i").to_numpy(), b.column("j").to_numpy()
                w, u = probit_terms(x[i] - x[j] + x[-1], b.column("won").to_numpy(), b.column("lost").to_numpy())
                yield pa.record_batch([b.column("i"), b.column("j"), pa.array(w), pa.array(u)], names=["i", "j", "w", "u"])

        def both(batches):
            for b in batches:
                i, j, w, u = (b.column(c).to_numpy() for c in ("i", "j", "w", "u"))
                yield _partial(np.concatenate([_scatter(i, j, u[:, None], size), _scatter(i, j, w[:, None], size, 1.0)], axis=1))

        self.weighted = materialize(self.rows.mapInArrow(run, "i long, j long, w double, u double"), "weights").coalesce(self.parts)
        out = self._sum(self.weighted, both, 2)
        return out[:, 0], out[:, 1]

    def times(self, v: np.ndarray) -> np.ndarray:
        """The matrix times the columns of ``v``: one pass."""
        sent, size = self.spark.sparkContext.broadcast(v), self.size

        def run(batches):
            x = sent.value
            for b in batches:
                i, j, w = (b.column(c).to_numpy() for c in ("i", "j", "w"))
                yield _partial(_scatter(i, j, w[:, None] * (x[i] - x[j] + x[-1]), size))

        out = self._sum(self.weighted, run, v.shape[1])
        sent.unpersist()
        return out


def conjugate_gradients(times, b: np.ndarray, scale: np.ndarray, tolerance: float, most: int = 1000) -> np.ndarray:
    """Solve a positive definite system for all columns of ``b`` at once, preconditioned by its diagonal.

    Each column stops when its residual has fallen to ``tolerance``; one that doesn't in ``most`` products raises an error.
    """
    scale = scale[:, None]
    x, r = np.zeros_like(b), b.copy()
    z = r / scale
    p, rz = z.copy(), (r * z).sum(axis=0)
    goal = tolerance**2 * np.maximum(rz, 1e-300)
    for _ in range(most):
        live = np.nonzero(rz > goal)[0]
        if not len(live):
            return x
        q = times(p[:, live])
        a = rz[live] / (p[:, live] * q).sum(axis=0)
        x[:, live] += a * p[:, live]
        r[:, live] -= a * q
        z = r[:, live] / scale
        after = (r[:, live] * z).sum(axis=0)
        p[:, live] = z + after / rz[live] * p[:, live]
        rz[live] = after
    raise RuntimeError(f"conjugate gradients did not settle in {most} products")


def probe_signs(items: int, probes: int, lo: int, hi: int, seed: int = 11) -> np.ndarray:
    """Columns ``lo`` to ``hi`` of the probes: a row an item."""
    k, p = np.arange(items), np.arange(lo, hi)
    parity = np.array([bin(x).count("1") & 1 for x in range(probes)])
    signs = 1.0 - 2 * parity[(k % probes)[:, None] & p[None, :]]
    turn = np.stack([np.random.default_rng((seed, int(x))).integers(0, 2, items // probes + 1) for x in p], axis=1)
    turn[0] = 0
    return signs * (1.0 - 2 * turn[k // probes])


def standard_errors(times, diagonal: np.ndarray, items: int, probes: int, memory: int = 4_000_000) -> np.ndarray:
    """Errors of the strengths less their mean, see above; ``memory`` numbers are held at a time."""
    probes = 1 << max(0, min(probes - 1, items - 1)).bit_length()
    step = max(1, memory // (items + 1))
    centred = lambda x: np.concatenate([x[:-1] - x[:-1].mean(axis=0), np.zeros_like(x[-1:])])
    total = np.zeros(items)
    for lo in range(0, probes, step):
        signs = probe_signs(items, probes, lo, min(lo + step, probes))
        v = centred(np.concatenate([signs, np.zeros((1, signs.shape[1]))]))
        total += (signs * centred(conjugate_gradients(times, v, diagonal, 1e-4))[:-1]).sum(axis=1)
    return np.sqrt(np.maximum(total / probes, 0.0))


def rank(comparisons: DataFrame, ridge: float = 0.01, rounds: int = 50, tolerance: float = 1e-4, probes: int = 64) -> DataFrame:
    """(item, rank, strength, std_error, comparisons): all items of ``comparisons`` (first, second, outcome, n).

    ``outcome`` is 1, 0 or 0.5 for the first, the second or neither; ``n`` how often. Rows with nulls and comparisons
    of an item with itself are left out. Equal strengths rank by name. Strengths have a mean of 0; their standard
    errors are exact up to ``probes`` items (a power of two) and estimated with as many probes beyond. An empty input gives an empty result; strengths
    that don't settle in ``rounds`` raise an error.
    """
    spark = comparisons.sparkSession
    pairs = comparisons.where("first is not null and second is not null and first <> second and outcome is not null and n > 0").groupBy("first", "second").agg(
        F.sum(F.col("outcome") * F.col("n")).cast("double").alias("won"), F.sum((1 - F.col("outcome")) * F.col("n")).cast("double").alias("lost")
    )
    pairs = materialize(pairs, "pairs")
    met = pairs.select(F.col("first").alias("item"), (F.col("won") + F.col("lost")).alias("n")).union(pairs.select("second", F.col("won") + F.col("lost"))).groupBy("item").agg(F.sum("n").alias("comparisons"))
    index = materialize(running_counts(met.withColumn("one", F.lit(1)), [], "item", "one").select("item", (F.col("upto") - 1).cast("long").alias("k"), "comparisons"), "items")
    items = index.count()
    schema = "item string, rank long, strength double, std_error double, comparisons double"
    if not items:
        return spark.createDataFrame([], schema)
    a, b = index.select(F.col("item").alias("first"), F.col("k").alias("i")), index.select(F.col("item").alias("second"), F.col("k").alias("j"))
    edges = Edges(materialize(pairs.join(a, "first").join(b, "second").select("i", "j", "won", "lost"), "edges"), items + 1)
    s = np.zeros(items + 1)
    times = lambda v: edges.times(v) + ridge * v
    for _ in range(rounds):
        g, diagonal = edges.weigh(s)
        diagonal = diagonal + ridge
        step = conjugate_gradients(times, (g - ridge * s)[:, None], diagonal, 0.01)[:, 0]
        step[:-1] -= step[:-1].mean()  # comparisons say nothing of the mean, which the prior holds at 0
        s = s + np.clip(step, -2, 2)
        if np.abs(step).max() < tolerance:  # what is left is a hundredth of it at most
            break
    else:
        raise RuntimeError(f"the strengths did not settle in {rounds} rounds")
    error = standard_errors(times, diagonal, items, probes)
    strength = s[:-1] - s[:-1].mean()
    place = np.empty(items, np.int64)
    place[np.lexsort((np.arange(items), -strength))] = np.arange(1, items + 1)
    import pandas as pd

    table = spark.createDataFrame(pd.DataFrame({"k": np.arange(items), "rank": place, "strength": strength, "std_error": error}), "k long, rank long, strength double, std_error double")
    return index.join(table, "k").select("item", "rank", "strength", "std_error", "comparisons")


def stronger(ranking: DataFrame, confidence: float | None = None) -> DataFrame:
    """(model_a, model_b, stronger): every two items with the one that ranks higher, ``model_a < model_b``."""
    z = NormalDist().inv_cdf(confidence) if confidence else None
    n = ranking.count()
    a = ranking.where(F.col("rank") < n).select("item", "strength", "std_error", F.explode(F.sequence(F.col("rank") + 1, F.lit(n).cast("long"))).alias("rank"))
    b = ranking.select("rank", F.col("item").alias("weaker"), F.col("strength").alias("s"), F.col("std_error").alias("e"))
    both = a.join(b, "rank")
    if z is not None:
        both = both.where(F.col("strength") - F.col("s") > z * F.sqrt(F.col("std_error") ** 2 + F.col("e") ** 2))
    return both.select(F.least("item", "weaker").alias("model_a"), F.greatest("item", "weaker").alias("model_b"), F.col("item").alias("stronger"))


def task_models(tasks: DataFrame) -> DataFrame:
    """(task_id, first, second): the writers of both responses of each pairwise task, names trimmed and lower-cased."""
    names = F.from_json(F.col("metadata")["model_names"], "array<string>")
    swapped = F.lower(F.trim(F.coalesce(F.col("metadata")["shuffled"], F.lit("false")))) == "true"
    x = tasks.where("task_type = 'pairwise' and metadata is not null").select("task_id", F.transform(names, lambda n: F.lower(F.trim(n))).alias("names"), swapped.alias("swapped")).where(F.size("names") == 2)
    return x.select("task_id", F.when(F.col("swapped"), F.col("names")[1]).otherwise(F.col("names")[0]).alias("first"), F.when(F.col("swapped"), F.col("names")[0]).otherwise(F.col("names")[1]).alias("second"))


def vote_comparisons(votes: DataFrame, tasks: DataFrame) -> DataFrame:
    """(first, second, outcome, n): votes on pairwise tasks summed by models and outcome."""
    outcome = F.when(F.col("label") == 0, 1.0).when(F.col("label") == 1, 0.0).otherwise(0.5)
    by_task = votes.groupBy("task_id", outcome.alias("outcome")).agg(F.count("*").alias("n"))
    return by_task.join(task_models(tasks), "task_id").groupBy("first", "second", "outcome").agg(F.sum("n").alias("n"))


def consensus_comparisons(labels: DataFrame, tasks: DataFrame) -> DataFrame:
    """(first, second, outcome, n): one comparison a task, shared out by the posterior of its label (p0, p1, p2)."""
    x = labels.join(task_models(tasks), "task_id").groupBy("first", "second").agg(*(F.sum(f"p{k}").alias(f"p{k}") for k in range(3)))
    return x.select("first", "second", F.explode(F.array(*(F.struct(F.lit(o).alias("outcome"), F.col(f"p{k}").alias("n")) for k, o in enumerate((1.0, 0.0, 0.5))))).alias("x")).select("first", "second", "x.outcome", "x.n")
