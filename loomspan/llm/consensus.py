"""Consensus of several annotators: ability and difficulty by gradient expectation-maximisation.

Annotator *i* votes *k* on task *j* of true label *z* with a probability in proportion to
exp(ability_i * clarity_j * [k = z] + bias_ik): an annotator of negative ability tends to the wrong label, one with a
bias to a label whatever the task, and a task of little clarity (great difficulty) makes all guess. Votes of a task lie
in one row (no more than there are annotators, as each counts once). A pass over these rows finds, for the current
annotators, the posterior and the clarity of each task by gradient steps of its own, and sums the annotators' gradients
and information before the shuffle. Every annotator then takes one Newton step in ability and biases together (4 x 4
information, so that the two don't chase each other), written with all others to one table, the only state between
passes. The penalised likelihood is summed in the same pass: a step that lowers it is halved and tried again, so the
fit rises until the largest step is below ``tolerance``; a fit that doesn't get there raises an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .votes import LABELS

ABILITY, SPREAD, CLARITY_SPREAD, BIAS_SPREAD = 1.5, 1.0, 0.35, 1.0  # priors
_INNER = 4
LONG = 1.5  # times a step: expected information overstates what votes tell, so steps are short
_SIZE = LABELS + 1  # parameters of an annotator: ability and a bias for each label
_UPPER = [(i, j) for i in range(_SIZE) for j in range(i, _SIZE)]
_GRAD, _INFO = [f"g{i}" for i in range(_SIZE)], [f"h{i}{j}" for i, j in _UPPER]
_AT, _STEP = [f"t{i}" for i in range(_SIZE)], [f"s{i}" for i in range(_SIZE)]
_TOTALS = ["ll", *(f"q{k}" for k in range(LABELS))]
_SUMS = ["votes", "right", *_GRAD, *_INFO, *_TOTALS]


def solve_tasks(n: np.ndarray, label: np.ndarray, at: np.ndarray, prior: np.ndarray, sums: bool = True) -> tuple[np.ndarray, np.ndarray, dict]:
    """Posterior (a row a label) and clarity (log) of each task, and the terms of each vote with the likelihood of each task.

    ``n``: votes of each task, at least one; ``at``: ability and biases of each vote's annotator, a column a vote.
    """
    starts = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(n)), n)
    ability, bias = at[0], at[1:]
    d = np.zeros(len(n))
    e = np.exp(bias)
    rest = e.sum(axis=0) - e
    mine = bias[label, np.arange(len(label))]
    hot = label[None, :] == np.arange(LABELS)[:, None]
    start = np.log(prior)[:, None]
    for step in range(_INNER + 1):
        clarity = np.exp(d[owner])
        a = ability * clarity
        up = e * np.exp(a)  # weight of label z when z is the truth
        norm = rest + up
        logs = start + np.add.reduceat(mine + a * hot - np.log(norm), starts, axis=1)
        top = logs.max(axis=0)
        post = np.exp(logs - top)
        total = post.sum(axis=0)
        post /= total
        q, p = post[:, owner], up / norm
        g = (q * (hot - p)).sum(axis=0)
        h = (q * p * (1 - p)).sum(axis=0)
        if step < _INNER:
            slope = np.add.reduceat(g * a, starts) - d / CLARITY_SPREAD**2
            curve = np.add.reduceat(h * a * a, starts) + 1 / CLARITY_SPREAD**2
            d = np.clip(d + slope / curve, -1.5, 1.5)
    if not sums:
        return post, d, {}
    vote = {"right": (q * hot).sum(axis=0), "votes": np.ones(len(label)), "g0": g * clarity, "h00": h * clarity**2}
    each = [[p[z] if k == z else e[k] / norm[z] for k in range(LABELS)] for z in range(LABELS)]  # of a vote k when z is the truth
    for k in range(LABELS):
        vote[f"g{k + 1}"] = hot[k] - sum(q[z] * each[z][k] for z in range(LABELS))
        vote[f"h0{k + 1}"] = clarity * sum(q[z] * p[z] * ((k == z) - each[z][k]) for z in range(LABELS))
        for j in range(k, LABELS):
            vote[f"h{k + 1}{j + 1}"] = sum(q[z] * each[z][k] * ((k == j) - each[z][j]) for z in range(LABELS))
    vote["ll"] = top + np.log(total) - d * d / (2 * CLARITY_SPREAD**2)
    return post, d, vote


def newton(sums: dict, at: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Step of each annotator, and its penalty at the place where the sums were taken."""
    g = np.stack([sums[k] for k in _GRAD])
    h = np.empty((at.shape[1], _SIZE, _SIZE))
    for (i, j), k in zip(_UPPER, _INFO):
        h[:, i, j] = h[:, j, i] = sums[k]
    off = at - np.concatenate(([ABILITY], common))[:, None]
    weight = np.array([1 / SPREAD**2] + [1 / BIAS_SPREAD**2] * LABELS)
    g = g - off * weight[:, None]
    h = h + np.diag(weight)
    step = np.linalg.solve(h, g.T[:, :, None])[:, :, 0].T if at.shape[1] else np.zeros_like(at)
    return np.clip(step, -1, 1), 0.5 * (off**2 * weight[:, None]).sum(axis=0)


class _People:
    """Parameters of annotators by key, for the tasks they are sent to."""

    def __init__(self, rows):
        order = np.argsort(rows["key"].to_numpy(np.int64))
        self.key = rows["key"].to_numpy(np.int64)[order]
        self.at = np.stack([rows[c].to_numpy(np.float64)[order] for c in _AT])

    def of(self, key: np.ndarray) -> np.ndarray:
        return self.at[:, np.searchsorted(self.key, key)]


def _flat(batch, people: _People | None):
    keys, labels = batch.column("keys"), batch.column("labels")
    n = np.diff(keys.offsets.to_numpy())
    key, label = keys.flatten().to_numpy(), labels.flatten().to_numpy().astype(np.int64)
    at = people.of(key) if people is not None else np.stack([batch.column(c).flatten().to_numpy() for c in _AT])  # or the rows bring them
    return n, key, label, at


def _gradients(batches, people: _People | None, prior: np.ndarray):
    for batch in batches:
        if not batch.num_rows:
            continue
        n, key, label, at = _flat(batch, people)
        post, _, vote = solve_tasks(n, label, at, prior)
        who, place = np.unique(key, return_inverse=True)
        one = {k: np.bincount(place, vote[k], len(who)) for k in _SUMS if k not in _TOTALS}
        total = dict(zip(_TOTALS, (vote["ll"].sum(), *post.sum(axis=1))))
        cols = [pa.array([*one[k], None] if k in one else [*([None] * len(who)), total[k]], pa.float64()) for k in _SUMS]
        yield pa.record_batch([pa.array([*who.tolist(), None], pa.int64()), *cols], names=["key", *_SUMS])


def _steps(batches, common: np.ndarray):
    for b in batches:
        people = b.filter(pc.is_valid(b.column("key")))
        x = {k: people.column(k).to_numpy(zero_copy_only=False) for k in (*_SUMS, *_AT)}
        step, penalty = newton(x, np.stack([x[c] for c in _AT]), common)
        keep = [people.column(c) for c in ("votes", "right", *_TOTALS)]
        yield pa.record_batch([people.column("key"), *(people.column(c) for c in _AT), *(pa.array(s) for s in step), pa.array(penalty), *keep], names=_STATE_NAMES)
        total = b.filter(pc.is_null(b.column("key")))
        none = pa.nulls(total.num_rows, pa.float64())
        yield pa.record_batch([total.column(c) if c in ("key", *_TOTALS) else none for c in _STATE_NAMES], names=_STATE_NAMES)


_STATE_NAMES = ["key", *_AT, *_STEP, "penalty", "votes", "right", *_TOTALS]
_STATE = "key long, " + ", ".join(f"{c} double" for c in _STATE_NAMES[1:])


def _posteriors(batches, people: _People | None, prior: np.ndarray):
    for batch in batches:
        if not batch.num_rows:
            continue
        n, _, label, at = _flat(batch, people)
        post, d, _ = solve_tasks(n, label, at, prior, sums=False)
        yield pa.record_batch([batch.column("task_id"), pa.array(n.astype(np.int64)), pa.array(np.exp(-d)), *(pa.array(p) for p in post)], names=["task_id", "votes", "difficulty", "p0", "p1", "p2"])


class Consensus:
    """Fitted consensus of ``votes`` (task_id, annotator, label), one row for each annotator and task.

    Up to ``broadcast_annotators`` annotators (40 bytes each) are sent to the tasks; more are joined to the votes, with
    the same result. ``rounds_used``, ``last_change`` (largest step) and ``objective`` (penalised log-likelihood) tell how the fit ended; one
    that hasn't settled after ``rounds`` raises an error. An empty input gives empty results. Null labels or ids must have
    been left out before, see ``valid_votes``.
    """

    def __init__(self, votes: DataFrame, rounds: int = 200, tolerance: float = 0.02, broadcast_annotators: int = 500_000):
        self.votes = materialize(votes.select("task_id", "annotator", F.xxhash64("annotator").alias("key"), F.col("label").cast("int").alias("label")), "votes")
        packed = self.votes.groupBy("task_id").agg(F.collect_list(F.struct("key", "label")).alias("v")).select("task_id", F.col("v.key").alias("keys"), F.col("v.label").alias("labels"))
        self.tasks = materialize(packed, "tasks")
        names = self.votes.groupBy("key").agg(F.count("*").cast("double").alias("votes"))
        zero = {c: F.lit(0.0) for c in _STATE_NAMES[1:]} | {"t0": F.lit(ABILITY), "votes": F.col("votes")}
        self.state = materialize(names.select("key", *(x.alias(c) for c, x in zero.items())), "annotators")
        self.small = self.state.count() <= broadcast_annotators
        self.prior, self.objective, self.last_change, self.rounds_used = np.full(LABELS, 1 / LABELS), -np.inf, np.inf, 0
        self.people = self._people(self.state)
        self._fit(rounds, tolerance)

    def _fit(self, rounds: int, tolerance: float) -> None:
        place, prior, common, scale, base = self.state.select("key", *_AT), self.prior, np.zeros(LABELS), 1.0, None
        for self.rounds_used in range(1, rounds + 1):
            people = self._people(place)
            sums = self._rows(people, place).mapInArrow(lambda it, people=people, prior=prior: _gradients(it, people, prior), "key long, " + ", ".join(f"{c} double" for c in _SUMS))
            sums = sums.groupBy("key").agg(*(F.sum(c).alias(c) for c in _SUMS))
            state = materialize(sums.join(place, "key", "left").mapInArrow(lambda it, common=common: _steps(it, common), _STATE), "annotators")
            r = state.agg(F.max("ll"), *(F.max(c) for c in _TOTALS[1:]), F.sum("penalty"), F.max(F.greatest(*(F.abs(c) for c in _STEP))), *(F.avg(F.col(t) + F.col(s)) for t, s in zip(_AT[1:], _STEP[1:]))).first()
            if r[0] is None:  # no votes
                self.objective, self.last_change = 0.0, 0.0
                return
            posterior, penalty, change, middle = np.array(r[1 : 1 + LABELS]), *r[1 + LABELS : 3 + LABELS], np.array(r[3 + LABELS :])
            objective = r[0] - penalty
            if objective < self.objective - 1e-9 * abs(self.objective) and scale > 1e-3:  # too far: half the way
                scale /= 2
            else:
                self.state, self.people, self.prior, self.objective, self.last_change = state.where("key is not null"), people, prior, objective, change
                if change < tolerance:
                    return
                base, aim = (prior, common), (posterior / posterior.sum(), middle)
                scale = LONG if self.rounds_used > 3 else 1.0
            part = min(scale, 1.0)
            prior, common = base[0] + part * (aim[0] - base[0]), base[1] + part * (aim[1] - base[1])
            place = self.state.select("key", *((F.col(t) + scale * F.col(s)).alias(t) for t, s in zip(_AT, _STEP)))
        raise RuntimeError(f"the consensus did not settle in {rounds} rounds: last step {self.last_change}, tolerance {tolerance}")

    def _people(self, place: DataFrame) -> _People | None:
        return _People(place.select("key", *_AT).toPandas()) if self.small else None  # at most broadcast_annotators rows

    def _rows(self, people: _People | None, place: DataFrame) -> DataFrame:
        if people is not None:
            return self.tasks
        v = self.votes.join(place, "key").groupBy("task_id").agg(F.collect_list(F.struct("key", "label", *_AT)).alias("v"))
        return v.select("task_id", *(F.col(f"v.{c}").alias(d) for c, d in (("key", "keys"), ("label", "labels"), *((c, c) for c in _AT))))

    def labels(self, least_votes: int = 1) -> DataFrame:
        """(task_id, votes, label, confidence, difficulty, p0, p1, p2) of the tasks with enough votes; of equal posteriors the smallest label."""
        people, prior = self.people, self.prior
        out = self._rows(people, self.state.select("key", *_AT)).where(F.size("keys") >= least_votes).mapInArrow(lambda it: _posteriors(it, people, prior), "task_id string, votes long, difficulty double, p0 double, p1 double, p2 double")
        best = F.greatest("p0", "p1", "p2")
        return out.select("task_id", "votes", F.when(F.col("p0") >= best, 0).when(F.col("p1") >= best, 1).otherwise(2).cast("int").alias("label"), best.alias("confidence"), "difficulty", "p0", "p1", "p2")

    def annotators(self) -> DataFrame:
        """(annotator, votes, ability, bias_0, bias_1, bias_2, reliability); reliability is the expected share of votes that match the true label, biases have a mean of 0."""
        names = self.votes.groupBy("key", "annotator").agg(F.count("*").alias("votes"))
        mean = sum(F.col(c) for c in _AT[1:]) / LABELS
        x = self.state.select("key", F.col("t0").alias("ability"), *((F.col(c) - mean).alias(f"bias_{k}") for k, c in enumerate(_AT[1:])), (F.col("right") / F.col("votes")).alias("reliability"))
        return names.join(x, "key").select("annotator", "votes", "ability", "bias_0", "bias_1", "bias_2", "reliability")


def agreement(votes: DataFrame) -> DataFrame:
    """(tasks, votes, observed, expected, kappa): chance-corrected agreement over tasks with two votes or more.

    Observed is the share of agreeing pairs of votes, tasks weighted by their votes; expected that of pairs drawn from
    all votes. Without such a task the shares are null.
    """
    n = votes.groupBy("task_id").agg(F.count("*").alias("n"), *(F.count_if(F.col("label") == k).alias(f"c{k}") for k in range(LABELS))).where("n >= 2")
    same = sum(F.col(f"c{k}") * (F.col(f"c{k}") - 1) for k in range(LABELS)) / (F.col("n") - 1)
    one = n.agg(F.count("*").alias("tasks"), F.sum("n").alias("votes"), F.sum(same).alias("s"), *(F.sum(f"c{k}").alias(f"t{k}") for k in range(LABELS)))
    v = F.col("votes")
    observed, expected = F.col("s") / v, sum(F.col(f"t{k}") * (F.col(f"t{k}") - 1) for k in range(LABELS)) / (v * (v - 1))
    return one.select("tasks", F.coalesce("votes", F.lit(0)).alias("votes"), observed.alias("observed"), expected.alias("expected"), F.try_divide(observed - expected, 1 - expected).alias("kappa"))
