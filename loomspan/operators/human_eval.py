"""Human evaluation: agreement, majority, win rates, intervals, dimensions, quality of annotation."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio, share


def pairwise_tasks(pairs: DataFrame, names: tuple[str, str], seed: int = 0) -> DataFrame:
    """Tasks from (id, prompt, response_a, response_b) with sides swapped by a hash, the swap being recorded."""
    swap = F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(f"side{seed}"))), 1, 1) >= "8"
    r = F.when(swap, F.array("response_b", "response_a")).otherwise(F.array("response_a", "response_b"))
    return pairs.select(F.substring(F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))), 256), 1, 8).alias("task_id"), F.lit("pairwise").alias("task_type"), "prompt", r.alias("responses"), F.create_map(F.lit("model_names"), F.to_json(F.array(*(F.lit(n) for n in names))), F.lit("shuffled"), swap.cast("string")).alias("metadata"))


def majority(annotations: DataFrame, task: str = "task_id", label: str = "preference") -> DataFrame:
    """(task_id, preference, votes, total): the most frequent label, of equals the smallest. Votes are counted before tasks meet."""
    by = annotations.where(F.col(label).isNotNull()).groupBy(task, label).agg(F.count("*").alias("votes"))
    best = by.groupBy(task).agg(F.max(F.struct(F.col("votes"), (-F.col(label)).alias("k"))).alias("b"), F.sum("votes").alias("total"), F.count("*").alias("distinct"))
    return best.select(task, (-F.col("b.k")).alias(label), F.col("b.votes").alias("votes"), "total", "distinct")


def unanimous(annotations: DataFrame) -> DataFrame:
    return majority(annotations).where("distinct = 1").select("task_id", "preference")


def agreement(annotations: DataFrame) -> DataFrame:
    """(agreement_rate, tasks): mean share of the majority over tasks with two preferences or more."""
    return majority(annotations).where("total >= 2").agg(F.avg(F.col("votes") / F.col("total")).alias("agreement_rate"), F.count("*").alias("tasks"))


def fleiss_kappa(annotations: DataFrame) -> DataFrame:
    """(kappa): simplified, with the greatest number of raters for all tasks and the labels 0 and 1 only."""
    by = annotations.where("preference is not null").groupBy("task_id").agg(F.count("*").alias("n"), F.count_if(F.col("preference") == 0).alias("c0"), F.count_if(F.col("preference") == 1).alias("c1"))
    one = by.agg(F.max("n").alias("n"), F.count("*").alias("tasks"), F.sum(F.col("c0") * F.col("c0") + F.col("c1") * F.col("c1")).alias("sq"), F.sum("c0").alias("s0"), F.sum("c1").alias("s1"))
    n, total = F.col("n"), F.col("s0") + F.col("s1")
    p_bar = (F.col("sq") / F.col("tasks") - n) / (n * (n - 1))
    p_e = ratio(F.col("s0") * F.col("s0") + F.col("s1") * F.col("s1"), total * total)
    return one.select(F.when(n.isNull() | (n < 2) | (total == 0), 0.0).when(p_e == 1, 1.0).otherwise(F.try_divide(p_bar - p_e, 1 - p_e)).alias("kappa"))


def win_rates(labels: DataFrame, label: str = "preference") -> DataFrame:
    return labels.agg(F.count("*").alias("n"), share(F.col(label) == 0).alias("a"), share(F.col(label) == 1).alias("b"), share(F.col(label) == 2).alias("tie"))


def wilson(wins: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Interval of a share, within [0, 1]; [0, 0] without rows."""
    z = NormalDist().inv_cdf(1 - (1 - confidence) / 2)
    p = F.try_divide(wins.cast("double"), n.cast("double"))
    d = 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n) / d
    empty = n == 0
    return F.when(empty, 0.0).otherwise(F.greatest(mid - half, F.lit(0.0))), F.when(empty, 0.0).otherwise(F.least(mid + half, F.lit(1.0)))


def win_intervals(labels: DataFrame, confidence: float = 0.95) -> DataFrame:
    one = labels.agg(F.count("*").alias("n"), F.count_if(F.col("preference") == 0).alias("a"), F.count_if(F.col("preference") == 1).alias("b"))
    a, b = wilson(F.col("a"), F.col("n"), confidence), wilson(F.col("b"), F.col("n"), confidence)
    return one.select("n", a[0].alias("a_lo"), a[1].alias("a_hi"), b[0].alias("b_lo"), b[1].alias("b_hi"))


def dimensions(annotations: DataFrame) -> DataFrame:
    return annotations.select(F.explode("ratings").alias("dimension", "rating")).groupBy("dimension").agg(F.count("rating").alias("n"), F.avg("rating").alias("mean"), F.stddev_pop("rating").alias("std"), F.min("rating").alias("min"), F.max("rating").alias("max"))


def annotation_quality(annotations: DataFrame) -> DataFrame:
    """Time spent (where positive), too fast (< 5 s), too slow (> 300 s) and comments (of all)."""
    t = F.when(F.col("time_spent") > 0, F.col("time_spent"))
    return annotations.agg(F.count("*").alias("n"), F.avg(t).alias("mean_time"), F.stddev_pop(t).alias("std_time"), ratio(F.count_if(t < 5), F.count(t)).alias("fast_rate"), ratio(F.count_if(t > 300), F.count(t)).alias("slow_rate"), share(F.length(F.coalesce("comments", F.lit(""))) > 0).alias("comment_rate"))


def filter_low_quality(annotations: DataFrame, min_time: float = 5.0, deviation: float = 0.5) -> DataFrame:
    """Drops hasty rows, and dissenters where the majority's share of all rows of a task is above 1 - ``deviation``."""
    kept = annotations.where(~F.coalesce((F.col("time_spent") > 0) & (F.col("time_spent") < min_time), F.lit(False)))
    rows = kept.groupBy("task_id").agg(F.count("*").alias("__rows"))
    m = majority(kept).select("task_id", F.col("preference").alias("__major"), F.col("votes").alias("__votes")).join(rows, "task_id")
    x = kept.join(m, "task_id", "left")
    strong = F.col("__votes") / F.col("__rows") > 1 - deviation
    return x.where(~F.coalesce(strong & F.col("preference").isNotNull() & (F.col("preference") != F.col("__major")), F.lit(False))).drop("__major", "__votes", "__rows")


def summary(annotations: DataFrame, confidence: float = 0.95) -> DataFrame:
    """One row: tasks, annotations and annotators, agreement, win rates with their intervals, quality of annotation. ``dimensions`` has a row a dimension.

    Shares and means of nothing are null; the intervals of nothing are 0.
    """
    labels = majority(annotations)
    totals = annotations.agg(F.count_distinct("task_id").alias("total_tasks"), F.count("*").alias("total_annotations"), F.count_distinct("annotator_id").alias("num_annotators"))
    parts = [agreement(annotations).select("agreement_rate"), win_rates(labels).select("a", "b", "tie"), win_intervals(labels, confidence).drop("n"), annotation_quality(annotations).drop("n")]
    out = totals
    for x in parts:  # one row each
        out = out.join(F.broadcast(x))
    return out


# Fields of a record and what a missing one is.
TASK_SCHEMA = "task_id string, task_type string, prompt string, responses array<string>, dimensions array<string>, metadata map<string,string>"
ANNOTATION_SCHEMA = "task_id string, annotator_id string, preference int, ratings map<string,int>, ranking array<int>, comments string, time_spent double, annotated_at string"
TASK_TYPES = ("pairwise", "likert", "ranking")


def to_records(df: DataFrame, schema: str) -> DataFrame:
    """(record): each row as JSON, in the order of the fields."""
    names = [f.strip().split(" ")[0] for f in _fields(schema)]
    return df.select(F.to_json(F.struct(*(c for c in names if c in df.columns)), {"ignoreNullFields": "false"}).alias("record"))


def from_records(df: DataFrame, schema: str, column: str = "record") -> DataFrame:
    """Rows of JSON records. Missing texts are empty, missing lists and maps have no entries, a missing time is 0; an unreadable record has no id and is left out."""
    x = df.select(F.from_json(column, schema).alias("r")).where("r is not null and r.task_id is not null").select("r.*")
    empty = {"string": F.lit(""), "double": F.lit(0.0)}
    out = []
    for name, kind in x.dtypes:
        default = empty.get(kind) if name in ("prompt", "comments", "time_spent", "task_type") else F.expr(f"cast(array() as {kind})") if kind.startswith("array") else F.expr(f"cast(map() as {kind})") if kind.startswith("map") else None
        out.append(F.col(name) if default is None else F.coalesce(name, default).alias(name))
    return x.select(*out)


def checked_type(task_type: Column) -> Column:
    """The type as it is named; one that isn't known raises."""
    low = F.lower(F.trim(task_type))
    return F.when(low.isin(*TASK_TYPES), low).otherwise(F.raise_error(F.concat(F.lit("unknown type "), low)).cast("string"))


def _fields(schema: str) -> list[str]:
    """Top-level fields of a schema text."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out
