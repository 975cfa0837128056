"""Screening by category scores that a model has written as columns or a map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Categories in the order they are looked at.
CATEGORIES = ["toxicity", "severe_toxicity", "obscene", "threat", "insult", "identity_attack", "sexual_explicit"]


def reason(text: Column, scores: Column, threshold: float = 0.7, categories: list[str] | None = None) -> Column:
    """The first category above the threshold; blank texts are invalid, missing scores are passed over."""
    out = F.when(text.isNull() | (F.length(T.trimmed(text)) == 0), "invalid_type")
    for c in categories or CATEGORIES:
        out = out.when(scores[c] > threshold, f"toxic_{c}")
    return out


def evaluate(flagged: DataFrame, flag: str, truth: str) -> DataFrame:
    """(tp, fp, fn, tn, precision, recall)."""
    f, y = F.col(flag), F.col(truth) == 1
    x = flagged.agg(F.count_if(f & y).alias("tp"), F.count_if(f & ~y).alias("fp"), F.count_if(~f & y).alias("fn"), F.count_if(~f & ~y).alias("tn"))
    return x.select("*", F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")).alias("precision"), F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")).alias("recall"))


def score_map(df: DataFrame, columns: list[str] | None = None, out: str = "scores") -> DataFrame:
    """Columns of scores as one map a row, those that are null left out."""
    names = [c for c in (columns or CATEGORIES) if c in df.columns]
    pairs = F.filter(F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v"))) for c in names)), lambda x: x.isNotNull())
    return df.withColumn(out, F.map_from_entries(pairs)).drop(*names)


def remove_toxic(df: DataFrame, threshold: float = 0.7, text_column: str = "text", scores_column: str = "scores") -> tuple[DataFrame, DataFrame]:
    """Kept rows, and (total, passed, removed, reason, n)."""
    from .quality import filter_stats

    x = df.withColumn("__reason", reason(F.col(text_column), F.col(scores_column), threshold))
    return x.where("__reason is null").drop("__reason"), filter_stats(x, "__reason")
