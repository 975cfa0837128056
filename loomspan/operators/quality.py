"""Quality filter: the first failing rule names the reason; rows without a reason are kept."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class QualityRules:
    min_length: int = 50
    max_length: int = 100_000
    min_words: int = 10
    punctuation: bool = True
    max_repetition: float | None = 0.3
    ngram: int = 3
    max_perplexity: float | None = None

    def reason(self, text: Column, ws: Column, perplexity: Column | None = None) -> Column:
        out = (
            F.when(text.isNull(), "invalid_type")
            .when(F.length(text) < self.min_length, "too_short")
            .when(F.length(text) > self.max_length, "too_long")
            .when(F.size(ws) < self.min_words, "too_few_words")
        )
        if self.punctuation:
            out = out.when(~text.rlike("[.!?]"), "no_punctuation")
        if self.max_repetition is not None:
            out = out.when(T.repetition(ws, self.ngram) > self.max_repetition, "too_repetitive")
        if self.max_perplexity is not None and perplexity is not None:
            out = out.when(perplexity > self.max_perplexity, "high_perplexity")
        return out


def with_reason(df: DataFrame, rules: QualityRules | None = None, text_column: str = "text", reason_column: str = "reason", perplexity_column: str | None = None) -> DataFrame:
    """Add the reason for removal, null for kept rows. The words are computed once, in a projection of their own."""
    rules = rules or QualityRules()
    ws = "__words"
    x = df.withColumn(ws, T.words(F.col(text_column)))
    return x.withColumn(reason_column, rules.reason(F.col(text_column), F.col(ws), F.col(perplexity_column) if perplexity_column else None)).drop(ws)


def filter_stats(df: DataFrame, reason_column: str = "reason") -> DataFrame:
    """(total, passed, removed, reason, n): one row a reason, totals repeated on each; no row for an empty input."""
    return merge_stats(df.groupBy(F.coalesce(reason_column, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n")))


def merge_stats(*stats: DataFrame) -> DataFrame:
    """Sum statistics (reason, n) of several runs by reason, with their totals."""
    out = stats[0].select("reason", "n")
    for s in stats[1:]:
        out = out.unionByName(s.select("reason", "n"))
    by = out.groupBy("reason").agg(F.sum("n").alias("n"))
    passed = F.coalesce(F.sum(F.when(F.col("reason") == "kept", F.col("n"))), F.lit(0))
    one = by.agg(F.sum("n").alias("total"), passed.alias("passed"))  # a row, of as many rows as there are reasons
    return by.join(F.broadcast(one)).select("total", "passed", (F.col("total") - F.col("passed")).alias("removed"), "reason", "n")


def quick_reason(text: Column, ws: Column, rules: QualityRules | None = None) -> Column:
    """The reason of the rules that need no model, for texts; a null text has none."""
    return F.when(text.isNotNull(), replace(rules or QualityRules(), max_perplexity=None).reason(text, ws))


def with_deferred_perplexity(df: DataFrame, scorer, rules: QualityRules, text_column: str = "text", reason_column: str = "reason") -> DataFrame:
    """As ``with_reason``, but only the texts that pass the other rules are scored by an injected model.

    The quick reasons are written once, so the text is judged once; the scorer runs on Arrow batches of the survivors.
    """
    from ..scratch import materialize
    from .models import score

    quick = materialize(with_reason(df, replace(rules, max_perplexity=None), text_column, reason_column), "quick")
    scored = score(quick.where(F.col(reason_column).isNull()), scorer, text_column, "__perplexity")
    high = F.when(F.col("__perplexity") > rules.max_perplexity, "high_perplexity") if rules.max_perplexity is not None else F.lit(None).cast("string")
    return quick.where(F.col(reason_column).isNotNull()).unionByName(scored.withColumn(reason_column, high).drop("__perplexity"))


def quality_filter(df: DataFrame, rules: QualityRules | None = None, text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Kept rows and statistics."""
    x = with_reason(df, rules, text_column, "__reason")
    return x.where("__reason is null").drop("__reason"), filter_stats(x, "__reason")


# Phrases of failed generations.
GENERATION_FAILURES = ["i cannot", "i'm sorry", "as an ai", "i don't have"]


def synthetic_ok(instruction: Column, output: Column) -> Column:
    """Generated rows worth keeping: long enough, and without phrases of failure."""
    text = F.lower(F.concat(F.coalesce(instruction, F.lit("")), F.lit(" "), F.coalesce(output, F.lit(""))))
    short = (F.length(F.coalesce(instruction, F.lit(""))) < 10) | ((F.length(F.coalesce(output, F.lit(""))) > 0) & (F.length(F.coalesce(output, F.lit(""))) < 10))
    return ~short & ~T.contains_any(text, GENERATION_FAILURES)
