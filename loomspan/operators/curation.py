"""A curation pipeline: filters in sequence, each seeing the survivors of the ones before."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from . import dedup, quality, screening

#: A stage adds a reason (null: kept) to the surviving rows.
Stage = Callable[[DataFrame], DataFrame]


def by_column(condition: Callable[[DataFrame], Column]) -> Stage:
    return lambda df: df.withColumn("__reason", condition(df))


@dataclass
class Curator:
    """Built by ``add`` or ``standard``; every run begins without memory of earlier ones."""

    text_column: str = "text"
    id_column: str = "doc_id"
    stages: list[tuple[str, Stage]] = field(default_factory=list)

    def add(self, name: str, stage: Stage) -> Curator:
        taken = [n for n, _ in self.stages]
        self.stages.append((name if name not in taken else f"{name}_{len(taken)}", stage))
        return self

    def quality(self, rules: quality.QualityRules | None = None) -> Curator:
        return self.add("quality", lambda df: quality.with_reason(df, rules, self.text_column, "__reason"))

    def deduplicate(self, method: str = "exact", threshold: float = 0.8) -> Curator:
        if method == "exact":
            def stage(df: DataFrame) -> DataFrame:
                x = dedup.exact_duplicates(df, self.id_column, self.text_column)
                return x.withColumn("__reason", F.when(F.col(self.text_column).isNull(), "invalid_type").when(F.col("duplicate"), "exact_duplicate")).drop("duplicate")
        elif method == "minhash":
            def stage(df: DataFrame) -> DataFrame:
                keep = dedup.minhash_dedup(df, threshold, id_column=self.id_column, text_column=self.text_column).select(F.col(self.id_column).alias("__k")).distinct()
                x = df.join(keep, df[self.id_column] == F.col("__k"), "left")
                return x.withColumn("__reason", F.when(F.col("__k").isNull(), "near_duplicate")).drop("__k")
        else:
            raise ValueError(f"unknown method {method!r}")
        return self.add("dedup", stage)

    def toxicity(self, scores_column: str = "scores", threshold: float = 0.7) -> Curator:
        return self.add("toxicity", by_column(lambda df: screening.reason(F.col(self.text_column), F.col(scores_column), threshold)))

    @classmethod
    def from_settings(cls, settings: dict, **kw) -> Curator:
        """Filters in the order quality, deduplication, toxicity, each where its settings aren't absent or switched off (``enabled``)."""
        out = cls(**kw)
        on = lambda x: x is not None and x is not False and (not isinstance(x, dict) or x.get("enabled", True))
        given = lambda x: {k: v for k, v in x.items() if k != "enabled"} if isinstance(x, dict) else {}
        if on(x := settings.get("quality")):
            out.quality(quality.QualityRules(**given(x)))
        if on(x := settings.get("deduplication")):
            out.deduplicate(**given(x))
        if on(x := settings.get("toxicity")):
            out.toxicity(**given(x))
        return out

    def run(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Kept rows, and (position, stage, total, passed, removed, reason, n) with a row for each reason of each stage."""
        stats = None
        for k, (name, stage) in enumerate(self.stages):
            judged = materialize(stage(df), name)  # read by the statistics and, more than once, by the next stage
            s = quality.filter_stats(judged, "__reason").select(F.lit(k).alias("position"), F.lit(name).alias("stage"), "total", "passed", "removed", "reason", "n")
            stats = s if stats is None else stats.unionByName(s)
            df = judged.where("__reason is null").drop("__reason")
        return df, stats
