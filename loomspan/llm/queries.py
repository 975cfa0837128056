"""Queries over the test tables, by problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .broken_pairs import broken_pairs
from .consensus import Consensus, agreement
from .leaked_passages import leaked_passages
from .mixture import Mixture
from .near_duplicates import NearDuplicates
from .ranking import consensus_comparisons, rank, stronger
from .template_residue import template_residue
from .text_quality import text_quality
from .toxicity import toxic_passages, toxic_rates
from .votes import valid_votes


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _texts(spark: SparkSession, d: str, column: str) -> DataFrame:
    q, p = _read(spark, d, "quality_texts"), _read(spark, d, "preference_pairs")
    return q.select(F.lit("quality_texts").alias("table_name"), "id", "text").union(p.select(F.lit("preference_pairs"), "pair_id", column))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return NearDuplicates(_texts(spark, d, "prompt"), shingle=3, threshold=0.5, least_words=20).found()


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return NearDuplicates(_texts(spark, d, "prompt"), shingle=3, threshold=0.5, least_words=20).groups()


def _passages(spark: SparkSession, d: str) -> DataFrame:
    q = _read(spark, d, "judged_questions")
    return q.select(F.col("question_id").alias("item"), F.explode(F.concat(F.coalesce("turns", F.array().cast("array<string>")), F.coalesce("answers", F.array().cast("array<string>")))).alias("text"))


def _votes(spark: SparkSession, d: str) -> DataFrame:
    return valid_votes(_read(spark, d, "annotations"), _read(spark, d, "annotation_tasks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return Consensus(_votes(spark, d)).labels(least_votes=3).select("task_id", F.col("label").alias("preference"))


def p2_annotators(spark: SparkSession, d: str) -> DataFrame:
    return Consensus(_votes(spark, d)).annotators()


def p2_agreement(spark: SparkSession, d: str) -> DataFrame:
    return agreement(_votes(spark, d)).select("tasks", "votes", *(F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return text_quality(_read(spark, d, "quality_texts")).where("kind <> 'prose'").select("id", "kind")


def p3_stats(spark: SparkSession, d: str) -> DataFrame:
    return text_quality(_read(spark, d, "quality_texts"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return toxic_passages(_texts(spark, d, "chosen").withColumnRenamed("id", "row_id"), _read(spark, d, "toxicity_labels"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("toxic").select("table_name", "row_id")


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    q, p = _read(spark, d, "quality_texts"), _read(spark, d, "preference_pairs")
    sources = q.select(F.lit("quality_texts").alias("table_name"), F.col("id").alias("row_id"), "source").union(p.select(F.lit("preference_pairs"), "pair_id", "source"))
    return toxic_rates(_scored(spark, d), sources)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return broken_pairs(_read(spark, d, "preference_pairs")).select("pair_id", "side", "defect")


def _ranking(spark: SparkSession, d: str) -> DataFrame:
    labels = Consensus(_votes(spark, d)).labels()  # votes count as far as their annotators are reliable
    return rank(consensus_comparisons(labels, _read(spark, d, "annotation_tasks")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return stronger(_ranking(spark, d))


def p6_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _ranking(spark, d)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaked_passages(_read(spark, d, "documents"), _passages(spark, d))
    return found.select("doc_id", F.col("item").cast("int").alias("question_id"))


def _mixture(spark: SparkSession, d: str) -> Mixture:
    return Mixture(_read(spark, d, "documents"), _read(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).chosen()


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).shares()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return template_residue(_read(spark, d, "documents")).where("excluded").select("doc_id")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_annotators, p2_agreement, p3_found, p3_stats, p4_found, p4_rates, p5_found, p6_found, p6_ranking, p7_found, p8_mix, p8_shares, p9_found)}


AGREEMENT_SQL = """
with votes as (
    select task_id, lower(trim(annotator_id)) annotator, preference,
        row_number() over (partition by task_id, lower(trim(annotator_id)) order by
            try_cast(regexp_replace(trim(annotated_at), '(Z|z|[+-][0-9]{2}:?[0-9]{2})$', '') as timestamp) desc nulls last,
            received_at desc nulls last, preference desc) k
    from annotations
    where preference between 0 and 2 and annotator_id is not null and task_id in (select task_id from annotation_tasks where task_type = 'pairwise')),
tasks as (
    select task_id, count(*) n, count(*) filter (where preference = 0) c0, count(*) filter (where preference = 1) c1, count(*) filter (where preference = 2) c2
    from votes where k = 1 group by task_id having count(*) >= 2),
sums as (
    select count(*) tasks, coalesce(sum(n), 0) v, sum((c0 * (c0 - 1) + c1 * (c1 - 1) + c2 * (c2 - 1)) / (n - 1)) / sum(n) o,
        (sum(c0) * (sum(c0) - 1) + sum(c1) * (sum(c1) - 1) + sum(c2) * (sum(c2) - 1)) / (sum(n) * (sum(n) - 1)) e
    from tasks)
select tasks, cast(v as bigint) votes, round(o, 9) observed, round(e, 9) expected, round((o - e) / (1 - e), 9) kappa from sums
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_agreement": AGREEMENT_SQL}
