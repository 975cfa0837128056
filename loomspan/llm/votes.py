"""Valid votes of annotators on pairwise tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = 3  # 0 and 1: the response preferred; 2: a tie


def valid_votes(annotations: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, annotator, label): the latest valid submission of each annotator for each pairwise task.

    Annotator ids that differ in case or surrounding blanks only are one. A submission without a readable time is
    older than any other; equal times go by arrival, then by the larger label. Rows with a null or impossible
    preference, a null id, or a task that is missing or not pairwise are left out.
    """
    at = F.expr(r"try_cast(regexp_replace(trim(annotated_at), '(Z|z|[+-][0-9]{2}:?[0-9]{2})$', '') as timestamp_ntz)")
    votes = annotations.select(
        "task_id", F.lower(F.trim("annotator_id")).alias("annotator"), F.col("preference").cast("int").alias("label"), at.alias("at"), F.col("received_at").alias("received")
    ).where(F.col("label").between(0, LABELS - 1) & F.col("annotator").isNotNull() & F.col("task_id").isNotNull())
    latest = votes.groupBy("task_id", "annotator").agg(F.max(F.struct("at", "received", "label")).alias("last")).select("task_id", "annotator", F.col("last.label").alias("label"))
    pairwise = tasks.where("task_type = 'pairwise'").select("task_id")
    return latest.join(pairwise, "task_id", "left_semi")
