"""Global order without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize


def running_counts(counts: DataFrame, keys: list[str], value: str, count: str = "c") -> DataFrame:
    """Add ``upto``, the count up to and with each value of its keys in order, and ``n``, the count of the keys.

    Rows are sorted by range; a running total within each partition is raised by those of the partitions before it.
    ``value`` may be any sortable column. Nulls of keys are a key.
    """
    n = max(2, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    k = F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in keys)) if keys else F.array().cast("array<string>")
    x = materialize(counts.withColumn("__k", k).repartitionByRange(n, "__k", value).withColumn("__part", F.spark_partition_id()), "ordered")
    sums = x.groupBy("__k", "__part").agg(F.sum(count).alias("__s"))  # a row for each key and partition it is in
    by_key = Window.partitionBy("__k")
    before = sums.select("__k", "__part", (F.sum("__s").over(by_key.orderBy("__part")) - F.col("__s")).alias("__before"), F.sum("__s").over(by_key).alias("n"))
    inside = F.sum(count).over(Window.partitionBy("__k", "__part").orderBy(value))
    return x.join(before, ["__k", "__part"]).withColumn("upto", inside + F.col("__before")).drop("__k", "__part", "__before")
