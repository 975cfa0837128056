"""Curation of streams: stateless filters, exact duplicates within a watermark, near duplicates against a stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dedup, quality
from ..scratch import materialize


def quality_stream(stream: DataFrame, rules: quality.QualityRules | None = None, text_column: str = "text") -> DataFrame:
    """The quality reason of each row of a stream; no state."""
    return quality.with_reason(stream, rules, text_column)


def exact_dedup_stream(stream: DataFrame, time_column: str = "ts", text_column: str = "text", delay: str = "1 hour") -> DataFrame:
    """First rows of each text within the watermark: state is bounded by the delay, so an older copy can come again."""
    x = stream.withColumn(time_column, F.col(time_column).cast("timestamp")).withWatermark(time_column, delay)
    return x.withColumn("__h", F.sha2(text_column, 256)).dropDuplicatesWithinWatermark(["__h"]).drop("__h")


def windowed_reasons(stream: DataFrame, time_column: str = "ts", reason_column: str = "reason", window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counts of reasons by event-time window."""
    x = stream.withColumn(time_column, F.col(time_column).cast("timestamp")).withWatermark(time_column, delay)
    return x.groupBy(F.window(time_column, window).alias("window"), F.coalesce(reason_column, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def _exists(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def near_dedup_batch(index_path: str, out_path: str, id_column: str = "doc_id", text_column: str = "text", bands: int = 9, rows: int = 13, slices: int = 64):
    """A ``foreachBatch`` function: rows without a bucket in common with the index are written, and join the index.

    The index is append-only Parquet, kept in slices of its bucket keys: a batch reads the slices its own keys fall into only. A batch that is run
    again overwrites its own part. A failed read of an index that is there fails the batch.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        table = dedup.band_table(dedup.signatures(batch, id_column, text_column), bands, rows)
        table = materialize(table.withColumn("slice", F.pmod("key", F.lit(slices)).cast("int")), "buckets")
        if _exists(spark, index_path):
            touched = [r[0] for r in table.select("slice").distinct().collect()]  # no more than there are slices
            old = spark.read.schema("band int, key long, id long, epoch long, slice int").parquet(index_path).where(F.col("slice").isin(touched) & (F.col("epoch") != epoch))
            known = table.join(old.select("band", "key"), ["band", "key"], "left_semi").select("id").distinct()
        else:
            known = table.select("id").limit(0)
        unknown = table.drop("slice").join(known, "id", "left_anti")  # a row that is dropped for the index drops no other
        fresh = materialize(unknown.select("id").distinct().join(dedup.bucket_drops(unknown), "id", "left_anti"), "fresh")
        batch.join(fresh.withColumnRenamed("id", id_column), id_column, "left_semi").write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")
        new = table.join(fresh, "id", "left_semi").select("band", "key", "id", "slice")
        new.repartition("slice").write.mode("overwrite").partitionBy("slice").parquet(f"{index_path}/epoch={epoch}")

    return run
