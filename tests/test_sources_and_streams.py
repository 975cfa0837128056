"""Files and streams."""

import json
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from loomspan.sources import io
from loomspan.streaming import curation


def test_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    for fmt in ("json", "parquet", "arrow", "orc"):
        io.write(df, str(tmp_path / fmt), fmt)
    assert io.read(spark, str(tmp_path / "parquet")).count() == 2
    with pytest.raises(ValueError, match="unknown format"):
        io.write(df, str(tmp_path / "x"), "xml")


def test_splits(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "id long")
    io.write(df, str(tmp_path / "d" / "train.parquet"), "parquet")
    io.write(df.union(df), str(tmp_path / "d" / "test.parquet"), "parquet")
    assert io.read(spark, str(tmp_path / "d")).count() == 1
    assert io.read_eval(spark, str(tmp_path / "d")).count() == 2
    with pytest.raises(ValueError, match="no split"):
        io.read(spark, str(tmp_path / "d"), split="none")


def test_tasks_and_annotations(spark, tmp_path):
    tasks = spark.createDataFrame([("t1", "p", ["a", "b"]), ("t2", "q", ["a"])], "task_id string, prompt string, responses array<string>")
    io.export_tasks(tasks, str(tmp_path / "c"), "csv")
    got = {r.task_id: r.response_b for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()}
    assert got["t1"] == "b" and not got["t2"]
    rows = [{"task_id": "t1", "annotator_id": "x", "preference": 1, "ratings": {"accuracy": 3}}]
    for name, body in (("l.json", rows), ("e.json", {"annotations": rows})):
        (tmp_path / name).write_text(json.dumps(body))
        r = io.import_annotations(spark, str(tmp_path / name)).collect()
        assert len(r) == 1 and r[0].preference == 1 and r[0].ratings == {"accuracy": 3}
    with pytest.raises(ValueError, match="unknown annotation file"):
        io.import_annotations(spark, "x.txt")


def test_settings(tmp_path):
    @dataclass
    class S:
        a: int = 1
        b: float = 0.5

    assert io.load_settings(str(tmp_path / "none.json")) == {}
    assert io.merge_settings(S, {"a": 5, "z": 1}, {"a": 0, "b": None}) == S(0, 0.5)


def test_reports(spark, tmp_path):
    io.write_report(spark.createDataFrame([(1, 0.5)], "n int, v double"), "T", str(tmp_path), "r")
    assert "| 1 | 0.5000 |" in (tmp_path / "r.md").read_text()


def test_stream_filters_and_dedup(spark, tmp_path):
    good = "These are more than ten words in one proper sentence, which is long enough."
    df = spark.createDataFrame([(1, good), (2, good), (3, "no")], "doc_id long, text string").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = curation.exact_dedup_stream(curation.quality_stream(s)).writeStream.format("memory").queryName("t_stream").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.reason or "kept") for r in spark.table("t_stream").collect()) == ["kept", "too_short"]


def test_near_dedup_across_batches(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(80))
    run = curation.near_dedup_batch(str(tmp_path / "index"), str(tmp_path / "out"))
    run(spark.createDataFrame([(1, words), (2, "quite another text " * 10)], "doc_id long, text string"), 0)
    run(spark.createDataFrame([(3, words), (4, " ".join(f"v{i}" for i in range(80)))], "doc_id long, text string"), 1)
    run(spark.createDataFrame([(3, words), (4, " ".join(f"v{i}" for i in range(80)))], "doc_id long, text string"), 1)
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 4]
