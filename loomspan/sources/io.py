"""Reading and writing datasets, tasks, annotations, reports and settings."""

from __future__ import annotations

import json
import os
from dataclasses import fields
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from ..operators.ordering import running_counts

ANNOTATION = t.StructType(
    [
        t.StructField("task_id", t.StringType()), t.StructField("annotator_id", t.StringType()), t.StructField("preference", t.IntegerType()),
        t.StructField("ratings", t.MapType(t.StringType(), t.IntegerType())), t.StructField("ranking", t.ArrayType(t.IntegerType())),
        t.StructField("comments", t.StringType()), t.StructField("time_spent", t.DoubleType()), t.StructField("annotated_at", t.StringType()),
    ]
)
READERS = {".parquet": "parquet", ".json": "json", ".jsonl": "json", ".csv": "csv", ".orc": "orc", ".txt": "text"}


def _listed(spark: SparkSession, path: str) -> list[str] | None:
    """Names in a folder of any file system that Spark reads; None where the path is no folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p) or not fs.getFileStatus(p).isDirectory():
        return None
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


def read(spark: SparkSession, path: str, schema: t.StructType | str | None = None, split: str | None = None, prefer: tuple[str, ...] = ("train",)) -> DataFrame:
    """A file or folder by its suffix. In a folder of splits the named one, else the first preferred, else the first there is."""
    names = None if path.endswith(tuple(READERS)) else _listed(spark, path)
    if names is not None:
        stems = {os.path.splitext(n)[0]: n for n in reversed(names) if os.path.splitext(n)[1] in READERS and not n.startswith(("part-", "_", "."))}
        pick = next((s for s in ((split,) if split else prefer) if s in stems), None)
        if split and pick is None:
            raise ValueError(f"no split {split!r} in {path}")
        if stems:
            path = f"{path.rstrip('/')}/{stems[pick] if pick else stems[min(stems)]}"
    kind = READERS.get(os.path.splitext(path)[1], "parquet")
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if kind == "csv":
        r = r.option("header", True)
    return r.format(kind).load(path)


def from_rows(spark: SparkSession, rows: list[dict] | dict[str, list], schema: t.StructType | str | None = None) -> DataFrame:
    """A table of a list of rows or of columns; a key that a row lacks is null. Rows given on the driver."""
    if isinstance(rows, dict):
        if len({len(v) for v in rows.values()}) > 1:
            raise ValueError("columns of different length")
        names = list(rows)
        rows = [dict(zip(names, r)) for r in zip(*rows.values())]
    names = list(dict.fromkeys(k for r in rows for k in r)) if schema is None else spark.createDataFrame([], schema).columns
    data = [tuple(r.get(k) for k in names) for r in rows]
    return spark.createDataFrame(data, schema if schema is not None else names) if data or schema is not None else spark.range(0).select()


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in the order of the columns named; without one there is no first row, so that raises."""
    if not order:
        raise ValueError("an order is needed")
    return df.orderBy(*order).limit(n)


def read_eval(spark: SparkSession, path: str, **kw: Any) -> DataFrame:
    """The split to evaluate on: test, then validation, then train."""
    return read(spark, path, prefer=("test", "validation", "train"), **kw)


def write(df: DataFrame, path: str, format: str = "json", mode: str = "overwrite") -> None:  # noqa: A002
    """As JSON lines, Parquet, CSV or ORC; ``arrow`` is stored as Parquet."""
    kinds = {"json": "json", "jsonl": "json", "parquet": "parquet", "arrow": "parquet", "csv": "csv", "orc": "orc"}
    if format not in kinds:
        raise ValueError(f"unknown format {format!r}")
    w = df.write.mode(mode).format(kinds[format])
    (w.option("header", True) if format == "csv" else w).save(path)


def export_tasks(tasks: DataFrame, path: str, format: str = "jsonl") -> None:  # noqa: A002
    """Tasks as JSON lines, as CSV (task_id, prompt, response_a, response_b) or as one JSON document with metadata, whose lines are spread over the part files in order."""
    if format == "jsonl":
        write(tasks, path, "jsonl")
    elif format == "csv":
        r = lambda k: F.coalesce(F.get("responses", F.lit(k)), F.lit(""))
        write(tasks.select("task_id", "prompt", r(0).alias("response_a"), r(1).alias("response_b")), path, "csv")
    elif format == "json":
        names = [c for c in ("task_id", "task_type", "prompt", "responses", "dimensions", "metadata") if c in tasks.columns]
        info = tasks.agg(F.min("task_type").alias("task_type") if "task_type" in names else F.lit("").alias("task_type"), F.count("*").alias("num_tasks")).first()
        head = json.dumps({"task_type": info[0] or "", "num_tasks": info[1], "exported_at": datetime.now(timezone.utc).isoformat()})
        rows = tasks.select(F.to_json(F.struct(*names)).alias("value"), F.col(names[0]).alias("key"))
        lines = running_counts(rows.withColumn("one", F.lit(1)).withColumn("at", F.struct("key", "value")), [], "at", "one").select(F.col("upto").alias("place"), F.concat("value", F.when(F.col("upto") < F.col("n"), ",").otherwise("")).alias("value"))
        frame = tasks.sparkSession.createDataFrame([(0, f'{{"metadata": {head}, "tasks": ['), (info[1] + 1, "]}")], "place long, value string")
        # the parts in order of their names are one document
        lines.unionByName(frame).repartitionByRange("place").sortWithinPartitions("place").select("value").write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown format {format!r}")


def import_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotations from JSON lines, a JSON list, or JSON with an ``annotations`` list."""
    if path.endswith(".jsonl"):
        return spark.read.schema(ANNOTATION).json(path)
    if path.endswith(".json"):
        both = t.StructType([*ANNOTATION.fields, t.StructField("annotations", t.ArrayType(ANNOTATION))])
        x = spark.read.schema(both).option("multiLine", True).json(path)
        nested = x.where("annotations is not null").select(F.inline("annotations"))
        return x.where("annotations is null and task_id is not null").drop("annotations").unionByName(nested)
    raise ValueError(f"unknown annotation file {path!r}")


def to_markdown(df: DataFrame, title: str, most: int = 10_000) -> str:
    """A table of a small result, all of it; more than ``most`` rows raise ``ValueError``."""
    return _markdown(_small(df, most), df.columns, title)


def _small(df: DataFrame, most: int) -> list:
    got = df.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows are no report")
    return got


def _markdown(rows: list, columns: list[str], title: str) -> str:
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(show(v) for v in r) + " |" for r in rows)]) + "\n"


def write_report(df: DataFrame, title: str, folder: str, name: str, most: int = 10_000) -> None:
    """A small result as Markdown and JSON, all of it, on the driver's disk; more than ``most`` rows raise ``ValueError``."""
    rows = _small(df, most)
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.md", "w", encoding="utf-8") as f:
        f.write(_markdown(rows, df.columns, title))
    with open(f"{folder}/{name}.json", "w", encoding="utf-8") as f:
        json.dump([r.asDict(True) for r in rows], f, ensure_ascii=False, default=str)


def load_comparison(spark: SparkSession, path: str) -> DataFrame:
    """A saved comparison: one JSON document or a list of them, as rows; a missing file raises what Spark raises."""
    return spark.read.option("multiLine", True).json(path)


def load_settings(path: str) -> dict[str, Any]:
    """Settings from YAML (where a parser is installed) or JSON; a missing file gives none."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs a YAML parser") from e
        return yaml.safe_load(text) or {}
    return json.loads(text or "{}")


def merge_settings(cls: type, *layers: dict[str, Any]) -> Any:
    """A dataclass from layers, later ones first; only None counts as not given, so 0 and False hold."""
    known = {f.name for f in fields(cls)}
    out: dict[str, Any] = {}
    for layer in layers:
        out |= {k: v for k, v in layer.items() if k in known and v is not None}
    return cls(**out)
