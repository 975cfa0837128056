"""Written intermediate tables: they cut lineage and outlive lost executors.

Tables go to the shared folder named by ``spark.checkpoint.dir``. Only where that setting is absent and the master is local
(tests) is a temporary folder made and, at exit, removed; a cluster without a shared folder is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local: str | None = None
_written: dict[str, list[str]] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of this session, or a temporary one where the session names none."""
    global _local
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local is None:
        _local = tempfile.mkdtemp(prefix="loomspan-")
        atexit.register(shutil.rmtree, _local, ignore_errors=True)
    return "file://" + _local


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a reader of it.

    From the first table of a session on, the session releases the shuffle files of a finished query, so a job of several
    written stages holds the shuffle of one stage at a time; a session that has its own setting for this keeps it.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if app not in _written:
        _written[app] = []
        try:
            if spark.conf.get(_CLEANUP, "false") == "false":
                spark.conf.set(_CLEANUP, "true")
        except Exception:  # an older Spark without the setting
            pass
    _written[app].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables that this application has written so far; results that still read them can't be used any more. The number of tables."""
    paths = _written.get(spark.sparkContext.applicationId, [])
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    n = len(paths)
    paths.clear()
    return n
