"""Session factory with the settings the operators are tested under."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(name: str = "loomspan", cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session: UTC, AQE, few shuffle partitions, Arrow transfer."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", os.environ.get("LOOMSPAN_DRIVER_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make sure that the executors can import this package; where they can't, they get it as a zip. Once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return

    def probe(batches):
        import importlib.util

        import pyarrow as pa

        for _ in batches:
            yield pa.record_batch([pa.array([importlib.util.find_spec("loomspan") is not None])], names=["there"])

    probe.__module__ = "__main__"  # sent by value: the package itself may be missing over there
    there = [r[0] for r in spark.range(1, numPartitions=1).mapInArrow(probe, "there boolean").collect()]
    if not all(there):
        import shutil
        import tempfile

        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="loomspan-code-")
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/loomspan-code", "zip", root, "loomspan"))
    _shipped.add(app)
