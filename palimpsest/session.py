"""Session helpers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
ROOT = str(Path(__file__).resolve().parent.parent)


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from the checkout (on a cluster, ship it with ``--py-files``), and
    bound the rows and bytes of a batch that is sent to them: texts are long, and 10,000 of them or 64 MB, the defaults,
    may be more than an executor has room for. A value set by the user stays."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([*paths, ROOT])
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "2048")
    if spark.conf.get(_BYTES) in ("64MB", "67108864b"):
        spark.conf.set(_BYTES, "4m")
    return spark
