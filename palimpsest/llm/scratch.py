"""Intermediate tables in the folder that all executors share.

Each table is written once as Parquet under ``spark.checkpoint.dir`` and read back: lineage is cut and a
lost executor costs a re-read instead of a re-run. Where the setting is absent and Spark runs in this
process (tests, notebooks) a temporary folder is made and registered as checkpoint folder; on a cluster,
whose executors could not see it, that is an error.

Tables stay, since results are evaluated late; who knows when a result is written collects their paths with
``collecting`` and deletes them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_paths: ContextVar[list[str] | None] = ContextVar("paths", default=None)


@contextmanager
def collecting(paths: list[str]) -> Iterator[None]:
    """Add the paths of all tables that are written inside the block to ``paths``."""
    before = _paths.set(paths)
    try:
        yield
    finally:
        _paths.reset(before)


def base_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{base_dir(spark)}/palimpsest/{uuid.uuid4().hex}/{name}"
    if (paths := _paths.get()) is not None:
        paths.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
