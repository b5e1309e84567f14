"""Structured Streaming forms: incremental loads, poll log, sign-in throttle, rate limiter, change feed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def failures_per_window(attempts: DataFrame, key: str, at: str = "ts", length: str = "15 minutes", slide: str = "1 minute", late: str = "30 minutes") -> DataFrame:
    """Failed attempts per key and sliding window; attempts later than the watermark are dropped."""
    return attempts.withWatermark(at, late).groupBy(F.window(at, length, slide), key).agg(F.count("*").alias("failures"))


def first_seen(rows: DataFrame, key: list[str], at: str = "ts", late: str = "1 day") -> DataFrame:
    """Each key once within the watermark, for change feeds that repeat rows."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def take_token(level: float, last: float, now: float, capacity: float, rate: float) -> tuple[bool, float, float]:
    """(allowed, tokens left, seconds until the next) of a bucket that refills at ``rate`` a second."""
    level = min(capacity, level + max(0.0, now - last) * rate)
    if level >= 1:
        return True, level - 1, 0.0
    return False, level, max(1.0, (1 - level) / rate)


def rate_limited(requests: DataFrame, key: str, at: str = "ts", capacity: float = 10.0, rate: float = 1.0, idle: str = "1 hour") -> DataFrame:
    """Decisions of a token bucket per key, by event time: key, ts, allowed, retry_after."""
    columns = f"{key} {requests.schema[key].dataType.simpleString()}, {at} timestamp, allowed boolean, retry_after double"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        level, last = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(batches)).sort_values(at, kind="stable")
        out = []
        for t in rows[at]:
            now = t.timestamp()
            allowed, level, wait = take_token(level, now if last is None else last, now, capacity, rate)
            last = now if last is None else max(last, now)
            out.append((k[0], t, allowed, wait))
        state.update((level, last))
        state.setTimeoutTimestamp(int(last * 1000) + int(pd.Timedelta(idle).total_seconds() * 1000))
        yield pd.DataFrame(out, columns=[key, at, "allowed", "retry_after"])

    return requests.withWatermark(at, idle).groupBy(key).applyInPandasWithState(step, columns, "level double, last double", "append", GroupStateTimeout.EventTimeTimeout)


def upsert_batches(path: str, key: list[str], order: list[str]):
    """A ``foreachBatch`` function that keeps a table by last write wins.

    Plain Parquet has no merge, so every batch writes a new generation beside the old one; a batch that is
    run again overwrites its own generation, and readers take the newest complete one.
    """
    from palimpsest.operators.versions import upsert

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        older = [g for g in generations(spark, path) if g < batch_id]
        base = spark.read.parquet(f"{path}/generation={max(older)}") if older else batch.limit(0)
        upsert(base, batch, key, order).write.mode("overwrite").parquet(f"{path}/generation={batch_id}")

    return write


def generations(spark, path: str) -> list[int]:
    """Complete generations of a table kept by ``upsert_batches``."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    found = [s.getPath() for s in fs.listStatus(where)]
    done = [p.getName() for p in found if fs.exists(p.suffix("/_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in done if n.startswith("generation="))
