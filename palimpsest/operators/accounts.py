"""Sign-in throttling, sessions and watchlists as batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def trailing_failures(attempts: DataFrame, key: str, at: str = "ts", minutes: int = 15) -> DataFrame:
    """``failures``: failed attempts of the key in the window that ends with each row, itself included."""
    when = F.unix_micros(F.col(at).cast("timestamp"))
    w = W.partitionBy(key).orderBy(when).rangeBetween(-minutes * 60 * 1_000_000, W.currentRow)
    return attempts.withColumn("failures", F.count("*").over(w))


def throttled(attempts: DataFrame, limits: dict[str, int], at: str = "ts", minutes: int = 15) -> DataFrame:
    """``blocked`` where any key's trailing failures exceed its limit."""
    out, blocked = attempts, F.lit(False)
    for key, limit in limits.items():
        out = trailing_failures(out, key, at, minutes).withColumnRenamed("failures", f"failures_{key}")
        blocked |= F.col(f"failures_{key}") > limit
    return out.withColumn("blocked", blocked)


def live_sessions(sessions: DataFrame, now) -> DataFrame:
    return sessions.filter(F.col("expires_at") >= now)


def watchlist_counts(lists: DataFrame, items: DataFrame) -> DataFrame:
    n = items.groupBy("watchlist_id").agg(F.count("*").alias("n"))
    return lists.join(n, "watchlist_id", "left").withColumn("n_items", F.coalesce("n", F.lit(0))).drop("n")


def enrich_items(items: DataFrame, labels: DataFrame, key: list[str]) -> DataFrame:
    """Items with the label of their identifier at their release; unknown ones keep their row."""
    return items.join(labels, key, "left")
