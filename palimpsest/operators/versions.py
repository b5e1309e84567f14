"""Versions, their releases, and order within a release.

A version is one distinct content of a section; a map row says which version stands in which release, where
in the reading order and under which parent. Currency always comes from the map, so a text that reverts to
an earlier version is current again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dedupe_contents(rows: DataFrame, key: list[str], seq: str, content_hash: str) -> DataFrame:
    """Versions: key, hash, first and last release and number of releases."""
    return rows.groupBy(*key, content_hash).agg(F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"), F.count_distinct(seq).alias("n_releases"))


def version_runs(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Maximal runs of one value: key, run (from 1), value, n_rows, first and last of the first order column."""
    w = W.partitionBy(*key).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return runs.groupBy(*key, "run", value).agg(F.count("*").alias("n_rows"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def current_version(rows: DataFrame, key: list[str], newest_first: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*newest_first))).filter("_n = 1").drop("_n")


def mark_current(rows: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """``is_current`` on the rows of each key's newest release; all others are superseded."""
    return rows.withColumn("is_current", F.col(seq) == F.max(seq).over(W.partitionBy(*key)))


def timeline(map_rows: DataFrame, key: list[str]) -> DataFrame:
    """Each version with its releases in order, its first release, and the version before it."""
    per = map_rows.groupBy(*key, "content_hash").agg(F.min("seq").alias("first_seq"), F.transform(F.array_sort(F.collect_set(F.struct("seq", "label"))), lambda x: x.label).alias("labels"))
    return per.withColumn("previous_hash", F.lag("content_hash").over(W.partitionBy(*key).orderBy("first_seq", "content_hash")))


def dedupe_ratio(deduped: Column, new: Column) -> Column:
    """Share of sections that were there already; 0 for an empty load."""
    return F.coalesce(deduped / F.nullif(deduped + new, F.lit(0)), F.lit(0.0))


def store_ratio(versions: Column, map_rows: Column) -> Column:
    return F.coalesce(1 - versions / F.nullif(map_rows, F.lit(0)), F.lit(0.0))


def occurrences(rows: DataFrame, key: list[str], order: list[str], item: list[str]) -> DataFrame:
    """Repeated identifiers: the first row is served, the others are listed as duplicates."""
    listed = F.array_sort(F.collect_list(F.struct(*order, *[c for c in item if c not in order])))
    out = rows.groupBy(*key).agg(listed.alias("_all"))
    return out.select(*key, F.get("_all", F.lit(0)).alias("primary"), F.slice("_all", 2, 2**31 - 1).alias("duplicates"))


def neighbours(rows: DataFrame, scope: list[str], identifier: str, place: str) -> DataFrame:
    """Previous and next identifier in reading order, counted from the first and last place of a repeated one.

    Previous is the entry of the highest place before the first occurrence, next that of the lowest place
    behind the last one.
    """
    ends = rows.groupBy(*scope, identifier).agg(F.min(place).alias("first_place"), F.max(place).alias("last_place"))
    item = F.struct(F.col(place).alias("p"), F.col(identifier).alias("i"))
    back = W.partitionBy(*scope).orderBy(place).rangeBetween(W.unboundedPreceding, -1)
    ahead = W.partitionBy(*scope).orderBy(place).rangeBetween(1, W.unboundedFollowing)
    at = rows.select(*scope, identifier, place, F.max(item).over(back).alias("_before"), F.min(item).over(ahead).alias("_after")).distinct()
    first = at.select(*scope, identifier, F.col(place).alias("first_place"), F.col("_before.i").alias("previous"))
    last = at.select(*scope, identifier, F.col(place).alias("last_place"), F.col("_after.i").alias("next"))
    return ends.join(first, [*scope, identifier, "first_place"]).join(last, [*scope, identifier, "last_place"]).select(*scope, identifier, "first_place", "last_place", "previous", "next")


def upsert(base: DataFrame, batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last write wins on ``key``: rows of ``batch`` replace those of ``base``; within the batch the highest ``order``."""
    rest = [c for c in batch.columns if c not in key]
    newest = batch.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")
    return base.join(newest, key, "left_anti").unionByName(newest.select(*base.columns))


def new_versions(batch: DataFrame, versions: DataFrame, section: list[str]) -> DataFrame:
    """Batch rows with ``known``: whether their (section, hash) is a version already."""
    seen = versions.select(*section, "content_hash").distinct().withColumn("known", F.lit(True))
    return batch.join(seen, [*section, "content_hash"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
