"""Plans, ledgers and verification of loads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.identifiers import file_title


def plan_backfill(releases: DataFrame) -> DataFrame:
    """(seq, title, baseline): the oldest release takes every title ever named, each later one those it affects."""
    named = releases.select("seq", F.explode("titles_affected").alias("title")).withColumn("title", file_title(F.col("title"))).filter("title is not null").distinct()
    oldest = F.broadcast(releases.agg(F.min("seq").alias("_first")))  # one row
    base = named.select("title").distinct().crossJoin(oldest).select(F.col("_first").alias("seq"), "title", F.lit(True).alias("baseline"))
    later = named.crossJoin(oldest).filter("seq > _first").select("seq", "title", F.lit(False).alias("baseline"))
    return base.unionByName(later)


def plan_loads(ledger: DataFrame, releases: DataFrame, done: DataFrame) -> DataFrame:
    """Downloads that are ok, belong to a known release and are not loaded yet, oldest release first."""
    ready = ledger.filter("status = 'ok'").join(releases.select("label", "seq"), "label")
    return ready.join(done.select("label", "title"), ["label", "title"], "left_anti").orderBy("seq", "title")


def latest_affecting(requests: DataFrame, releases: DataFrame) -> DataFrame:
    """For each (title, seq) the newest release before it that changed the title."""
    from palimpsest.operators.asof import as_of_join

    named = releases.select(F.explode("titles_affected").alias("title"), F.col("seq").alias("change_seq"))
    out = as_of_join(requests.withColumn("_before", F.col("seq") - 1), named, ["title"], "_before", "change_seq", [])
    return out.drop("_before").withColumnRenamed("found_change_seq", "latest_seq")


def compare_counts(recorded: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """Recorded against counted rows per key, from both sides: ``n_recorded``, ``n_actual``, ``sound``."""
    counted = actual.groupBy(*key).agg(F.count("*").alias("n_actual"))
    both = recorded.join(counted, key, "full_outer")
    return both.withColumn("n_actual", F.coalesce("n_actual", F.lit(0))).withColumn("sound", F.coalesce(F.col("n_recorded") == F.col("n_actual"), F.lit(False)))


def duplicate_groups(rows: DataFrame, digest: str, owner: str, size: str) -> DataFrame:
    """Digests of two rows or more: members, owners, wasted size, and whether owners differ."""
    out = rows.groupBy(digest).agg(F.count("*").alias("n"), F.count_distinct(owner).alias("n_owners"), F.max(size).alias("_size"))
    return out.filter("n > 1").select(digest, "n", "n_owners", (F.col("_size") * (F.col("n") - 1)).alias("wasted"), (F.col("n_owners") > 1).alias("across"))


def symmetric_difference(page: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: ``new`` on the page, ``vanished`` from it."""
    new = page.join(known, key, "left_anti").select(key, F.lit("new").alias("side"))
    return new.unionByName(known.join(page, key, "left_anti").select(key, F.lit("vanished").alias("side")))


def collisions(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def percentiles(rows: DataFrame, by: list[str], value: str, nearest: dict[str, float], index: dict[str, float]) -> DataFrame:
    """Percentiles of a column per group, by names: ``nearest`` by nearest rank, place floor(p/100*n + 0.5), at least 1
    and at most n; ``index`` by index, place min(n - 1, int(p/100*n)) from 0. Nulls do not count.

    Values are counted first and picked by their cumulated counts, so no group becomes a list.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = W.partitionBy(*by)
    ranked = counts.withColumn("_to", F.sum("_c").over(w.orderBy(value))).withColumn("_n", F.sum("_c").over(w))
    n = F.col("_n")
    places = {k: F.greatest(F.lit(1), F.least(n, F.floor(F.lit(p / 100.0) * n + 0.5))) for k, p in nearest.items()}
    places |= {k: F.least(n - 1, F.floor(F.lit(p / 100.0) * n)) + 1 for k, p in index.items()}
    return ranked.groupBy(*by).agg(*(F.min(F.when(F.col("_to") >= at, F.col(value))).alias(k) for k, at in places.items()))


def verification_report(checks: DataFrame, by: list[str]) -> DataFrame:
    """Of checked counts (``compare_counts``) per ``by``: how many, how many do not agree, and whether all do."""
    return checks.groupBy(*by).agg(F.count("*").alias("n_checked"), F.count_if(~F.col("sound")).alias("n_wrong"), F.every("sound").alias("sound"))


def modal_gap(checks: DataFrame, by: list[str]) -> DataFrame:
    """The most common difference between counted and recorded rows that is not zero, ties to the smaller one."""
    gaps = checks.withColumn("gap", F.col("n_actual") - F.coalesce("n_recorded", F.lit(0))).filter("gap != 0").groupBy(*by, "gap").agg(F.count("*").alias("n"))
    return gaps.groupBy(*by).agg(F.max_by("gap", F.struct("n", -F.col("gap"))).alias("gap"), F.max("n").alias("n"))


def step_summary(calls: DataFrame) -> DataFrame:
    """Per step of ``calls`` (step, code, ms, bytes): calls, good ones (0 < code < 400), p50 and p95 of the good ones by
    nearest rank, median bytes by index, and a histogram of codes."""
    good = (F.col("code") > 0) & (F.col("code") < 400)
    n = calls.groupBy("step").agg(F.count("*").alias("n"), F.count_if(good).alias("n_ok"))
    time = percentiles(calls.filter(good), ["step"], "ms", {"p50": 50, "p95": 95}, {})
    size = percentiles(calls.filter(good), ["step"], "bytes", {}, {"median_bytes": 50})
    codes = histogram(calls, "code", ["step"]).withColumnRenamed("counts", "codes")
    return n.join(time, "step", "left").join(size, "step", "left").join(codes, "step", "left")


def histogram(rows: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Counts of the non-null values of ``key`` as a map, per ``by``."""
    counts = rows.filter(F.col(key).isNotNull()).groupBy(*by, key).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias("counts"))
