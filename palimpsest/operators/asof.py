"""As-of resolution: which release serves a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Ranges that time is cut into; what one task sees of a key is about its share of one.
RANGES = 64


def _ranges(rows: DataFrame, at: str, n: int) -> Column:
    """Number of the range that ``at`` lies in. Cuts are quantiles from a sketch, n - 1 values that the plan holds as literals."""
    shares = [i / n for i in range(1, n)]
    cuts = rows.agg(F.percentile_approx(at, shares, 10 * n).alias("cuts")).first().cuts if shares else None
    kind = rows.schema[at].dataType
    return F.size(F.filter(F.array(*(F.lit(c).cast(kind) for c in sorted(set(cuts or [])))), lambda c: c <= F.col(at))) if cuts else F.lit(0)


def best_until(requests: DataFrame, facts: DataFrame, keys: list[str], at: str, since: str, best: list[str], ranges: int = RANGES) -> DataFrame:
    """For each request the greatest (``best`` ...) of its key's facts with ``since`` <= ``at``, as the struct ``_found``.

    Time is cut into ranges and a window runs within one range of a key; the greatest of each earlier range is
    carried in by a second window over at most ``ranges`` rows of a key. So a key with all the rows, or no key at all, is
    spread over tasks. Repeated requests of a key and time are looked up once, repeated facts reduced before the shuffle.
    Null keys match null keys; a fact without ``since`` never holds, and a request without ``at`` finds nothing.
    """
    asked = requests.select(*keys, F.col(at).alias("_at")).filter("_at is not null").distinct()
    known = facts.filter(F.col(since).isNotNull()).groupBy(*keys, F.col(since).alias("_at")).agg(F.max(F.struct(*best)).alias("_fact"))
    rows = known.unionByName(asked.withColumn("_fact", F.lit(None).cast(known.schema["_fact"].dataType)).withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    rows = rows.withColumn("_range", _ranges(rows, "_at", ranges))
    heads = rows.groupBy(*keys, "_range").agg(F.max("_fact").alias("_fact"))
    before = W.partitionBy(*keys or [F.lit(1)]).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carried = heads.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)), F.col("_range").alias("_r"), F.max("_fact").over(before).alias("_carried"))
    inside = W.partitionBy(*keys, "_range").orderBy("_at").rangeBetween(W.unboundedPreceding, W.currentRow)
    found = rows.withColumn("_fact", F.max("_fact").over(inside)).filter("_asked")
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_{i}"))
    found = found.join(carried, same, "left").select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)), "_at", F.greatest("_fact", "_carried").alias("_found"))
    same = F.col(at) == F.col("_at")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_{i}"))
    return requests.join(found, same, "left").select(*(F.col(f"`{c}`") for c in requests.columns), "_found")


def as_of_join(requests: DataFrame, facts: DataFrame, keys: list[str], at: str, since: str, carry: list[str], ranges: int = RANGES) -> DataFrame:
    """For each request the newest fact of its key with ``since`` <= ``at``; ``carry`` is null where there is none.
    Of facts with equal ``since`` the one with the largest ``carry`` counts. Spread as :func:`best_until` is."""
    named = facts.select(*keys, F.col(since).alias("_since"), *carry)
    out = best_until(requests, named, keys, at, "_since", ["_since", *carry], ranges)
    return out.select(*(F.col(f"`{c}`") for c in requests.columns), F.col("_found._since").alias(f"found_{since}"), *(F.col(f"_found.`{c}`").alias(c) for c in carry))


def ranks(rows: DataFrame, by: str, ranges: int = RANGES) -> DataFrame:
    """(``by``, n): rows numbered from 1 in the order of ``by``, within ranges to which the rows before them are added."""
    cut = rows.select(by).filter(F.col(by).isNotNull()).withColumn("_range", _ranges(rows, by, ranges))
    start = F.sum("_n").over(W.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))  # at most ``ranges`` rows
    starts = cut.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(start, F.lit(0)).alias("_start"))
    numbered = cut.withColumn("_i", F.row_number().over(W.partitionBy("_range").orderBy(by)))
    return numbered.join(starts, "_range").select(by, (F.col("_start") + F.col("_i")).alias("n"))


def served_from(requests: DataFrame, loads: DataFrame, complete_only: bool = True) -> DataFrame:
    """The newest loaded release at or before each request: title, seq -> served_seq (null: none loaded yet).

    ``loads`` is title, seq, sections_loaded; a null count is a load that never finished.
    """
    done = loads.filter("sections_loaded is not null") if complete_only else loads
    return as_of_join(requests, done.select("title", F.col("seq").alias("load_seq")), ["title"], "seq", "load_seq", []).withColumnRenamed("found_load_seq", "served_seq")


def resolve_labels(requests: DataFrame, releases: DataFrame) -> DataFrame:
    """Batch label resolution: status exact, prefix (one ``label`` + ``not`` candidate), ambiguous or missing."""
    bare = releases.select("label", "seq", F.regexp_extract("label", r"^(\d+-\d+)not", 1).alias("bare"))
    one = requests.select(F.col("label").alias("asked")).distinct()
    exact = one.join(releases.select(F.col("label").alias("asked"), F.col("seq").alias("exact_seq")), "asked", "left")
    near = bare.filter("bare != ''").groupBy(F.col("bare").alias("asked")).agg(F.count("*").alias("n"), F.min_by("label", "seq").alias("near_label"), F.min("seq").alias("near_seq"))
    both = exact.join(near, "asked", "left")
    status = F.when(F.col("exact_seq").isNotNull(), "exact").when(F.col("n") == 1, "prefix").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    found = both.select(
        "asked",
        status.alias("status"),
        F.when(status == "exact", F.col("asked")).when(status == "prefix", F.col("near_label")).alias("resolved"),
        F.when(status == "exact", F.col("exact_seq")).when(status == "prefix", F.col("near_seq")).alias("seq"),
    )
    return requests.join(found, requests.label == found.asked, "left").drop("asked")


def resolve_dates(requests: DataFrame, releases: DataFrame) -> DataFrame:
    """The release of the highest seq among those current on or before each ``date``."""
    out = best_until(requests, releases.select("currency_date", F.col("seq").alias("resolved_seq")), [], "date", "currency_date", ["resolved_seq"])
    return out.select(*(F.col(f"`{c}`") for c in requests.columns), F.col("_found.resolved_seq").alias("resolved_seq"))


def behind_by(checks: DataFrame, releases: DataFrame) -> DataFrame:
    """Releases published after the loaded one, per row of (loaded_seq, published_seq); null where the check failed."""
    # ranks turn the count into a difference of two as-of lookups
    ranked = ranks(releases.select(F.col("seq").alias("_seq")), "_seq").withColumnRenamed("n", "_n")
    out = checks
    for at, name in (("loaded_seq", "_from"), ("published_seq", "_to")):
        out = as_of_join(out, ranked, [], at, "_seq", ["_n"]).withColumn(name, F.coalesce("_n", F.lit(0))).drop("_n", "found__seq")
    gap = F.greatest(F.col("_to") - F.col("_from"), F.lit(0))
    return out.withColumn("behind_by", F.when(F.col("published_seq").isNotNull(), gap).cast("bigint")).drop("_from", "_to")
