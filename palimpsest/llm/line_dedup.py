"""Line dedup by distinct-site spread: lines that stand on many sites are boilerplate, in built-in functions only.

Every line's hash gets a HyperLogLog sketch of the sites it stands on; sketches are built per task and
merged by aggregation, so a line on a third of all pages costs each task one sketch. Estimates decide the
clear cases. Lines whose estimate is near the threshold get exact distinct counts, so the outcome equals
exact counting unless an estimate errs by more than the margin.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import scratch


@dataclass(frozen=True)
class Settings:
    """A line on ``min_sites`` sites or more is boilerplate, if it has ``min_chars`` code points or more.

    ``margin`` is the share of the threshold on either side within which sites are counted exactly; the
    sketch's standard error at 2**lg_k registers is about 1.04 / sqrt(2**lg_k). With ``keep_first`` the
    document of the smallest id keeps its boilerplate lines, so that no text that whole documents repeat is
    lost from the corpus.

    ``far_sites`` (for lines of ``far_chars`` code points or more, and for shorter ones) are the sites from
    which a line is boilerplate if it also stands in texts of unlike length, the shortest below ``alike`` of
    the longest: such texts are no copies of each other, which a later stage is to find whole.
    """

    min_sites: int = 10
    min_chars: int = 12
    margin: float = 0.3
    lg_k: int = 10
    keep_first: bool = False
    far_sites: tuple[int, int] | None = None
    far_chars: int = 60
    alike: float = 0.75


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate_lines(docs: DataFrame, text_col: str = "text", site_col: str = "source", settings: Settings = Settings()) -> DataFrame:
    """(line) hashes of lines that stand on at least ``min_sites`` distinct sites, or on the ``far_sites`` in
    texts of unlike length. Rows without a site count for none."""
    s = settings
    if s.far_sites:
        return _unlike_or_many(docs, text_col, site_col, s)
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(site_col).cast("string").alias("site")).filter("site is not null")
    rows = rows.select("site", F.explode(_lines(F.col("text"))).alias("line")).filter(F.length(F.trim("line")) >= s.min_chars)
    rows = rows.select("site", _key(F.col("line")).alias("line"))
    # a line of one site only needs no sketch: two cheap extremes rule most lines out
    spread = rows.groupBy("line").agg(F.min("site").alias("a"), F.max("site").alias("b")).filter("a != b") if s.min_sites > 1 else rows.select("line").distinct()
    many = scratch.materialise(spread.select("line"), "lines_on_two_sites")
    shared = rows.join(many, "line", "left_semi")
    sketch = shared.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(s.lg_k))).alias("sites"))
    sketch = scratch.materialise(sketch.filter(F.col("sites") >= s.min_sites * (1 - s.margin)), "line_spread")
    sure = sketch.filter(F.col("sites") > s.min_sites * (1 + s.margin)).select("line")
    near = sketch.filter(F.col("sites") <= s.min_sites * (1 + s.margin)).select("line")
    exact = shared.join(near, "line", "left_semi").groupBy("line", "site").agg(F.lit(1).alias("one")).groupBy("line").agg(F.count("*").alias("sites"))
    return scratch.materialise(sure.unionByName(exact.filter(F.col("sites") >= s.min_sites).select("line")), "boilerplate")


def _unlike_or_many(docs: DataFrame, text_col: str, site_col: str, s: Settings) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(text.alias("text"), F.length(text).alias("size"), F.col(site_col).cast("string").alias("site")).filter("site is not null")
    rows = rows.select("site", "size", F.explode(_lines(F.col("text"))).alias("line"))
    rows = rows.select("site", "size", F.length(F.trim("line")).alias("chars"), _key(F.col("line")).alias("line")).filter(F.col("chars") >= s.min_chars)
    extremes = [F.min("site").alias("a"), F.max("site").alias("b"), F.max("chars").alias("chars"), F.min("size").alias("least"), F.max("size").alias("most")]
    spread = rows.groupBy("line").agg(*extremes)
    far = F.when(F.col("least") < F.col("most") * s.alike, F.when(F.col("chars") >= s.far_chars, s.far_sites[0]).otherwise(s.far_sites[1]))
    spread = spread.select("line", "a", "b", F.least(F.coalesce(far, F.lit(s.min_sites)), F.lit(s.min_sites)).alias("needed"))
    many = scratch.materialise(spread.filter((F.col("a") != F.col("b")) | (F.col("needed") <= 1)).select("line", "needed"), "lines_on_two_sites")
    shared = rows.select("line", "site").join(many, "line")
    sketch = shared.groupBy("line").agg(F.max("needed").alias("needed"), F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(s.lg_k))).alias("sites"))
    sketch = scratch.materialise(sketch.filter(F.col("sites") >= F.col("needed") * (1 - s.margin)), "line_spread")
    clear = F.col("sites") > F.col("needed") * (1 + s.margin)
    near = shared.join(sketch.filter(~clear).select("line"), "line", "left_semi")
    exact = near.groupBy("line", "needed", "site").agg(F.lit(1).alias("one")).groupBy("line", "needed").agg(F.count("*").alias("sites"))
    return scratch.materialise(sketch.filter(clear).select("line").unionByName(exact.filter("sites >= needed").select("line")), "boilerplate")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", settings: Settings = Settings()) -> DataFrame:
    """``docs`` with boilerplate lines cut out of ``text_col``, and counts ``n_lines`` and ``n_removed``.

    Lines are cut at \\n and compared without the blanks around them; kept lines stay as they are. Every row
    stays, with all its columns, even when no line is left; null stays null with no lines, an empty text is
    one empty line. Rows with a null id or equal ids are cleaned like any other: a repeated id shares one
    list of hashes, which is right for each of its texts.
    """
    drop = {"n_lines", "n_removed"}
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in drop))
    bad = boilerplate_lines(docs, text_col, site_col, settings)
    # by the id's hash, so that a null id finds its lines too
    at = F.xxhash64(F.col(f"`{id_col}`"))
    lines = docs.select(at.alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.explode(_lines(F.col(text_col))).alias("_line"))
    lines = lines.filter(F.length(F.trim("_line")) >= settings.min_chars).select("_row", "_id", _key(F.col("_line")).alias("line"))
    hits = lines.join(bad, "line", "left_semi").distinct()
    if settings.keep_first:
        hits = scratch.materialise(hits, "boilerplate_hits")
        first = hits.groupBy("line").agg(F.min("_id").alias("_first"))
        hits = hits.join(first, "line").filter(~F.col("_id").eqNullSafe(F.col("_first")))
    hits = hits.groupBy("_row").agg(F.collect_set("line").alias("_bad"))
    joined = docs.withColumn("_row", at).join(hits, "_row", "left")
    kept = F.filter("_lines", lambda x: (F.length(F.trim(x)) < settings.min_chars) | ~F.array_contains("_bad", _key(x)))
    out = joined.withColumn("_lines", _lines(F.col(text_col))).withColumn("_kept", F.when(F.col("_bad").isNull(), F.col("_lines")).otherwise(kept))
    cleaned = F.when(F.col("_bad").isNull(), F.col(text_col)).otherwise(F.array_join("_kept", "\n"))
    return out.select(
        *(cleaned.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns),
        F.coalesce(F.size("_lines"), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("_lines") - F.size("_kept"), F.lit(0)).cast("bigint").alias("n_removed"),
    )
