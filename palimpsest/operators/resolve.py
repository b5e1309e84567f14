"""Composite lookups over tables of requests: releases, sections and what lies below them, citations, listings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.citations import parse_citation
from palimpsest.functions.identifiers import dash_variants
from palimpsest.functions.markup import provision_below
from palimpsest.operators.asof import resolve_dates, resolve_labels, served_from
from palimpsest.operators.hierarchy import longest_prefix
from palimpsest.sources.store import shared_dir


def resolve_releases(requests: DataFrame, releases: DataFrame, loads: DataFrame) -> DataFrame:
    """``requests`` (label, date, title) with resolved_seq and via: a label goes before a date, and without both the
    newest release loaded for the title counts, or the newest of all where no title is given. A label that names
    no release, or several, resolves to null; so does a date before the first release."""
    labels = resolve_labels(requests.select("label").filter("label is not null").distinct(), releases).select(F.col("label").alias("_l"), F.col("seq").alias("_label_seq"))
    dates = resolve_dates(requests.select("date").filter("date is not null").distinct(), releases).select(F.col("date").alias("_d"), F.col("resolved_seq").alias("_date_seq"))
    newest = loads.filter("sections_loaded is not null").groupBy(F.col("title").alias("_t")).agg(F.max("seq").alias("_title_seq"))
    last = F.broadcast(releases.agg(F.max("seq").alias("_last")))  # one row
    out = requests.join(labels, F.col("label") == F.col("_l"), "left").join(dates, F.col("date") == F.col("_d"), "left").join(newest, F.col("title") == F.col("_t"), "left").crossJoin(last)
    via = F.when(F.col("label").isNotNull(), "label").when(F.col("date").isNotNull(), "date").otherwise("latest")
    seq = F.when(via == "label", F.col("_label_seq")).when(via == "date", F.col("_date_seq")).when(F.col("title").isNotNull(), F.col("_title_seq")).otherwise(F.col("_last"))
    return out.select(*requests.columns, seq.alias("resolved_seq"), via.alias("via"))


def get_sections(requests: DataFrame, sections: DataFrame, loads: DataFrame, placements: DataFrame, versions: DataFrame) -> DataFrame:
    """Sections, and provisions below them, as of a release: one row a request (identifier, seq).

    ``sections`` is identifier, title; ``loads`` title, seq, sections_loaded; ``placements`` identifier, seq,
    version_id, seq_in_title, parent_identifier; ``versions`` version_id, heading, markup, first_seq. The deepest
    known section that the identifier starts with is served from the newest load at or before ``seq``. Where it
    stands several times the first in reading order is the answer, ``n_occurrences`` counts them, and the provision
    comes from the first that holds it. ``found`` is null where nothing below the section was asked for; all
    result columns are null where no section is known or none was served.
    """
    spark, path = requests.sparkSession, f"{shared_dir(requests.sparkSession)}/palimpsest/sections/{uuid.uuid4().hex}"
    asked = requests.select("identifier", "seq").distinct()
    at = longest_prefix(asked, sections, "identifier", "identifier").withColumnRenamed("found", "section")
    at = at.filter("section is not null").join(sections.select(F.col("identifier").alias("section"), "title"), "section")
    # written once, as what serves a title is asked several times
    at.write.parquet(path)
    at = spark.read.schema(at.schema).parquet(path)
    served = served_from(at.select("title", "seq").distinct(), loads).filter("served_seq is not null")
    at = served_from(at, loads).filter("served_seq is not null")
    # only placements in releases that serve, as many as there are at most, travel to their sections
    kept = placements.join(F.broadcast(served.select(F.col("served_seq").alias("seq")).distinct()), "seq", "left_semi")
    rows = at.join(kept.select(F.col("identifier").alias("section"), F.col("seq").alias("served_seq"), "version_id", "seq_in_title", "parent_identifier"), ["section", "served_seq"])
    rows = rows.join(versions, "version_id")
    rows = rows.withColumn("_p", provision_below(F.col("markup"), F.col("identifier"), F.col("remainder") != ""))
    order = F.struct("seq_in_title", "version_id")
    first = F.min_by(F.struct("title", "served_seq", "section", "version_id", "heading", "seq_in_title", "parent_identifier", "first_seq"), order).alias("_first")
    # a provision that some occurrence holds sorts before all attempts that failed
    below = F.min_by(F.col("_p"), F.struct(~F.coalesce(F.col("_p.found"), F.lit(False)), order)).alias("_below")
    found = rows.groupBy("identifier", "seq").agg(first, below, F.count("*").alias("n_occurrences"))
    found = found.select("identifier", "seq", "_first.*", "n_occurrences", F.col("_below.found").alias("found"), F.col("_below.xml").alias("provision"))
    return requests.join(found, ["identifier", "seq"], "left")


def lookup_citations(requests: DataFrame, sections: DataFrame, nodes: DataFrame) -> DataFrame:
    """What a written citation names and whether it is there: ``requests`` (text) with status, identifier, actual, message.

    ``sections`` and ``nodes`` hold the identifiers of sections and of structure at the release asked for. Status
    is ``unread`` for a text that is no citation, ``found`` or ``absent``. A section's number is tried in the
    spelling typed and with its dashes exchanged, the first known one being ``actual``. The one absence that can
    be explained, a flat number in an appendix, has a message.
    """
    asked = requests.select("text").distinct().withColumn("c", parse_citation(F.col("text")))
    is_section = F.col("c.form").isin("standard", "inverted", "title last", "slashed") | F.col("c.section_identifier").rlike("/s[0-9][^/]*$")
    one = asked.select("text", F.col("c.identifier").alias("identifier"), F.col("c.section_identifier").alias("_holder"), F.col("c.appendix").alias("_appendix"), (F.col("c.form") == "title").alias("_title"), is_section.alias("_is_section"))
    tried = one.filter("identifier is not null").select("text", "_is_section", F.posexplode(dash_variants(F.col("_holder"))).alias("_place", "_spelling"))
    known = sections.select(F.col("identifier").alias("_spelling"), F.lit(True).alias("_is_section")).unionByName(nodes.select(F.col("identifier").alias("_spelling"), F.lit(False).alias("_is_section"))).distinct()
    hit = tried.join(known, ["_spelling", "_is_section"]).groupBy("text").agg(F.min_by("_spelling", "_place").alias("actual"))
    status = F.when(F.col("identifier").isNull(), "unread").when(F.col("actual").isNotNull(), "found").otherwise("absent")
    message = F.when((status == "absent") & F.col("_appendix") & ~F.col("_title"), F.concat(F.lit("appendices are published under the laws that enacted them; no flat number such as "), F.col("identifier"), F.lit(" can be looked up")))
    found = one.join(hit, "text", "left").select("text", status.alias("status"), "identifier", "actual", message.alias("message"))
    return requests.join(found, "text", "left")


def list_titles(titles: DataFrame, loads: DataFrame) -> DataFrame:
    """Titles with their loads: how many, the newest one and its sections. Titles never loaded are kept."""
    done = loads.filter("sections_loaded is not null").groupBy("title").agg(F.count("*").alias("n_loads"), F.max("seq").alias("newest_seq"), F.max_by("sections_loaded", "seq").alias("n_sections"))
    return titles.join(done, "title", "left").withColumn("n_loads", F.coalesce("n_loads", F.lit(0)))


def list_releases(releases: DataFrame, loads: DataFrame, title: str | None = None) -> DataFrame:
    """Releases, newest first, with the titles loaded from each; with ``title`` those that affect it."""
    kept = releases if title is None else releases.filter(F.array_contains("titles_affected", title))
    done = loads.filter("sections_loaded is not null").groupBy("seq").agg(F.count_distinct("title").alias("n_titles"))
    return kept.join(done, "seq", "left").withColumn("n_titles", F.coalesce("n_titles", F.lit(0))).orderBy(F.desc("seq"))


def current_placements(placements: DataFrame, versions: DataFrame) -> DataFrame:
    """The version in force of every section and two placements of it: the newest, and that at the release where
    its text first appeared (null where the section was not placed there)."""
    newest = placements.withColumn("_r", F.row_number().over(W.partitionBy("identifier").orderBy(F.desc("seq"), "seq_in_title", "version_id"))).filter("_r = 1").drop("_r")
    mapped = newest.join(versions.select("version_id", "first_seq"), "version_id").alias("mapped")
    first = placements.select("identifier", "version_id", F.col("seq").alias("first_seq"), F.col("seq_in_title").alias("first_place")).groupBy("identifier", "version_id", "first_seq").agg(F.min("first_place").alias("first_place"))
    return mapped.join(first, ["identifier", "version_id", "first_seq"], "left").select("identifier", "version_id", "seq", "seq_in_title", "first_seq", "first_place")
