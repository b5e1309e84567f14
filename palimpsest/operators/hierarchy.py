"""Identifiers and the tree above sections."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.identifiers import dash_variants, prefixes
from palimpsest.sources.store import shared_dir


def longest_prefix(requests: DataFrame, known: DataFrame, path: str, identifier: str, least: int = 4) -> DataFrame:
    """The deepest known identifier that a path starts with, and the rest of the path; null if none is known."""
    asked = requests.select(path).distinct().select(path, F.explode(prefixes(F.col(path), least)).alias("_p"))
    hit = asked.join(known.select(F.col(identifier).alias("_p")).distinct(), "_p", "left_semi").groupBy(path).agg(F.max_by("_p", F.length("_p")).alias("found"))
    out = requests.join(hit, path, "left")
    return out.withColumn("remainder", F.expr(f"substring(`{path}`, length(found) + 1)"))


def first_candidate(requests: DataFrame, known: DataFrame, number: str, identifier: str) -> DataFrame:
    """The first known spelling among a number's dash variants, in the order typed, hyphen, en dash, em dash."""
    asked = requests.select(number).distinct().select(number, F.posexplode(dash_variants(F.col(number))).alias("_pos", "_v"))
    hit = asked.join(known.select(F.col(identifier).alias("_v")).distinct(), "_v", "left_semi").groupBy(number).agg(F.min_by("_v", "_pos").alias("found"))
    return requests.join(hit, number, "left")


def breadcrumbs(nodes: DataFrame, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """(node, path, cyclic): the ids from the root down, however deep the tree; ``cyclic`` and a null path where the
    way up never ends, in a cycle or below one.

    By doubling: a round joins each open path to the path above it, so a tree of depth d takes log2(d) rounds. Rounds
    are written to the shared folder, which keeps each one's plan the same size. Every round closes the nodes that
    are up to twice as deep as those before; when one closes none, what is left leads into cycles. A null or unknown
    parent makes a node a root; a null id has no row.
    """
    spark = nodes.sparkSession
    root = f"{shared_dir(spark)}/palimpsest/breadcrumbs/{uuid.uuid4().hex}"

    def write(df: DataFrame, k: int) -> DataFrame:
        df.write.parquet(f"{root}/{k}")
        return spark.read.schema(df.schema).parquet(f"{root}/{k}")

    kind = nodes.schema[node].dataType
    first = nodes.filter(F.col(f"`{node}`").isNotNull()).select(F.col(f"`{node}`").alias("n"), F.col(f"`{parent}`").cast(kind).alias("top"))
    up = write(first.select("n", "top", F.array("n").alias("path")), 0)
    left, k = up.filter("top is not null").count(), 0
    while left:
        above = up.select(F.col("n").alias("_n"), F.col("top").alias("_top"), F.col("path").alias("_path"))
        going = up.filter("top is not null").join(above, F.col("top") == F.col("_n"), "left")
        path = F.concat(F.coalesce("_path", F.array().cast(up.schema["path"].dataType)), "path")
        k += 1
        up = write(up.filter("top is null").unionByName(going.select("n", F.col("_top").alias("top"), path.alias("path"))), k)
        before, left = left, up.filter("top is not null").count()
        if left == before:
            break
    ends = F.col("top").isNull()
    return up.select(F.col("n").alias(node), F.when(ends, F.col("path")).alias("path"), (~ends).alias("cyclic"))


def children(nodes: DataFrame, parent: Column, served_seq: Column | None = None) -> DataFrame:
    """Children of a node that exist at the served release, in sibling order."""
    found = nodes.filter(parent)
    return (found if served_seq is None else found.filter(F.col("first_seq") <= served_seq)).orderBy("seq")


def leaves(sections: DataFrame, versions: DataFrame, map_rows: DataFrame) -> DataFrame:
    """Contents entries: every section of a release under its parent, in reading order."""
    return map_rows.join(versions, "version_id").join(sections, "section_id").select("release_seq", "parent_identifier", "identifier", "heading", "status", "seq_in_title")


def merge_structure(observations: DataFrame, key: str = "identifier", seq: str = "seq") -> DataFrame:
    """Nodes from all their observations: first and last release, descriptive fields of the newest.

    Minimum, maximum and max_by do not depend on the order in which releases arrive.
    """
    rest = [c for c in observations.columns if c not in (key, seq)]
    return observations.groupBy(key).agg(F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"), F.max_by(F.struct(*rest), F.struct(seq, *rest)).alias("_d")).select(key, "first_seq", "last_seq", "_d.*")


def sibling_order(nodes: DataFrame, parent: str, place: str) -> DataFrame:
    """``sibling``: 0-based order among a parent's children."""
    return nodes.withColumn("sibling", F.row_number().over(W.partitionBy(parent).orderBy(place)) - 1)


def resolve_pins(requests: DataFrame, pins: DataFrame, nodes: DataFrame, sections: DataFrame) -> DataFrame:
    """A pin (guid) to its node, or else to its section and the path below it."""
    at = requests.join(pins, "guid", "left")
    node = at.join(nodes.select(F.col("identifier")).withColumn("_node", F.lit(True)), "identifier", "left")
    out = longest_prefix(node, sections, "identifier", "identifier")
    kind = F.when(F.col("identifier").isNull(), "missing").when(F.col("_node"), "node").when(F.col("found").isNotNull(), "section").otherwise("missing")
    return out.select("guid", "release_id", "identifier", kind.alias("kind"), F.when(kind == "section", F.col("found")).alias("section"), F.when(kind == "section", F.col("remainder")).alias("remainder"))
