"""Reading the tables that the registered queries run on, and the search index over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.index import Index, build_index
from palimpsest.sources.store import shared_dir

_built: dict[tuple[str, str], Index] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_index(spark: SparkSession, sf_dir: str) -> Index:
    """The index of a folder's documents, with first lines as headings; built by the application's first search there."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", F.split_part("text", F.lit("\n"), F.lit(1)).alias("heading"))
        root = f"{shared_dir(spark)}/palimpsest-index/{key[0]}/{len(_built)}"
        _built[key] = Index(build_index(spark, root, docs, "doc_id", {"heading": "heading", "body": "text"}, ["source", "lang"]))
    return _built[key]
