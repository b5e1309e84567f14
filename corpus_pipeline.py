"""Corpus pipeline: five stages, each one operator over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents (the last one its own), is
written as Parquet, and is read again as the next stage's input. What a stage has written to the shared folder
on its way goes when the next stage over the same tables starts, as its result is written by then; two runs over
the same tables in one session must not be interleaved.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import piece_lattice, scratch
from palimpsest.llm.decontaminate import decontaminate
from palimpsest.llm.jaccard_join import ngram_jaccard_join
from palimpsest.llm.line_dedup import Settings as LineSettings
from palimpsest.llm.line_dedup import dedup_lines
from palimpsest.llm.queries import tokenizer_file
from palimpsest.llm.toxicity import score_toxicity, train_toxicity
from palimpsest.session import ready

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Sites from which a line of 60 code points or more, and a shorter one, is boilerplate in texts of unlike length.
FAR_SITES = (2, 3)
#: Toxicity from which a document is rejected.
REJECT = 0.7


#: Paths that the last stage over a folder of tables left behind.
_left: dict[str, list[str]] = {}


def _stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.delete(ready(spark), _left.pop(sf_dir, []))
        with scratch.collecting(_left.setdefault(sf_dir, [])):
            return function(spark, docs, sf_dir)

    return run


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*(c for c in COLUMNS if c != "n_chars"), F.length("text").cast("bigint").alias("n_chars"))


@_stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under the threshold; texts are unchanged."""
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs.select(*COLUMNS), model).filter(F.col("score") < REJECT).drop("score")


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand on many sites, or on a few in texts too unlike to be copies, but for each line's first document; n_chars follows the text."""
    return _columns(dedup_lines(docs, settings=LineSettings(keep_first=True, far_sites=FAR_SITES)))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id."""
    classes = ngram_jaccard_join(docs)
    lost = classes.filter("component_id != doc_id").select("doc_id")
    return docs.join(lost, "doc_id", "left_anti").select(*COLUMNS)


@_stage
def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


@_stage
def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every text, checked by decoding it."""
    settings = piece_lattice.Settings(tokenizer_file("piece_bpe_32k.model"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    out = piece_lattice.round_trip_pieces(docs, settings)
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), (F.sha2("decoded", 256) == F.col("text_sha256")).alias("lossless"))


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark_free), ("SentencePiece", pieces)]

#: A trained score and sampled pieces have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for _, stage in STAGES:
        path = scratch.new_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        scratch.delete(spark, before)
        before = [path]
    scratch.delete(spark, _left.pop(sf_dir, []))
    return docs
