"""Benchmark decontamination: size-partitioned MinHash containment search, in built-in functions only.

An item of thirty shingles inside a document of ten thousand has a Jaccard similarity near zero, so signatures
of one length for all cannot find it. Here an item's signature is the smallest of its shingles' hashes (bottom-k
MinHash), and its length k follows the item's size: a document that contains the item lacks at most m - need of its
m shingles, so of the m - need + ``agree`` smallest hashes at least ``agree`` are the document's, and no item is
lost, however short it is or long the document.

A document's signature is its shingle hashes up to a bound (scaled MinHash). Items are partitioned by size, and the
bound of a document's size class is the largest hash in the signatures of those items that fit into it, so no
document hands over hashes that no signature can hold. Documents and items that agree in enough hashes are
candidates; they are verified by exact containment, on the shingles themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm import scratch
from palimpsest.llm.columns import let

#: Words are cut at space and the control characters 9 to 13.
_SPACE = r"[\x20\x09-\x0D]+"
#: Size classes: an item that needs at most 2**k shingles, and a document of at least as many, are in class k.
MAX_CLASS = 31


@dataclass(frozen=True)
class Settings:
    """Words a shingle; least share of an item's shingles; hashes in which the signatures of a pair must agree (fewer
    where the item has fewer); and the size of the items' tables up to which they are broadcast (estimated bytes;
    beyond it they are joined by shuffle)."""

    n: int = 5
    containment: float = 0.75
    agree: int = 2
    broadcast_bytes: int = 64 << 20


def _words(text: Column) -> Column:
    cut = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{_SPACE}|{_SPACE}$", "")
    low = F.translate(cut, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, _SPACE), lambda x: x != "")


def _starts(words: Column, n: int) -> Column:
    """Indices of the shingles of a text: none, one for a text of fewer than ``n`` words, or all."""
    return F.when(F.size(words) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))))


def _hash(words: Column, i: Column, n: int) -> Column:
    return F.xxhash64(*(F.get(words, i + k) for k in range(n)))


def _text(words: Column, i: Column, n: int) -> Column:
    return F.array_join(F.slice(words, i + 1, n), " ")


def _item_shingles(items: DataFrame, n: int) -> DataFrame:
    words = items.filter("item_id is not null").select(F.col("item_id").cast("bigint").alias("item_id"), _words(F.col("text")).alias("w"))
    rows = words.select("item_id", "w", F.explode(_starts(F.col("w"), n)).alias("i"))
    rows = rows.select("item_id", _hash(F.col("w"), F.col("i"), n).alias("h"), _text(F.col("w"), F.col("i"), n).alias("shingle")).distinct()
    return rows.join(rows.groupBy("item_id").agg(F.count("*").alias("n_item")), "item_id")


def item_signatures(item: DataFrame, s: Settings) -> DataFrame:
    """(item_id, h, k, hits): each item's smallest hashes, its size class, and how many of them a document that
    contains it has at least."""
    need = F.ceil(F.col("n_item") * s.containment)
    rank = F.row_number().over(W.partitionBy("item_id").orderBy("h", "shingle"))
    rows = item.withColumn("need", need).withColumn("rank", rank)
    hits = F.least(F.lit(s.agree), "need")
    k = F.ceil(F.log2("need")).cast("int")
    return rows.filter(F.col("rank") <= F.col("n_item") - F.col("need") + hits).select("item_id", "h", k.alias("k"), hits.cast("int").alias("hits"))


def _bounds(signatures: DataFrame) -> list[int | None]:
    """Largest hash of a signature for each size class and those below it: 32 numbers, whatever the items."""
    largest = {r.k: r.h for r in signatures.groupBy("k").agg(F.max("h").alias("h")).collect()}
    found = [[h for k, h in largest.items() if k <= c] for c in range(MAX_CLASS + 1)]
    return [max(hs, default=None) for hs in found]


def _signature(text: Column, n: int, bounds: list[int | None]) -> Column:
    """The text's distinct shingle hashes up to the bound of its size class, which its number of shingles rounds up to."""
    bound = F.array(*(F.lit(b).cast("bigint") for b in bounds))

    def low(hashes: Column) -> Column:
        k = F.ceil(F.log2(F.size(hashes))).cast("int")
        return let(F.get(bound, k), lambda b: F.array_distinct(F.filter(hashes, lambda h: h <= b)))

    return let(_words(text), lambda w: let(F.transform(_starts(w, n), lambda i: _hash(w, i, n)), low))


def _candidates(texts: DataFrame, item: DataFrame, s: Settings, hint) -> DataFrame:
    """Distinct (doc_id, item_id) whose signatures agree in enough hashes."""
    signatures = scratch.materialise(item_signatures(item, s), "item_signatures")
    bounds = _bounds(signatures)

    def handed_over(df: DataFrame, bounds: list[int | None]) -> DataFrame:
        # explode_outer, as an inner one is preceded by a filter that computes the array a second time
        return df.select("doc_id", F.explode_outer(_signature(F.col("text"), s.n, bounds)).alias("h"))

    rows = handed_over(texts, bounds)
    # the texts of a repeated id are one document, longer than each of them: these hand over for items of all sizes
    repeated = scratch.materialise(texts.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated_ids")
    if not repeated.isEmpty():
        rows = rows.unionByName(handed_over(texts.join(repeated, "doc_id", "left_semi"), bounds[-1:] * len(bounds)))
    met = rows.join(hint(signatures.select("item_id", "h", "hits")), "h")
    shared = met.groupBy("doc_id", "item_id").agg(F.count_distinct("h").alias("n"), F.first("hits").alias("hits"))
    return shared.filter("n >= hits").select("doc_id", "item_id")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Pairs of a document and an item it contains: doc_id, item_id, n_shared, n_item, containment.

    Contained means: at least ``containment`` of the item's distinct ``n``-word shingles are shingles of the
    document. Words are cut at ASCII white space, A-Z lower-cased; a text of fewer than ``n`` words is one
    shingle. Null and empty texts contain nothing and are contained nowhere; rows with null ids are left
    out; a repeated doc_id counts as one document with all its texts, a repeated item_id likewise. Other
    columns are ignored.
    """
    s = settings
    item = scratch.materialise(_item_shingles(items, s.n), "item_shingles")
    size = item.agg(F.coalesce(F.sum(F.octet_length("shingle") + 64), F.lit(0)).alias("n")).first().n
    small = size <= s.broadcast_bytes
    hint = F.broadcast if small else (lambda df: df)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    pairs = scratch.materialise(_candidates(texts, item, s, hint), "candidates")

    again = texts.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    each = let(_words(F.col("text")), lambda w: F.transform(_starts(w, s.n), lambda i: _text(w, i, s.n)))
    rows = again.select("doc_id", F.explode_outer(each).alias("shingle"))
    shared = rows.join(hint(item.select("item_id", "n_item", "shingle")), "shingle").distinct()
    shared = shared.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"), F.first("n_item").alias("n_item"))
    shared = shared.filter(F.col("n_shared") >= F.col("n_item") * s.containment).join(pairs, ["doc_id", "item_id"], "left_semi")
    return shared.select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``docs`` without the rows that contain an item. Rows with a null id stay."""
    bad = scratch.materialise(contaminated(docs, items, id_col, text_col, settings).select("doc_id").distinct(), "contaminated")
    key = F.col(f"`{id_col}`").cast("bigint")
    return docs.join(bad.select(F.col("doc_id").alias("_contaminated")), key == F.col("_contaminated"), "left_anti")
