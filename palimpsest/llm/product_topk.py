"""Exact top-k search by integer inner product: norm-bucketed retrieval.

After Teflioudi et al., "LEMP" (SIGMOD 2015). Candidates are range-partitioned by length, longest first, into shards
and inside a shard into buckets of nearly equal length. A query starts with a lower bound of its k-th score, taken
from the longest vectors of all, and is sent to the shards that hold a vector long enough to reach it. In a
shard it meets the buckets by falling length. The bound divided by the query's and the bucket's length is the
local cosine threshold: above 1 the bucket is skipped; else it is searched by length (the prefix of vectors that
are long enough) or by coordinates (vectors whose normalised components lie, for each of the query's largest
components, in the interval that the threshold leaves), whichever leaves fewer to verify. What is left is verified
by exact products, which raise the bound for the next bucket.

Products are exact: in double precision where the lengths bound every partial sum below 2**53, in 64-bit integers
below 2**62, and else in Python integers; a score beyond the range of a long counts as the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm import scratch
from palimpsest.llm.memory import trimmed


@dataclass(frozen=True)
class Settings:
    """Results; factor before rounding down; longest vectors that give the first bounds; vectors of a shard
    (one task's memory) and of a bucket; coordinates looked at; base of the length classes by which queries
    find their shards; queries searched at once."""

    k: int = 10
    scale: int = 1024
    head_rows: int = 2048
    shard_rows: int = 65_536
    bucket_rows: int = 1024
    focus: int = 4
    class_base: float = 1.02
    block_rows: int = 256


_SLACK = 1e-9  # of lengths and cosines in double precision
_LONG = (1 << 63) - 1


def exact_products(queries: np.ndarray, vectors: np.ndarray, bound: float) -> np.ndarray:
    """Inner products of integer-valued doubles as longs; ``bound`` is at least the product of any two lengths."""
    if bound < 2**53:
        return (queries @ vectors.T).astype(np.int64)
    if bound < 2**62 and max(np.abs(queries).max(initial=0), np.abs(vectors).max(initial=0)) < 2**62:
        a, b = queries.astype(np.int64), vectors.astype(np.int64)
        return np.array([(b * row).sum(1) for row in a], np.int64).reshape(len(a), len(b))
    qs, vs = ([[int(x) for x in row] for row in m] for m in (queries, vectors))
    sums = [[sum(x * y for x, y in zip(q, v, strict=True)) for v in vs] for q in qs]
    return np.array([[min(max(x, -_LONG - 1), _LONG) for x in row] for row in sums], np.int64).reshape(len(qs), len(vs))


class Best:
    """The k best of each query of a block: scores that fall, ties to the smaller id."""

    def __init__(self, own: np.ndarray, floor: np.ndarray, k: int):
        self.own, self.floor, self.k = own, floor.copy(), k
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * len(own)
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * len(own)

    def offer(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        let = (scores >= self.floor[q]) & (ids != self.own[q])
        if not let.any():
            return
        ids, scores = np.concatenate([self.ids[q], ids[let]]), np.concatenate([self.scores[q], scores[let]])
        order = np.lexsort((ids, ~scores))[: self.k]  # ~x falls as x grows, at the least long too
        self.ids[q], self.scores[q] = ids[order], scores[order]
        if len(order) == self.k:
            last = float(scores[order[-1]])
            self.floor[q] = max(self.floor[q], last if abs(last) < 2**53 else np.nextafter(last, -np.inf))


class Bucket:
    """Vectors of nearly equal length, longest first, with each normalised coordinate in sorted order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lengths: np.ndarray):
        self.ids, self.vectors, self.lengths = ids, vectors, lengths
        self.longest = float(lengths[0])
        self._sorted: tuple[np.ndarray, np.ndarray] | None = None

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """Built for the first query that may use it: rows by coordinate, and their values."""
        if self._sorted is None:
            unit = self.vectors / np.where(self.lengths > 0, self.lengths, 1.0)[:, None]
            rows = np.argsort(unit, axis=0, kind="stable")
            self._sorted = rows, np.take_along_axis(unit, rows, axis=0)
        return self._sorted

    def within(self, unit: np.ndarray, cosine: float, focus: int) -> np.ndarray | None:
        """Rows whose angle to the query can be that small by its ``focus`` largest coordinates, or None where
        even the narrowest interval holds more than half."""
        rows, values = self.sorted()
        turn = np.arccos(np.clip(cosine - _SLACK, -1.0, 1.0))
        ranges = []
        for c in np.argsort(-np.abs(unit), kind="stable")[:focus].tolist():
            at = np.arccos(np.clip(unit[c], -1.0, 1.0))
            low, high = np.cos(min(np.pi, at + turn)) - _SLACK, np.cos(max(0.0, at - turn)) + _SLACK
            i, j = np.searchsorted(values[:, c], low, side="left"), np.searchsorted(values[:, c], high, side="right")
            ranges.append((j - i, c, i, j))
        if 2 * min(ranges)[0] > len(self.ids):
            return None
        seen = np.zeros(len(self.ids), np.int16)
        for _, c, i, j in ranges:
            seen[rows[i:j, c]] += 1
        return np.flatnonzero(seen == len(ranges))


def search(buckets: list[Bucket], best: Best, queries: np.ndarray, lengths: np.ndarray, s: Settings) -> dict[str, int]:
    """Offers ``best`` all that can be among the k best; counts how buckets were searched and pairs verified."""
    counts = {"skipped": 0, "by_length": 0, "by_coordinate": 0, "verified": 0}
    unit = queries / np.where(lengths > 0, lengths, 1.0)[:, None]
    for b in buckets:
        reach = lengths * b.longest * (1 + _SLACK)
        live = np.flatnonzero(best.floor <= reach)
        counts["skipped"] += len(queries) - len(live)
        if not len(live):
            continue
        cosine = best.floor[live] / np.where(reach[live] > 0, reach[live], 1.0)
        # by length: as many of the longest as can reach the bound at all
        need = np.where(best.floor[live] > 0, best.floor[live] / np.maximum(lengths[live], 1e-300), -np.inf) * (1 - _SLACK)
        prefix = np.searchsorted(-b.lengths, -need, side="right")
        whole = []
        for q, t, n in zip(live.tolist(), cosine.tolist(), prefix.tolist(), strict=True):
            rows = b.within(unit[q], t, s.focus) if 0 < t else None
            if rows is None or len(rows) >= n:
                whole.append((n, q))
                continue
            counts["by_coordinate"] += 1
            counts["verified"] += len(rows)
            best.offer(q, b.ids[rows], exact_products(queries[q : q + 1], b.vectors[rows], float(reach[q]))[0])
        counts["by_length"] += len(whole)
        if whole:
            n, qs = max(n for n, _ in whole), np.array([q for _, q in whole])
            counts["verified"] += sum(n for n, _ in whole)
            for (m, q), scores in zip(whole, exact_products(queries[qs], b.vectors[:n], float(reach[qs].max())), strict=True):
                best.offer(q, b.ids[:m], scores[:m])
    return counts


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _cut(ids: np.ndarray, vectors: np.ndarray, lengths: np.ndarray, s: Settings) -> list[Bucket]:
    order = np.lexsort((ids, -lengths))
    return [Bucket(ids[o], vectors[o], lengths[o]) for o in (order[i : i + s.bucket_rows] for i in range(0, len(order), s.bucket_rows))]


def _bounds(head: list[Bucket], dims: int, s: Settings):
    """Each query with the k-th best score that the longest vectors give it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors, lengths = batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), dims), batch.column("length").to_numpy()
            best = Best(ids, np.full(len(ids), -np.inf), s.k)
            search(head, best, vectors, lengths, s)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), batch.column("length"), pa.array(best.floor)], ["vec_id", "v", "length", "floor"])

    return run


def _meet(dims: int, s: Settings):
    """Stream sorted by (shard, asks): a shard's vectors, then the queries sent to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, buckets, held = None, [], []
        for batch in batches:
            of, asks, ids, lengths, floor = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "asks", "vec_id", "length", "floor"))
            vectors = _matrix(batch.column("v"), dims)
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (asks[1:] != asks[:-1])) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)], strict=True):
                if i == j:
                    continue
                if of[i] != shard:
                    shard, buckets, held = of[i], [], []
                if not asks[i]:
                    held.append((ids[i:j].copy(), vectors[i:j].copy(), lengths[i:j].copy()))
                    continue
                if held:
                    buckets, held = _cut(*(np.concatenate(x) for x in zip(*held, strict=True)), s), []
                for a in range(i, j, s.block_rows):
                    part = slice(a, min(a + s.block_rows, j))
                    best = Best(ids[part], floor[part], s.k)
                    search(buckets, best, vectors[part], lengths[part], s)
                    asked = np.repeat(ids[part], [len(x) for x in best.ids])
                    yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.scores))], ["query_id", "vec_id", "score"])

    return run


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, v (floor of ``scale`` times each component, as doubles), length; see :func:`top_products` for who takes part."""
    v = F.col(vector_col).cast("array<double>")
    df = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    df = df.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    # floor() of a double gives a long, which large values overflow; from 2**52 on doubles are whole
    whole = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)
    df = df.groupBy("vec_id").agg(F.max("v").alias("v")).withColumn("v", F.transform("v", lambda x: whole(x * scale)))
    df = df.withColumn("most", F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0))).filter(F.col("most") < float("inf"))
    part = lambda x: x / F.col("most")  # noqa: E731  squares of large components would overflow
    length = F.when(F.col("most") > 0, F.col("most") * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + part(x) * part(x)))).otherwise(0.0)
    return df.select("vec_id", "v", F.least(length, F.lit(1e308)).alias("length"))


def top_products(vectors: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, settings: Settings = Settings()) -> DataFrame:
    """The ``k`` rows of highest score of each query: query_id, rank (from 1), vec_id, score, highest first, ties to
    the smaller id.

    Queries are ``queries`` (same columns), or the rows whose id is divisible by ``every``. Rows whose vector
    or id is null, whose vector holds null, NaN or infinite components or is not as long as that of the least id,
    take no part, nor those of which ``scale`` times a component overflows a double; zero and empty vectors do. A query never finds rows of its own id; a repeated id counts once,
    with its largest vector in array order. With fewer candidates than ``k`` all come back. Other columns are ignored.
    """
    s = settings
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, id_col, vector_col, s.scale)
    facts = rows.agg(F.count("*").alias("n"), F.min_by(F.size("v"), "vec_id").alias("dims")).first()
    dims = facts.dims or 0
    asked = rows.filter(F.col("vec_id") % every == 0) if queries is None else integer_vectors(queries, id_col, vector_col, s.scale)
    rows, asked = (df.filter(F.size("v") == F.lit(dims)) for df in (rows, asked))
    # at most head_rows vectors pass the driver
    top = rows.orderBy(F.desc("length"), "vec_id").limit(s.head_rows).collect()
    head = _cut(np.array([r.vec_id for r in top], np.int64), np.array([r.v for r in top], float).reshape(len(top), dims), np.array([r.length for r in top], float), s)
    asked = asked.mapInArrow(trimmed(_bounds(head, dims, s)), "vec_id bigint, v array<double>, length double, floor double")
    asked = scratch.materialise(asked, "queries")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-facts.n // s.shard_rows))
    ranged = rows.repartitionByRange(shards, F.desc("length"), "vec_id").withColumn("shard", F.spark_partition_id())
    ranged = scratch.materialise(ranged, "ranged")
    by_class = lambda length: F.floor(F.log(s.class_base, F.greatest(length, F.lit(1.0))))
    sizes = ranged.groupBy("shard").agg(F.max("length").alias("longest")).withColumn("class", by_class(F.col("longest")))
    # a query needs vectors of length floor / its own; it meets the shards of that length class and all above
    need = F.when(F.col("floor") > 0, F.col("floor") / F.col("length") * (1 - 2 * _SLACK)).otherwise(0.0)
    most = by_class(F.lit(float(top[0].length) if top else 1.0))
    wanted = asked.select("vec_id", F.explode(F.sequence(F.least(by_class(need), most), most)).alias("class"), need.alias("need"))
    sent = wanted.join(sizes, "class").filter("longest >= need").select("vec_id", "shard")
    right = sent.join(asked, "vec_id").select("shard", F.lit(True).alias("asks"), "vec_id", "v", "length", "floor")
    left = ranged.select("shard", F.lit(False).alias("asks"), "vec_id", "v", "length", F.lit(0.0).alias("floor"))
    stream = left.unionByName(right).repartition(shards, "shard").sortWithinPartitions("shard", "asks")
    found = stream.mapInArrow(trimmed(_meet(dims, s)), "query_id bigint, vec_id bigint, score bigint")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score")
