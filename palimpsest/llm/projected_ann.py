"""Approximate nearest neighbours by inner product: stable projections, a kd-tree, a chi-square stopping test.

After Sun et al., "SRS" (PVLDB 8, 2014). One more coordinate turns largest inner product into smallest
Euclidean distance. Vectors are projected to a few dimensions by a Gaussian matrix, for which the squared
ratio of projected to true distance follows a chi-square law. A kd-tree over the projections hands out
points by projected distance, each query's in its own order; each is verified on the original vectors. A query
ends when every point not yet handed out is so far in projection that one nearer than a ``ratio``-th of the
k-th best distance would be there with at most the probability 1 - tau.

The index is cut into shards of bounded size. A task builds a shard's tree once and streams the queries, in
blocks of bounded size, past it; the shards' lists are merged by aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.memory import trimmed

@dataclass(frozen=True)
class Settings:
    """Neighbours; projected dimensions (even); tau, the least probability to catch a nearer point; the ratio of
    distances that an approximate answer may have; rows of a kd-tree leaf, of a shard and of a block of
    queries; seed of the projection."""

    k: int = 20
    dims: int = 8
    tau: float = 0.45
    ratio: float = 1.05
    leaf: int = 16
    shard_rows: int = 16_384
    block_rows: int = 128
    seed: int = 7


def chi_square_quantile(p: float, dims: int) -> float:
    """Inverse of the chi-square distribution function for an even number of degrees of freedom."""

    def cdf(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))

    lo, hi = 0.0, 1.0
    while cdf(hi) < p:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def kd_leaves(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree: median cuts across the widest side, by position, so that equal points part."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        side = int(np.argmax(np.ptp(points[rows], axis=0)))
        half = len(rows) // 2
        order = np.argpartition(points[rows, side], half)
        todo += [rows[order[:half]], rows[order[half:]]]
    return out


class Index:
    """One shard: vectors, projections and the boxes of the kd-tree's leaves."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bound: float, s: Settings):
        self.s, self.bound = s, bound
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        extra = np.sqrt(np.maximum(0.0, bound - (vectors * vectors).sum(1)))
        self.matrix = np.random.default_rng(s.seed).standard_normal((vectors.shape[1] + 1, s.dims))
        projected = vectors @ self.matrix[:-1] + extra[:, None] * self.matrix[-1]
        leaves = kd_leaves(projected, s.leaf)
        by_leaf = np.concatenate(leaves)
        self.ids, self.vectors, self.projected = ids[by_leaf], vectors[by_leaf], projected[by_leaf]
        size = np.array([len(x) for x in leaves])
        place = np.cumsum(size)[:, None] - size[:, None] + np.arange(max(1, int(size.max(initial=0))))
        #: Rows of each leaf, filled up with -1.
        self.rows = np.where(np.arange(place.shape[1]) < size[:, None], place, -1)
        self.low = np.array([projected[x].min(0) for x in leaves])
        self.high = np.array([projected[x].max(0) for x in leaves])
        self.reach = chi_square_quantile(s.tau, s.dims) / s.ratio**2

    def search(self, owns: np.ndarray, qs: np.ndarray, together: int = 8) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and inner products (a row a query, best first, filled up with score -inf) of the nearest found, and
        the number of pairs verified.

        Each query goes through the leaves in the order of their projected distance from it, ``together`` at a
        time, as long as its own stopping test lets them through.
        """
        s, n, at = self.s, len(qs), qs @ self.matrix[:-1]
        near = np.zeros((n, len(self.low)))
        for d in range(s.dims):
            gap = np.maximum(0.0, np.maximum(self.low[:, d] - at[:, d : d + 1], at[:, d : d + 1] - self.high[:, d]))
            near += gap * gap
        order = np.argsort(near, axis=1, kind="stable")
        near = np.take_along_axis(near, order, axis=1)
        base = (qs * qs).sum(1) + self.bound
        ids, score = np.full((n, s.k), np.iinfo(np.int64).max), np.full((n, s.k), -np.inf)
        limit, verified, live = np.full(n, np.inf), 0, np.arange(n)
        for g in range(0, near.shape[1], together):
            live = live[near[live, g] <= limit[live]]
            if not len(live):
                break
            rows = self.rows[order[live, g : g + together]]
            let = (rows >= 0) & (near[live, g : g + together] <= limit[live, None])[:, :, None]
            rows, let = rows.reshape(len(live), -1), let.reshape(len(live), -1)
            let &= self.ids[rows] != owns[live, None]
            q, c = let.nonzero()
            verified += len(q)
            found = np.full(rows.shape, -np.inf)
            for i in range(0, len(q), 1 << 14):
                part = slice(i, i + (1 << 14))
                # row-wise sums: equal vectors get equal products wherever they stand
                found[q[part], c[part]] = (qs[live[q[part]]] * self.vectors[rows[q[part], c[part]]]).sum(1)
            better = (found >= score[live, -1:]) & let
            some = better.any(1).nonzero()[0]
            if not len(some):
                continue
            who = live[some]
            both_ids = np.concatenate([ids[who], np.where(better[some], self.ids[rows[some]], np.iinfo(np.int64).max)], axis=1)
            both = np.concatenate([score[who], np.where(better[some], found[some], -np.inf)], axis=1)
            first = np.argsort(both_ids, axis=1, kind="stable")
            both_ids, both = np.take_along_axis(both_ids, first, 1), np.take_along_axis(both, first, 1)
            best = np.argsort(-both, axis=1, kind="stable")[:, : s.k]
            ids[who], score[who] = np.take_along_axis(both_ids, best, 1), np.take_along_axis(both, best, 1)
            full = who[score[who, -1] > -np.inf]
            limit[full] = self.reach * np.maximum(0.0, base[full] - 2 * score[full, -1]) + 1e-6 * base[full]
        return ids, score, verified


def _meet(bound: float, s: Settings):
    """Stream sorted by (shard, asks): a shard's vectors, then all queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, index, held = None, None, []
        for batch in batches:
            of, asks, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "asks", "vec_id"))
            column = batch.column("v")
            width = len(column.flatten()) // max(1, len(column))
            vectors = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
            cuts = np.append(((of[1:] != of[:-1]) | (asks[1:] != asks[:-1])).nonzero()[0] + 1, len(of))
            for i, j in zip(np.append(0, cuts[:-1]).tolist(), cuts.tolist(), strict=True):
                if i == j:
                    continue
                if of[i] != shard:
                    shard, index, held = of[i], None, []
                if not asks[i]:
                    held.append((ids[i:j], vectors[i:j].copy()))
                    continue
                if not held and index is None:
                    continue  # a shard without vectors
                if index is None:
                    index, held = Index(*(np.concatenate(x) for x in zip(*held, strict=True)), bound, s), []
                for a in range(i, j, s.block_rows):
                    b = min(a + s.block_rows, j)
                    found, score, _ = index.search(ids[a:b], vectors[a:b])
                    q, c = (score > -np.inf).nonzero()
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][q]), pa.array(found[q, c]), pa.array(score[q, c])], ["query_id", "vec_id", "score"])

    return run


def nearest_by_inner_product(vectors: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, settings: Settings = Settings()) -> DataFrame:
    """The ``k`` nearest rows of each query: query_id, rank (from 1), vec_id, score, nearest first, ties to the smaller id.

    Queries are ``queries`` (same columns), or the rows whose id is divisible by ``every``. Rows that are
    null, zero or of another length than the first row's, or that hold null, NaN or infinite components, or
    whose id is null, take no part. A query never finds rows of its own id; a repeated id counts once, with
    its largest vector in array order. With fewer candidates than ``k`` all come back. Other columns are
    ignored. Scores are inner products of the original components in double precision.
    """
    s = settings

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        df = df.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
        good = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
        return df.filter(F.coalesce(good, F.lit(False))).groupBy("vec_id").agg(F.max("v").alias("v"))

    rows = clean(vectors)
    facts = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("bound"), F.min_by(F.size("v"), "vec_id").alias("dims")).first()
    asked = rows.filter(F.col("vec_id") % every == 0) if queries is None else clean(queries)
    rows, asked = (df.filter(F.size("v") == F.lit(facts.dims)) for df in (rows, asked))
    shards = max(1, -(-facts.n // s.shard_rows))
    left = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "vec_id", "v")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "vec_id", "v")
    stream = left.unionByName(right).repartition("shard").sortWithinPartitions("shard", "asks")
    found = stream.mapInArrow(trimmed(_meet(float(facts.bound or 0.0), s)), "query_id bigint, vec_id bigint, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score")


