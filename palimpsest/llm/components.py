"""Connected components of an edge table, without any part of it on the driver.

First every task replaces its share of the edges, of bounded size, by a spanning forest of it whose trees
are stars. Then alternating large-star / small-star rounds (Kiveris et al., 2014) join the shares: every
round is two grouped minima and joins, so a vertex with a million neighbours is a partial aggregate, never a
list.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import scratch
from palimpsest.llm.memory import trimmed


#: Edges that one task turns into a forest at once.
SHARE = 200_000


def _forest(batches: Iterator[pa.RecordBatch], share: int) -> Iterator[pa.RecordBatch]:
    """Stars with the edges' components, share by share."""
    root: dict[int, int] = {}
    seen = 0

    def find(x: int) -> int:
        top = x
        while root.get(top, top) != top:
            top = root[top]
        while root.get(x, x) != top:
            root[x], x = top, root[x]
        return top

    def flush() -> pa.RecordBatch:
        stars = [(x, find(x)) for x in root]
        stars = [(x, y) for x, y in stars if x != y]
        return pa.RecordBatch.from_arrays([pa.array([s[k] for s in stars], pa.int64()) for k in (0, 1)], ["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            low, high = min(a, b), max(a, b)
            root.setdefault(low, low)
            root[high] = low
        seen += batch.num_rows
        if seen >= share:
            yield flush()
            root.clear()
            seen = 0
    yield flush()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def _state(edges: DataFrame):
    """A fingerprint of the edge set: when a round changes nothing every vertex points at its root."""
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, share: int = SHARE) -> DataFrame:
    """(u, component) for every vertex that has an edge; the component is its smallest vertex.

    ``edges`` has two bigint columns u and v in any order; loops and repeats are ignored. An empty table
    gives an empty table. The rounds go on until the edges stand still, which they do after about the square
    of the logarithm of the number of vertices at most.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v")
    now = scratch.materialise(now, "edges")
    shares = max(1, -(-now.count() // share))
    now = scratch.materialise(now.coalesce(shares).mapInArrow(trimmed(lambda batches: _forest(batches, share)), "u bigint, v bigint"), "forest")
    before = None
    while shares > 1:  # the stars of a single share are the components
        now = scratch.materialise(_star(_star(now, True), False), "edges")
        state = _state(now)
        if state == before:
            break
        before = state
    roots = now.select(F.col("v").alias("u"), F.col("v").alias("component"))
    return now.select("u", F.col("v").alias("component")).unionByName(roots).distinct()
