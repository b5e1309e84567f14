"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Two documents link when the Jaccard similarity of their sets of n-word shingles reaches a threshold. The
plan, none of whose steps holds a group of documents in memory:

1. One pass counts shingles in a fixed-size hashed sketch (summed by aggregation) and gives every document
   the hash of its shingle set. Documents with equal sets are one node from here on.
2. A second pass orders each set by (count class, hash), rarest first, and emits its prefix: a pair at or
   above the threshold must share a prefix shingle. Any total order is correct; the sketch makes it short.
3. Prefix rows are sorted by shingle and set size. Every row of a shingle's list is paired with the row
   before it and with the list's first row of an admissible length (the hub), if length and positional
   filters allow: at most twice as many pairs as rows. The list of a shingle that the sketch knows to be
   common is dealt over salts by node, so no task holds more than a share of it; the next two steps join
   the shares.
4. Pairs are made distinct and verified once: suffix filter, then the exact intersection.
5. Components of verified links. In lists whose rows are still in several components every row is paired
   with the few rows that stand in most lists: a text that many edited copies go back to shares all its
   shingles with some copy, a copy has shingles of its own.
6. Lists that are open even then give all their cross-component pairs: their rows are dealt into blocks by
   node, and every pair of blocks is a key of its own. Of lists with the same rows only the first in the
   global order is asked: a pair's first common shingle is never in a later one. A pair inside a component
   is not needed for the classes, so m near copies cost about m verifications, not m*m.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm import scratch
from palimpsest.llm.components import connected_components
from palimpsest.llm.memory import trimmed
from palimpsest.llm.wordhash import U64, fmix, row_shingles

N_WORDS = 5
THRESHOLD = Fraction(3, 4)
_CHUNK = 1 << 16
#: Set hashes that a task remembers, so that copies it meets again are not listed again.
_REMEMBER = 1 << 16


@dataclass(frozen=True)
class Settings:
    """Buckets of the count sketch as a power of two (4 MB when quantised, whatever the corpus size); rows of
    a list that one task takes; rows of a block of an open list; partners of one hub that a single sort group
    verifies; rows of an open list that all others are paired with before any exhaustive pairing; rows of the
    table of roles (40 bytes each) up to which it is broadcast instead of shuffling texts to it; most bits, as
    a power of two, of the filter that keeps documents without a candidate out of that shuffle; edges that
    one task turns into a forest. No setting changes a result."""

    sketch_bits: int = 22
    list_rows: int = 2048
    block_rows: int = 512
    hub_split: int = 256
    central: int = 4
    broadcast_roles: int = 1 << 20
    filter_bits: int = 26
    share: int = 200_000


def _set_hash(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little", signed=True)


def _survey(n: int, bits: int):
    """Per document: id, set size, set hash; at the end of a task the chunks of its count sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            ids, size, digest = batch.column(0).to_numpy(zero_copy_only=False), np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for r, s in row_shingles(batch.column(1), n):
                size[r] = len(s)
                digest[r] = _set_hash(s)
                np.add.at(counts, (s & U64((1 << bits) - 1)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(size), pa.array(digest), pa.nulls(len(size), pa.int32()), pa.nulls(len(size), pa.binary())], ["doc_id", "n", "node", "chunk", "counts"])
        if counts.any():
            blocks = [counts[i : i + _CHUNK].astype("<u4").tobytes() for i in range(0, 1 << bits, _CHUNK)]
            k = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.array(range(k), pa.int32()), pa.array(blocks, pa.binary())], ["doc_id", "n", "node", "chunk", "counts"])

    return run


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[k] = total.get(k, 0) + np.frombuffer(b, "<u4").astype(np.uint64)
    # a quarter-octave class of the count fits a byte and is all that the order needs
    quantised = [np.minimum(255, np.log2(v + 1.0) * 4).astype(np.uint8).tobytes() for v in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(quantised, pa.binary())], ["chunk", "classes"])


def _ceil(x: Fraction) -> int:
    return -((-x.numerator) // x.denominator)


def _salts(classes: np.ndarray, list_rows: int) -> np.ndarray:
    """Salts of a list by the count class of its shingle: shares of ``list_rows`` rows beyond what chance puts
    into every bucket of the sketch."""
    count = 2.0 ** (np.arange(256) / 4)
    chance = float((np.bincount(classes, minlength=256) * (count - 1)).sum() / max(1, len(classes)))
    return np.maximum(1, np.ceil((count - 1 - 4 * chance) / list_rows)).astype(np.int64)


def _prefixes(n: int, bits: int, classes, t: Fraction, list_rows: int):
    """Per set the rarest of its shingles: (shingle, salt, node, n, pos); salt -1: the list is not dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.frombuffer(classes.value, np.uint8)
        salts = _salts(rank, list_rows)
        num, den = t.numerator, t.denominator
        out: list[tuple] = []
        held = 0
        seen: set[int] = set()

        def flush():
            cols = [np.concatenate(x) for x in zip(*out, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["shingle", "salt", "node", "n", "pos"])

        for batch in batches:
            for _, s in row_shingles(batch.column(0), n):
                if not len(s):
                    continue
                node = _set_hash(s)
                if node in seen:
                    continue
                if len(seen) >= _REMEMBER:
                    seen.clear()
                seen.add(node)
                size = len(s)
                keep = size - -(-num * size // den) + 1
                # s is sorted, and the sort is stable: equal classes fall back to the hash
                rarity = rank[(s & U64((1 << bits) - 1)).astype(np.int64)]
                order = np.argsort(rarity, kind="stable")[:keep]
                dealt = salts[rarity[order]]
                salt = np.where(dealt > 1, int(fmix(np.array([node]).view(U64))[0] >> U64(1)) % dealt, -1).astype(np.int32)
                out.append((s[order].view(np.int64), salt, np.full(keep, node), np.full(keep, size, np.int32), np.arange(keep, dtype=np.int32)))
                held += keep
                if held > 1 << 16:
                    yield flush()
                    out, held = [], 0
        if out:
            yield flush()

    return run


def _groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[dict[str, np.ndarray]]:
    """Columns of whole groups of a stream sorted by ``keys``; only the last, open group is carried on."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        if held is not None:
            now = {c: np.concatenate([held[c], now[c]]) for c in now}
        if not len(now[keys[0]]):
            continue
        cut = int(_starts(*(now[k] for k in keys))[-1])
        held = {c: v[cut:] for c, v in now.items()}
        if cut:
            yield {c: v[:cut] for c, v in now.items()}
    if held is not None and len(held[keys[0]]):
        yield held


def _starts(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return new.nonzero()[0]


def _possible(na, pa_, nb, pb, t: Fraction, index: bool = True):
    """Length and positional filters for a pair whose first common prefix shingle is at pa_ and pb (na <= nb).

    The shorter set only needs its shorter index prefix.
    """
    num, den = t.numerator, t.denominator
    need = -(-num * (na.astype(np.int64) + nb) // (num + den))
    ok = (na.astype(np.int64) * den >= nb.astype(np.int64) * num) & (1 + np.minimum(na - pa_ - 1, nb - pb - 1) >= need)
    if index:
        ok &= pa_ <= na - -(-2 * num * na.astype(np.int64) // (num + den))
    return ok


def _hubs(t: Fraction):
    """Rows of lists with two nodes or more, and all of dealt lists, each with its hub: the first row of
    admissible length of its list, or of its share of a dealt one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        num, den = t.numerator, t.denominator
        for g in _groups(batches, "shingle", "salt"):
            once = _starts(g["shingle"], g["salt"], g["node"], g["n"])
            sh, salt, node, n, pos = (g[c][once] for c in ("shingle", "salt", "node", "n", "pos"))
            at = _starts(sh, salt)
            size = np.diff(np.append(at, len(sh)))
            many = np.repeat(size > 1, size) | (salt >= 0)
            if not many.any():
                continue
            sh, salt, node, n, pos = (c[many] for c in (sh, salt, node, n, pos))
            at = _starts(sh, salt)
            group = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(sh))))
            # rows of a list are sorted by n: the first with den * n_hub >= num * n
            hub = np.searchsorted(group * (1 << 32) + n, group * (1 << 32) + -(-num * n.astype(np.int64) // den))
            me = np.arange(len(sh))
            first = np.zeros(len(sh), bool)
            first[at] = True
            before = np.where(first, me, me - 1)
            near = ~first & _possible(n[before], pos[before], n, pos, t)
            far = (hub != me) & (hub != before) & _possible(n[hub], pos[hub], n, pos, t)
            with np.errstate(over="ignore"):
                family = np.add.reduceat(fmix(node.view(U64) + n.astype(U64)), at).view(np.int64)
            lead = pos[at]
            best = np.lexsort((lead, family))
            best = best[_starts(family[best])]
            keep = np.isin(group, best) | (salt >= 0)
            cols = [pa.array(sh), pa.array(salt), pa.array(node), pa.array(n), pa.array(pos), pa.array(node[before], mask=~near), pa.array(n[before], mask=~near), pa.array(node[hub], mask=~far), pa.array(n[hub], mask=~far), pa.array(family[group]), pa.array(lead[group])]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in cols], ["shingle", "salt", "node", "n", "pos", "before", "before_n", "hub", "hub_n", "family", "lead"])

    return run


_ROWS = "shingle bigint, salt int, node bigint, n int, pos int, before bigint, before_n int, hub bigint, hub_n int, family bigint, lead int"


def _cross(t: Fraction, step: int = 256):
    """Pairs of rows in different components that length and positional filters allow, from a stream of pairs of
    blocks of lists; two blocks meet each other, a block beside itself meets itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, "shingle", "low", "high"):
            node, n, pos, comp, mine = (g[c] for c in ("node", "n", "pos", "comp", "mine"))
            at = np.append(_starts(g["shingle"], g["low"], g["high"]), len(node))
            for i, j in zip(at[:-1], at[1:], strict=True):
                if j - i < 2 or (comp[i:j] == comp[i]).all():
                    continue
                apart = g["low"][i] != g["high"][i]
                for a in range(i, j, step):
                    x, y = np.arange(a, min(a + step, j))[:, None], np.arange(a + 1, j)[None, :]
                    # rows are sorted by size
                    ok = (x < y) & (comp[x] != comp[y]) & ((mine[x] != mine[y]) if apart else True)
                    x, y = ok.nonzero()
                    x, y = x + a, y + a + 1
                    ok = _possible(n[x], pos[x], n[y], pos[y], t)
                    x, y = x[ok], y[ok]
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(n[x]), pa.array(node[y]), pa.array(n[y])], ["hub", "hub_n", "node", "n"])

    return run


def _bitmap(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(1 << bits, bool)
        for batch in batches:
            on[_slot(batch.column(0).to_numpy(zero_copy_only=False), bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(on).tobytes()], pa.binary())], ["bits"])

    return run


def _or_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for b in batch.column(0).to_pylist():
            b = np.frombuffer(b, np.uint8)
            total = b.copy() if total is None else total | b
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["bits"])


def _slot(ids: np.ndarray, bits: int) -> np.ndarray:
    return (fmix(ids.astype(np.int64).view(U64)) >> U64(64 - bits)).astype(np.int64)


def _wanted(bitmap, bits: int):
    """Rows whose id may be wanted; a set bit by chance only lets a row too many through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.unpackbits(np.frombuffer(bitmap.value, np.uint8)).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(on[_slot(batch.column(0).to_numpy(zero_copy_only=False), bits)]))

    return run


def suffix_possible(a: np.ndarray, b: np.ndarray, need: int, parts: int = 16) -> bool:
    """Suffix filter: sets cut into ranges of the hash space share at most the sum of the smaller counts."""
    cut = np.array([(k << 64) // parts for k in range(1, parts)], U64)
    x = np.diff(np.concatenate([[0], np.searchsorted(a, cut), [len(a)]]))
    y = np.diff(np.concatenate([[0], np.searchsorted(b, cut), [len(b)]]))
    return int(np.minimum(x, y).sum()) >= need


def _verify(n: int, t: Fraction):
    """Stream sorted by (hub, salt, kind): the hub's text, then its partners'; yields links that hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        num, den = t.numerator, t.denominator
        hub_id, hub = None, None
        for batch in batches:
            ids, kinds, others = (batch.column(c).to_pylist() for c in ("hub", "kind", "doc_id"))
            found: list[tuple[int, int]] = []
            for r, s in row_shingles(batch.column("text"), n):
                if kinds[r] == 0:
                    hub_id, hub = ids[r], s
                    continue
                if ids[r] != hub_id:
                    raise ValueError("a partner came before its hub")
                both = len(hub) + len(s)
                need = -(-num * both // (num + den))
                if not suffix_possible(hub, s, need):
                    continue
                if len(np.intersect1d(hub, s, assume_unique=True)) >= need:
                    found.append((hub_id, others[r]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    return run


def _links(spark: SparkSession, docs: DataFrame, nodes: DataFrame, pairs: DataFrame, n: int, t: Fraction, s: Settings) -> DataFrame:
    """Verified links (u, v) between representatives; ``pairs`` has hub, hub_n, node, n."""
    a = nodes.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("rep").alias("a"))
    b = nodes.select("node", "n", F.col("rep").alias("b"))
    pairs = pairs.distinct().join(a, ["hub", "hub_n"]).join(b, ["node", "n"]).select("a", "b")
    pairs = scratch.materialise(pairs, "pairs")
    count = pairs.groupBy("a").agg(F.count("*").alias("c")).select("a", F.ceil(F.col("c") / s.hub_split).cast("int").alias("salts"))
    salted = pairs.join(count, "a").withColumn("salt", F.when(F.col("salts") > 1, F.pmod(F.xxhash64("b"), "salts")).otherwise(0).cast("int"))
    roles = salted.select(F.col("a").alias("hub"), "salt", F.lit(1).alias("kind"), F.col("b").alias("id")).unionByName(
        count.select(F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("a").alias("id"))
    )
    docs = docs.select(F.col("doc_id").alias("id"), "text")
    n_roles = pairs.count() * 2  # a role for every partner, and fewer for hubs
    if n_roles <= s.broadcast_roles:
        texts = docs.join(F.broadcast(roles), "id")
    else:
        bits = min(s.filter_bits, (8 * n_roles).bit_length())
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
        # of fixed size: a bitmap from each task, joined by shares before the last one
        maps = ids.mapInArrow(trimmed(_bitmap(bits)), "bits binary").repartition(16).mapInArrow(trimmed(_or_bitmaps), "bits binary")
        found = maps.repartition(1).mapInArrow(trimmed(_or_bitmaps), "bits binary").collect()
        sent = spark.sparkContext.broadcast(bytes(found[0][0]))
        texts = docs.mapInArrow(trimmed(_wanted(sent, bits)), docs.schema).join(roles, "id")
    parts = texts.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "kind")
    links = parts.select("hub", "kind", F.col("id").alias("doc_id"), "text").mapInArrow(trimmed(_verify(n, t)), "u bigint, v bigint")
    return scratch.materialise(links, "links")


def _open_rows(rows: DataFrame, by_node: DataFrame) -> DataFrame:
    """Rows of the lists that stand in several components, with their component and their list's size."""
    placed = scratch.materialise(rows.select("shingle", "node", "n", "pos").join(by_node, ["node", "n"]), "placed")
    lists = placed.groupBy("shingle").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count("*").alias("size"))
    return scratch.materialise(placed.join(lists.filter("least != most").select("shingle", "size"), "shingle"), "open_rows")


def _central_pairs(left: DataFrame, rows: DataFrame, t: Fraction, hubs: int) -> DataFrame:
    """Pairs of open lists' rows with the rows of other components, a few in each list, that stand in most lists."""
    num, den = t.numerator, t.denominator
    weight = rows.groupBy("node", "n").agg(F.count("*").alias("weight"))
    order = W.partitionBy("shingle").orderBy(F.desc("weight"), "n", "node")
    top = left.join(weight, ["node", "n"]).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= hubs)
    # ``_possible`` in terms of each row's shingles from its place on, and whether that place is in its index prefix.
    # Number by number: the code of compared structs, repeated for each use, takes the JVM's compiler 1.4 GB
    sides = [x.select("shingle", "node", "n", "comp", (F.col("n") - F.col("pos")).alias("rest"), F.expr(f"{2 * num} * n <= {num + den} * (n - pos)").alias("early")) for x in (left, top)]
    both = sides[0].join(sides[1].select("shingle", *(F.col(c).alias(f"{c}_h") for c in ("node", "n", "comp", "rest", "early"))), "shingle")
    first = "n < n_h OR (n = n_h AND node < node_h)"  # rows of two components are not of one node
    both = both.filter(f"comp != comp_h AND n * {den} >= n_h * {num} AND n_h * {den} >= n * {num} AND {num + den} * least(rest, rest_h) >= {num} * (n + n_h) AND if({first}, early, early_h)")
    return both.selectExpr(f"if({first}, node, node_h) AS hub", "least(n, n_h) AS hub_n", f"if({first}, node_h, node) AS node", "greatest(n, n_h) AS n")


def _cross_pairs(left: DataFrame, t: Fraction, block_rows: int) -> DataFrame:
    """All pairs of open lists' rows in different components."""
    blocks = left.withColumn("blocks", F.ceil(F.col("size") / block_rows).cast("int"))
    blocks = blocks.withColumn("mine", F.pmod(F.xxhash64("node", "n"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = blocks.select("shingle", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "node", "n", "pos", "comp")
    keyed = keyed.repartition("shingle", "low", "high").sortWithinPartitions("shingle", "low", "high", "n", "node")
    return keyed.mapInArrow(trimmed(_cross(t)), "hub bigint, hub_n int, node bigint, n int")


def _join_components(nodes: DataFrame, by_node: DataFrame, links: DataFrame, share: int) -> DataFrame:
    """The components of ``by_node`` after ``links``: a graph whose vertices are the components so far."""
    by_rep = nodes.join(by_node, ["node", "n"]).select("rep", "comp")
    ends = links.join(by_rep.select(F.col("rep").alias("u"), F.col("comp").alias("cu")), "u").join(by_rep.select(F.col("rep").alias("v"), F.col("comp").alias("cv")), "v")
    joined = connected_components(ends.select(F.col("cu").alias("u"), F.col("cv").alias("v")), share=share)
    now = by_node.join(joined.withColumnRenamed("u", "comp"), "comp", "left").select("node", "n", F.coalesce("component", "comp").alias("comp"))
    return scratch.materialise(now, "labels")


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N_WORDS, threshold: Fraction = THRESHOLD, settings: Settings = Settings()) -> DataFrame:
    """Classes of documents linked by shingle Jaccard similarity: doc_id, n_shingles, component_id, n_links.

    Words are maximal runs without ASCII white space, A-Z lower-cased. A text of fewer than ``n`` words has
    one shingle, all its words; null, empty and blank texts have none and link with nothing. Equal sets
    always link. ``component_id`` is the smallest id reachable by links; ``n_links`` counts the verified
    links that carry the class, each copy counting once. Rows with a null id are left out; repeated ids
    stay repeated rows of one class. Other columns are ignored, whatever their names. Shingles are compared
    by 64-bit hashes.
    """
    spark, s = docs.sparkSession, settings
    t = Fraction(threshold)
    docs = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    found = scratch.materialise(docs.mapInArrow(trimmed(_survey(n, s.sketch_bits)), "doc_id bigint, n int, node bigint, chunk int, counts binary"), "survey")
    info = found.filter("chunk is null").select("doc_id", "n", "node")
    nodes = info.filter("n > 0").groupBy("node", "n").agg(F.min("doc_id").alias("rep"))

    chunks = found.filter("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(trimmed(_sum_chunks), "chunk int, classes binary")
    table = np.zeros(1 << s.sketch_bits, np.uint8)
    for chunk, classes in chunks.collect():  # of fixed size
        table[chunk * _CHUNK : chunk * _CHUNK + len(classes)] = np.frombuffer(classes, np.uint8)
    sent = spark.sparkContext.broadcast(table.tobytes())

    prefixes = docs.select("text").mapInArrow(trimmed(_prefixes(n, s.sketch_bits, sent, t, s.list_rows)), "shingle bigint, salt int, node bigint, n int, pos int")
    lists = prefixes.repartition("shingle", "salt").sortWithinPartitions("shingle", "salt", "n", "node")
    rows = scratch.materialise(lists.mapInArrow(trimmed(_hubs(t)), _ROWS), "lists")
    # of lists with the same rows the first in the global order: it has a pair's first common shingle if any has
    whole = rows.filter("salt < 0").select("shingle", "family", "lead")
    dealt = rows.filter("salt >= 0").groupBy("shingle").agg(F.bit_xor(F.xxhash64("node", "n")).alias("family"), F.min_by("pos", F.struct("n", "node")).alias("lead"))
    best = whole.unionByName(dealt).groupBy("family").agg(F.min_by("shingle", F.struct("lead", "shingle")).alias("shingle"))
    rows = scratch.materialise(rows.join(best.select("shingle"), "shingle", "left_semi").drop("family", "lead"), "families")

    close = rows.filter("before is not null").select(F.col("before").alias("hub"), F.col("before_n").alias("hub_n"), "node", "n").distinct()
    tried = close.unionByName(rows.filter("hub is not null").select("hub", "hub_n", "node", "n").distinct())
    tried = scratch.materialise(tried.distinct(), "tried")
    links = _links(spark, docs, nodes, tried, n, t, s)
    labels = connected_components(links, share=s.share)
    by_node = nodes.join(labels.withColumnRenamed("u", "rep"), "rep", "left").select("node", "n", F.coalesce("component", "rep").alias("comp"))
    by_node = scratch.materialise(by_node, "labels")

    for emit in (lambda left: _central_pairs(left, rows, t, s.central), lambda left: _cross_pairs(left, t, s.block_rows)):
        left = _open_rows(rows, by_node)
        if left.isEmpty():
            break
        found = scratch.materialise(emit(left).distinct().join(tried, ["hub", "hub_n", "node", "n"], "left_anti"), "open_pairs")
        tried = tried.unionByName(found)
        more = _links(spark, docs, nodes, found, n, t, s)
        by_node = _join_components(nodes, by_node, more, s.share)
        links = links.unionByName(more)
    classes = nodes.join(by_node.withColumnRenamed("comp", "component"), ["node", "n"])
    degree = links.select(F.explode(F.array("u", "v")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    classes = classes.join(degree, "rep", "left").select("node", "n", "component", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = info.join(classes, ["node", "n"], "left")
    return out.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
