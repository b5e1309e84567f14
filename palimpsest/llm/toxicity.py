"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training follows McMahan et al. (2013): per-coordinate learning rates, L1 for exact zeros, one example at a
time, on a bounded sample of labelled rows. What leaves the training task is the list of non-zero weights,
small enough to broadcast; scoring is one pass over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.memory import trimmed
from palimpsest.llm.wordhash import NON_WORD, U64, binary_parts, fmix, hashes, slices, spans

_KINDS = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93], U64)


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` and ``sample_bytes`` bound the labelled rows that a model is fitted on: rows are drawn until
    their texts reach that many bytes. All else holds for every row."""

    bits: int = 20
    sample_rows: int = 20_000
    sample_bytes: int = 128 << 20
    epochs: int = 4
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.0


def _features(column: pa.Array, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, feature, row) of words, word pairs and pairs around one word, in slices."""
    data, offs = binary_parts(column)
    for i, j in slices(offs):
        buf = data[offs[i] : offs[j]]
        starts, ends, row = spans(buf, offs[i : j + 1] - offs[i], NON_WORD)
        w = hashes(buf, starts, ends)
        found, rows = [fmix(w ^ _KINDS[0])], [row]
        with np.errstate(over="ignore"):
            for gap in (1, 2):
                if len(w) > gap:
                    same = row[:-gap] == row[gap:]
                    found.append(fmix(w[:-gap] * _KINDS[gap] + fmix(w[gap:]))[same])
                    rows.append(row[:-gap][same])
        yield i, j, (np.concatenate(found) >> U64(64 - bits)).astype(np.int64), np.concatenate(rows)


def fit(examples: Iterator[tuple[np.ndarray, int]] | list, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the non-zero weights; index 2**bits is the intercept."""
    examples = list(examples)
    z, n = np.zeros((1 << s.bits) + 1), np.zeros((1 << s.bits) + 1)
    one = 1 << s.bits

    def weights(f):
        zf = z[f]
        w = -(zf - np.sign(zf) * s.l1) / ((s.beta + np.sqrt(n[f])) / s.alpha + s.l2)
        return np.where(np.abs(zf) <= s.l1, 0.0, w)

    def intercept():
        return -z[one] / ((s.beta + np.sqrt(n[one])) / s.alpha)

    for _ in range(s.epochs):
        for f, y in examples:
            w, b = weights(f), intercept()
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
            root = np.sqrt(n[f])
            z[f] += g - (np.sqrt(n[f] + g * g) - root) / s.alpha * w
            n[f] += g * g
            z[one] += g - (np.sqrt(n[one] + g * g) - np.sqrt(n[one])) / s.alpha * b
            n[one] += g * g
    w = weights(np.arange(one))
    at = np.flatnonzero(w)
    return np.append(at, one), np.append(w[at], intercept())


def _train(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples, taken = [], 0
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
            kept = int((taken + np.cumsum(sizes) - sizes < s.sample_bytes).sum())
            taken += int(sizes.sum())
            if not kept:
                continue
            batch = batch.slice(0, kept)
            y = batch.column("toxic").to_pylist()
            for i, j, f, row in _features(batch.column("text"), s.bits):
                order = np.argsort(row, kind="stable")
                cut = np.searchsorted(row[order], np.arange(j - i + 1))
                f = f[order].astype(np.int32)
                examples += [(np.unique(f[cut[r] : cut[r + 1]]), y[i + r]) for r in range(j - i)]
        at, w = fit(examples, s) if examples else (np.array([1 << s.bits]), np.array([0.0]))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], ["feature", "weight"])

    return run


def _score(sent, s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = (np.frombuffer(x, t) for x, t in zip(sent.value, ("<i8", "<f8"), strict=True))
        table = np.zeros(1 << s.bits)
        table[at[:-1]] = w[:-1]
        one = 1 << s.bits
        for batch in batches:
            logit = np.full(batch.num_rows, w[-1])
            for i, j, f, row in _features(batch.column("text"), s.bits):
                hit = np.flatnonzero(table[f])
                pair = np.unique(row[hit] * one + f[hit])  # a feature counts once a text
                logit[i:j] += np.bincount(pair // one, weights=table[pair % one], minlength=j - i)
            score = 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], [*batch.schema.names[:-1], "score"])

    return run


def held_out(doc_id: Column) -> Column:
    """The rows that no model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train_toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[bytes, bytes]:
    """Indices and values of the non-zero weights, as bytes.

    ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic) may hold nulls: unlabelled rows are left out, a
    null text is an empty one. Of a doc_id labelled more than once the larger label counts. Held-out rows
    are never used. About ``sample_rows`` rows are drawn by the hash of their id, and of these, in the order of
    that hash, as many as begin within ``sample_bytes``. Rows of one id are ordered by their text.
    """
    rows = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = F.xxhash64("doc_id", F.lit("sample"))
    count = rows.count()
    if count > settings.sample_rows:
        rows = rows.filter(F.pmod(order, F.lit(1 << 20)) < int((1 << 20) * settings.sample_rows / count))
    rows = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).cast("binary").alias("text")).join(rows, "doc_id")
    rows = rows.withColumn("draw", order).repartition(1).sortWithinPartitions("draw", "doc_id", "text").select("toxic", "text")
    found = sorted(rows.mapInArrow(trimmed(_train(settings)), "feature bigint, weight double").collect()) or [(1 << settings.bits, 0.0)]
    return np.array([r[0] for r in found], "<i8").tobytes(), np.array([r[1] for r in found], "<f8").tobytes()


def score_toxicity(docs: DataFrame, model: tuple[bytes, bytes], settings: Settings = Settings(), text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``score`` (0 to 1) in place of any it had; null and empty texts get the intercept's."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() != "score"]
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)), F.lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary").alias("text"))
    types = ", ".join(f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(kept))
    out = rows.mapInArrow(trimmed(_score(sent, settings)), f"{types}, score double")
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(kept)), "score")
