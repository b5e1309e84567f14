"""Periodic runs of words, by heavy/light lag counting.

A run of period q and length L has L - q matching pairs of words q apart, so a lag can only be the period of a
run that counts if enough words match at it. Matches are counted for all lags of a document together: a word that
stands there often gives its share to every lag by FFT autocorrelation (whole numbers, so rounding is exact), a rarer
word by the differences of its places. Only lags with enough matches, those of shorter periods' runs taken off, are
scanned for islands, stretches of matches; an island counts if no divisor of the lag is a period of it already.

Documents are handled in slices of many at once; one of any length is handled whole, in memory linear in its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.columns import let
from palimpsest.llm.memory import trimmed
from palimpsest.llm.wordhash import ASCII_SPACE, binary_parts, hashes, slices, spans


@dataclass(frozen=True)
class Settings:
    """Least words of a run, and least periods in it; least frequency of a word whose lags are counted by FFT, and
    the share of n log2 n that its square must exceed; pairs of places counted at once."""

    least_words: int = 24
    least_periods: int = 3
    heavy: int = 64
    heavy_share: float = 0.25
    pairs: int = 1 << 20


Run = tuple[int, int, int]  # start, length, period


def lag_counts(word: np.ndarray, row: np.ndarray, per: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Matches at every lag from 1 to a third of each document's words, all documents' one after the other, and where
    each document's begin."""
    first = np.cumsum(per) - per
    most = per // s.least_periods
    base = np.concatenate([[0], np.cumsum(most)])
    counts = np.zeros(base[-1], np.int64)
    if not len(counts):
        return counts, base
    order = np.argsort(word, kind="stable")
    order = order[np.argsort(row[order].astype(np.uint16 if len(per) < 1 << 16 else np.int64), kind="stable")]
    doc, place = row[order], order - first[row[order]]
    new = np.ones(len(order), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (word[order[1:]] != word[order[:-1]])
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    n = per[doc[new]]
    heavy = (size > s.heavy) & (size.astype(float) ** 2 > s.heavy_share * n * np.log2(np.maximum(n, 2)))
    start = np.flatnonzero(new)
    for d in np.unique(doc[start[heavy]]).tolist():
        words = int(per[d])
        width = 1 << (words + int(most[d])).bit_length()  # no lag wraps round into one that is asked for
        power = np.zeros(width // 2 + 1)
        for g in np.flatnonzero(heavy & (doc[start] == d)).tolist():
            x = np.zeros(words)
            x[place[start[g] : start[g] + size[g]]] = 1.0
            f = np.fft.rfft(x, width)
            power += f.real**2 + f.imag**2
        counts[base[d] : base[d + 1]] = np.rint(np.fft.irfft(power, width)[1 : most[d] + 1]).astype(np.int64)
    left = np.flatnonzero(~heavy[group])
    held, waiting = [], 0
    for k in range(1, len(order)):
        left = left[left + k < len(order)]
        left = left[group[left + k] == group[left]]
        lag = place[left + k] - place[left]
        near = lag <= most[doc[left]]
        left, lag = left[near], lag[near]
        if len(left):
            held.append(base[doc[left]] + lag - 1)
            waiting += len(left)
        if held and (waiting > s.pairs or not len(left)):
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
            held, waiting = [], 0
        if not len(left):
            break
    if held:
        counts += np.bincount(np.concatenate(held), minlength=len(counts))
    return counts, base


def _prime_factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def islands(w: np.ndarray, q: int, least: int) -> list[tuple[int, int]]:
    """Stretches [start, end) of at least ``least`` places at which ``w`` equals itself ``q`` further on."""
    step = least // 8
    if step > 1:  # such a stretch covers eight multiples of step: first look at these alone
        some = w[: len(w) - q : step] == w[q::step]
        for shift in (1, 2, 4):
            some = some[:-shift] & some[shift:]
        if not some.any():
            return []
    same = np.zeros(len(w) - q + 2, np.int8)
    same[1:-1] = w[:-q] == w[q:]
    edge = np.diff(same)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = ends - starts >= least
    return list(zip(starts[keep].tolist(), ends[keep].tolist(), strict=True))


def runs_at(w: np.ndarray, counts: np.ndarray, s: Settings) -> list[Run]:
    """Runs by start, then period; ``counts`` are the matches at lags 1, 2, ...

    A run of period q matches at the multiples of q as well. No run of such a multiple as smallest period holds one of
    these pairs, nor do two runs of other periods share one, so they are taken off the counts before the multiple's turn.
    """
    counts, out = counts.copy(), []
    lag = np.arange(1, len(counts) + 1)
    least = np.maximum(np.maximum(s.least_words - lag, (s.least_periods - 1) * lag), 1)
    for q in lag[counts >= least].tolist():
        if counts[q - 1] < least[q - 1]:
            continue
        for i, j in islands(w, q, int(least[q - 1])):
            end = j + q
            if any(np.array_equal(w[i : end - q // p], w[i + q // p : end]) for p in _prime_factors(q)):
                continue
            out.append((i, end - i, q))
            multiples = np.arange(2 * q, min(end - i, len(counts) + 1), q)
            counts[multiples - 1] -= end - i - multiples
    return sorted(out, key=lambda r: (r[0], r[2]))


def _exact(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of words by their bytes."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(buf[a:b].tobytes(), len(seen)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)


def _holds(run: Run, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bool:
    i, n, q = run
    words = [buf[a:b].tobytes() for a, b in zip(starts[i : i + n].tolist(), ends[i : i + n].tolist(), strict=True)]
    return words[q:] == words[:-q]


def find_runs(buf: np.ndarray, offs: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, list[Run]]]:
    """Word bounds and documents of a slice, words of each document, and the runs of those that have any.

    Words are compared by 64-bit hashes; each run is then checked on the words themselves, and where two
    different words share a hash the document is searched again by words.
    """
    docs = len(offs) - 1
    starts, ends, row = spans(buf, offs, ASCII_SPACE)
    word = hashes(buf, starts, ends)
    per = np.bincount(row, minlength=docs)
    first = np.cumsum(per) - per
    counts, base = lag_counts(word, row, per, s)
    lag = np.arange(len(counts)) - np.repeat(base[:-1], np.diff(base)) + 1
    likely = np.flatnonzero(counts >= np.maximum(np.maximum(s.least_words - lag, (s.least_periods - 1) * lag), 1))
    of = np.searchsorted(base, likely, side="right") - 1
    found: dict[int, list[Run]] = {}
    for d in np.unique(of).tolist():
        part = slice(first[d], first[d] + per[d])
        matches = counts[base[d] : base[d + 1]]
        runs = runs_at(word[part], matches, s)
        if not all(_holds(r, buf, starts[part], ends[part]) for r in runs):
            word_of = _exact(buf, starts[part], ends[part])
            runs = runs_at(word_of, lag_counts(word_of, np.zeros(len(word_of), np.int64), per[d : d + 1], s)[0], s)
        if runs:
            found[d] = runs
    return starts, ends, row, per, found


def _kept_text(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, keep: np.ndarray, docs: int) -> pa.Array:
    """Each document's kept words joined by one space: their bytes and, but after the last, the byte that follows each."""
    a, b, row = starts[keep], ends[keep], row[keep]
    after = np.zeros(len(a), np.int64)
    after[:-1] = row[1:] == row[:-1]
    edge = np.zeros(len(buf) + 2, np.int8)
    np.add.at(edge, a, 1)
    np.add.at(edge, b + after, -1)
    let = np.cumsum(edge[: len(buf)], dtype=np.int8).astype(bool)
    text = buf.copy()
    text[b[after == 1]] = 32
    sizes = np.bincount(row, weights=b + after - a, minlength=docs).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return pa.LargeStringArray.from_buffers(docs, pa.py_buffer(bounds), pa.py_buffer(text[let]))


def _scan(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = binary_parts(batch.column("text"))
            for i, j in slices(offs):
                buf, inner = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                starts, ends, row, per, found = find_runs(buf, inner, s)
                first = np.cumsum(per) - per
                keep = np.ones(len(starts), bool)
                for d, runs in found.items():
                    for start, length, period in runs:
                        keep[first[d] + start + period : first[d] + start + length] = False
                flat = [r for d in sorted(found) for r in found[d]]
                sizes = np.zeros(j - i + 1, np.int32)
                for d, runs in found.items():
                    sizes[d + 1] = len(runs)
                fields = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
                struct = pa.StructArray.from_arrays(fields, ["start", "length", "period"])
                text = _kept_text(buf, starts, ends, row, keep, j - i).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(per, pa.int64()), pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), struct), text], ["doc_id", "n_words", "runs", "text"])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Each row's id (as doc_id), n_words, runs (structs of start, length, period, by start, then period) and text, the
    words that no run repeats joined by one space.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch of words with smallest period q, as long as it
    goes on, of at least ``least_words`` words and ``least_periods`` periods. Of each run all but its first q words go. A null
    text is empty: no words, no runs, empty text. Repeated rows and null ids come back as often as they are
    there. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(trimmed(_scan(settings)), f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, text string")


def strongest(runs: Column) -> Column:
    """The run with the most periods, compared exactly; of equal ones the first. Null without runs."""
    more = lambda best, r: r.length * best.period > best.length * r.period
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(more(best, r), r).otherwise(best))


def plant_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which a tenth of the documents, drawn by the CRC-32 of the id, say words again from some
    word on. A null id draws none."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def planted(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1))
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(w, lambda x, i: F.get(w, F.when(i >= a, a + (i - a) % p).otherwise(i))), " ")

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.when(h % 10 == 0, let(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), planted)).otherwise(text).alias("text"))
