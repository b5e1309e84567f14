"""SentencePiece encoding and decoding with sampled segmentations.

Pieces of a vocabulary span a lattice over a text. Forward filtering sums the weights of all paths to every
position; backward sampling then draws one path exactly from their distribution. The draws come from a hash
of the row's key, so a row's segmentation is the same in every run and on every machine.

No piece crosses the start of a run of blanks or a line break, so the lattice of a text falls apart into
chunks (blanks with the word after them) and each distinct chunk is filtered once a task. Sampling runs over
all chunks of a batch at once, one numpy step for each piece of the longest chunk.

Decoding concatenates the pieces' bytes. It returns every text exactly: blanks are pieces, what no piece
covers is spelled in byte pieces, and a literal U+2581 is spelled in bytes so that it stays itself.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.memory import trimmed
from palimpsest.llm.wordhash import U64, fmix, powers, slices

_BLANK, _MASKED = "▁", "\ud800"  # a lone surrogate stands for a literal U+2581 within a chunk
_CHUNK = re.compile(r"\n| *[^ \n]+| +")


@dataclass(frozen=True)
class Settings:
    """Vocabulary file, smoothing exponent of the piece weights, seed, and chunks remembered by a task.

    A merge-ranked vocabulary has no probabilities; weights follow Zipf's law over its ranks,
    (rank + 10) ** -alpha, and a byte piece has the least weight. Larger ``alpha``: fewer, longer pieces.
    """

    model: str
    alpha: float = 1.0
    seed: int = 1
    remember: int = 100_000


#: New chunks filtered at once; their edges, some hundreds of bytes a character, are the most that a task holds.
_TOGETHER = 4096

#: An id from here on stands for a character that its UTF-8 bytes spell.
_SPELLED = 1 << 21


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after another, and their bounds."""
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, "<u4"), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


class _Hasher:
    """64-bit hashes of all stretches of a length, by running sums."""

    def __init__(self, codes: np.ndarray):
        with np.errstate(over="ignore"):
            power, self.inverse = powers(len(codes) + 1)
            self.total = np.zeros(len(codes) + 1, U64)
            np.cumsum(fmix(codes.astype(U64) + U64(1)) * power[: len(codes)], out=self.total[1:])

    def of(self, start: np.ndarray, length: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return fmix((self.total[start + length] - self.total[start]) * self.inverse[start] + U64(length))


class Vocabulary:
    """Pieces of a SentencePiece model with byte fallback."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces: list[str] = []
        ids: list[int] = []
        self.byte = np.full(256, -1)
        raw: list[bytes] = []
        for k in range(sp.get_piece_size()):
            piece = sp.id_to_piece(k)
            if sp.is_byte(k):
                self.byte[int(piece[3:5], 16)] = k
                raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k):
                raw.append(b"")
            else:
                raw.append(piece.replace(_BLANK, " ").encode())
                if "\n" not in piece and _BLANK not in piece.lstrip(_BLANK):
                    pieces.append(piece)
                    ids.append(k)
        self.longest = max(map(len, pieces))
        self.size = np.array([len(b) for b in raw])
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        codes, bounds = _codes(pieces)
        h, length = np.empty(len(pieces), U64), np.diff(bounds)
        hasher = _Hasher(codes)
        for n in np.unique(length):
            h[length == n] = hasher.of(bounds[:-1][length == n], int(n))
        order = np.argsort(h)
        self.hash, self.id = h[order], np.array(ids, np.int32)[order]
        self.log_weight = -alpha * np.log(self.id + 10.0)
        self.likely = np.zeros(1 << 20, bool)
        self.likely[(h & U64((1 << 20) - 1)).astype(np.int64)] = True
        self.log_byte = -alpha * math.log(1e9)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the pieces, or -1."""
        out = np.full(len(h), -1)
        maybe = np.flatnonzero(self.likely[(h & U64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hash, h[maybe]), len(self.hash) - 1)
        hit = self.hash[at] == h[maybe]
        out[maybe[hit]] = at[hit]
        return out


class _Growing:
    def __init__(self, dtype):
        self.data, self.n = np.empty(1 << 12, dtype), 0

    def add(self, more: np.ndarray) -> None:
        while self.n + len(more) > len(self.data):
            self.data = np.concatenate([self.data, np.empty_like(self.data)])
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)


class _Lattices:
    """Filtered lattices of the chunks met so far, as flat arrays for sampling.

    State s has edges first[s] .. first[s + 1] - 1, each with the cumulated probability, the piece and the
    state it comes from; a chunk is sampled from its last state back to its first, which has no edges.
    """

    def __init__(self, vocabulary: Vocabulary, remember: int):
        self.v, self.remember = vocabulary, remember
        self.clear()

    def clear(self) -> None:
        self.last: dict[str, int] = {}
        self.first, self.cum, self.piece, self.back = _Growing(np.int64), _Growing(np.float32), _Growing(np.int32), _Growing(np.int32)
        self.first.add(np.zeros(1, np.int64))

    def add(self, chunks: list[str]) -> None:
        """Forward filtering of all new chunks at once, position by position."""
        v = self.v
        codes, bounds = _codes([c.replace(_BLANK, _MASKED).replace(" ", _BLANK) for c in chunks])
        n, sizes = len(codes), np.diff(bounds)
        chunk = np.repeat(np.arange(len(chunks)), sizes)
        ends = bounds[1:][chunk]
        hasher, at = _Hasher(codes), np.arange(n)
        start, length, place = [], [], []
        for k in range(1, v.longest + 1):
            at = at[at + k <= ends[at]]
            if not len(at):
                break
            found = v.find(hasher.of(at, k))
            hit = found >= 0
            if k == 1:
                bare = at[~hit]
            start.append(at[hit])
            length.append(np.full(int(hit.sum()), k))
            place.append(found[hit])
        start, length, place = np.concatenate(start), np.concatenate(length), np.concatenate(place)
        code = np.where(codes[bare] == ord(_MASKED), ord(_BLANK), codes[bare]).astype(np.int64)
        spelled = np.where(code < 128, v.byte[np.minimum(code, 127)], _SPELLED + code)
        utf8 = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        piece = np.concatenate([v.id[place], spelled]).astype(np.int32)
        weight = np.concatenate([v.log_weight[place], v.log_byte * utf8])
        start, length = np.concatenate([start, bare]), np.concatenate([length, np.ones(len(bare), np.int64)])

        # state of position p of a chunk: one more state than characters
        base = len(self.first.data[: self.first.n]) - 1
        source = start + chunk[start]
        target = source + length
        depth = start + length - bounds[:-1][chunk[start]]
        order = np.lexsort((target, depth))
        source, target, piece, weight, depth = source[order], target[order], piece[order], weight[order], depth[order]
        total = np.full(n + len(chunks), -np.inf)
        total[bounds[:-1] + np.arange(len(chunks))] = 0.0
        cum = np.empty(len(source))
        cut = np.searchsorted(depth, np.arange(1, (int(depth[-1]) if len(depth) else 0) + 2))
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if lo == hi:
                continue
            x = total[source[lo:hi]] + weight[lo:hi]
            heads = np.flatnonzero(np.concatenate([[True], target[lo + 1 : hi] != target[lo : hi - 1]]))
            count = np.diff(np.append(heads, hi - lo))
            top = np.maximum.reduceat(x, heads)
            x = np.exp(x - np.repeat(top, count))
            run = x.copy()
            for k in range(1, int(count.max())):
                has = heads[count > k] + k
                run[has] += run[has - 1]
            whole = run[heads + count - 1]
            cum[lo:hi] = run / np.repeat(whole, count)
            total[target[lo + heads]] = top + np.log(whole)
        order = np.argsort(target, kind="stable")
        per = np.bincount(target, minlength=n + len(chunks))
        begun = self.cum.n
        self.cum.add(cum[order])
        self.piece.add(piece[order])
        self.back.add((source[order] + base).astype(np.int32))
        self.first.add(begun + np.cumsum(per))
        self.last.update(zip(chunks, (bounds[1:] + np.arange(len(chunks)) + base).tolist(), strict=True))

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(x.data[: x.n] for x in (self.first, self.cum, self.piece, self.back))


def _uniform(key: np.ndarray, index: np.ndarray, step: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = fmix(key * U64(0x9E3779B97F4A7C15) + index.astype(U64) * U64(0xC2B2AE3D27D4EB4F) + U64((seed * 0x165667B19E3779F9 + step * 0x27D4EB2F165667C5) & (2**64 - 1)))
    return (h >> U64(11)).astype(np.float64) * 2.0**-53


def sample(texts: list[str], keys: np.ndarray, lattices: _Lattices, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts one after another, and the bounds of each text's."""
    chunks = [_CHUNK.findall(t) for t in texts]
    per = [len(c) for c in chunks]
    flat = list(chain.from_iterable(chunks))
    new = sorted(set(flat) - lattices.last.keys())
    for i in range(0, len(new), _TOGETHER):
        lattices.add(new[i : i + _TOGETHER])
    states = list(map(lattices.last.__getitem__, flat))
    first, cum, piece, back = lattices.arrays()
    row = np.repeat(np.arange(len(texts)), per)
    index = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(per)])[:-1].astype(np.int64), per)
    key = keys.astype(np.int64).view(U64)[row]
    state, open_ = np.array(states, np.int64), np.arange(len(row))
    count = np.zeros(len(row), np.int64)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    while len(open_):
        at = first[state]
        u = _uniform(key[open_], index[open_], len(steps), seed)
        more = np.flatnonzero(u >= cum[at])
        while len(more):
            at[more] += 1
            more = more[(u[more] >= cum[at[more]]) & (at[more] + 1 < first[state[more] + 1])]
        steps.append((open_, piece[at]))
        count[open_] += 1
        state = back[at]
        going = first[state] < first[state + 1]
        state, open_ = state[going], open_[going]
    end = np.cumsum(count)
    out = np.empty(end[-1] if len(end) else 0, np.int32)
    for k, (who, ids) in enumerate(steps):
        out[end[who] - 1 - k] = ids
    bounds = np.concatenate([[0], np.cumsum(np.bincount(row, weights=count, minlength=len(texts)))]).astype(np.int64)
    return _spell(out, bounds, lattices.v)


def _spell(ids: np.ndarray, bounds: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Byte pieces in place of characters that no piece covers."""
    at = np.flatnonzero(ids >= _SPELLED)
    if not len(at):
        return ids, bounds
    spelled = [chr(c - _SPELLED).encode() for c in ids[at].tolist()]
    size = np.ones(len(ids), np.int64)
    size[at] = [len(b) for b in spelled]
    end = np.cumsum(size)
    out = np.repeat(ids, size)
    for k, b in zip(at.tolist(), spelled, strict=True):
        out[end[k] - len(b) : end[k]] = v.byte[list(b)]
    return out, np.concatenate([[0], end])[bounds]


def _parts(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` in all; a larger row stands alone."""
    return slices(np.concatenate([[0], np.cumsum(sizes)]), limit)


def _encode(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = _Lattices(Vocabulary(s.model, s.alpha), s.remember)
        for batch in batches:
            texts, keys = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            for i, j in _parts(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), 1 << 19):
                ids, bounds = sample([t or "" for t in texts.slice(i, j - i).to_pylist()], keys[i:j], lattices, s.seed)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
                rest = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*rest.columns[:-2], lists], [*rest.schema.names[:-2], "ids"])
                if len(lattices.last) > s.remember:
                    lattices.clear()

    return run


def _decode(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(s.model, s.alpha)
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
            for i, j in _parts(lengths, 1 << 19):
                part = batch.slice(i, j - i)
                lists = part.column(part.num_columns - 1)
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                per = lengths[i:j].astype(np.int64)
                size = v.size[ids]
                end = np.cumsum(size)
                total = int(end[-1]) if len(end) else 0
                buf = v.bytes[np.arange(total) + np.repeat(v.start[ids] - (end - size), size)]
                bounds = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(per)])]
                texts = pa.Array.from_buffers(pa.string(), part.num_rows, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(buf.tobytes())])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts], [*part.schema.names[:-1], "decoded"])

    return run


def _both(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = _encode(s)(batches)
        twice = (pa.RecordBatch.from_arrays([*b.columns, b.column(b.num_columns - 1)], [*b.schema.names, "_ids"]) for b in encoded)
        yield from _decode(s)(twice)

    return run


def _carried(df: DataFrame, new: str) -> tuple[list[str], list, str]:
    kept = [c for c in df.columns if c.lower() != new]
    return kept, [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)], ", ".join(f"c{k} {df.schema[c].dataType.simpleString()}" for k, c in enumerate(kept))


def encode_pieces(docs: DataFrame, settings: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids``, the sampled pieces of the text, in place of any column of that name.

    Null and empty texts give an empty list. The key of a row's draws is its id (a null id counts as one
    key), so repeated rows get equal segmentations. All other columns are carried along.
    """
    kept, columns, types = _carried(docs, "ids")
    rows = docs.select(*columns, F.col(f"`{text_col}`").alias("_text"), F.xxhash64(F.col(f"`{id_col}`")).alias("_key"))
    out = rows.mapInArrow(trimmed(_encode(settings)), f"{types}, ids array<int>")
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(kept)), "ids")


def decode_pieces(encoded: DataFrame, settings: Settings, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text of ``ids_col``; a null or empty list gives an empty text."""
    kept, columns, types = _carried(encoded, "decoded")
    out = encoded.select(*columns, F.col(f"`{ids_col}`").alias("_ids")).mapInArrow(trimmed(_decode(settings)), f"{types}, decoded string")
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(kept)), "decoded")


def round_trip_pieces(docs: DataFrame, settings: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``ids`` and with ``decoded``, the text of these: both ways in one worker.

    Rows and nulls are treated as by ``encode_pieces`` and ``decode_pieces``.
    """
    kept, columns, types = _carried(docs.drop(text_col, "ids"), "decoded")
    rows = docs.select(*columns, F.col(f"`{text_col}`").alias("_text"), F.xxhash64(F.col(f"`{id_col}`")).alias("_key"))
    out = rows.mapInArrow(trimmed(_both(settings)), ", ".join(filter(None, (types, "ids array<int>, decoded string"))))
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(kept)), "ids", "decoded")
