"""Vectorised words, word hashes and word shingles over Arrow batches (numpy only, no per-word Python).

All hashes are 64-bit, seeded by constants, and equal on every machine and in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_STEP = 1 << 18  # bytes hashed at once


def _splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=U64) + U64(seed)) * U64(0x9E3779B97F4A7C15)
        return fmix(z)


def fmix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U64(33))
        h = h * U64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> U64(33))
        h = h * U64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> U64(33))


_BYTE = _splitmix(256, 11)
_BASE = 0x5851F42D4C957F2D
_PLACE = _splitmix(64, 77) | U64(1)
_LENGTH = _splitmix(64, 99)
_pow = np.ones(1, U64)
_inv = np.ones(1, U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base modulo 2**64, and of its inverse."""
    global _pow, _inv
    if len(_pow) >= n:
        return _pow, _inv
    size = max(n, _STEP + 1)
    if size > _STEP + 1:  # for one very long word; not kept
        with np.errstate(over="ignore"):
            bases = (np.full(size, x, U64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
            return tuple(np.concatenate([[U64(1)], np.cumprod(b[1:], dtype=U64)]) for b in bases)
    if len(_pow) < n:
        with np.errstate(over="ignore"):
            a = np.full(size, _BASE, U64)
            a[0] = 1
            b = np.full(size, pow(_BASE, -1, 1 << 64), U64)
            b[0] = 1
            _pow, _inv = np.cumprod(a, dtype=U64), np.cumprod(b, dtype=U64)
    return _pow, _inv


#: White space between words: space and the control characters 9 to 13.
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[32, *range(9, 14)]] = True
#: All but letters, digits, underscore and bytes of other scripts.
NON_WORD = np.ones(256, bool)
NON_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = False
#: Lower case of A-Z only.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary or string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64 if large else np.int32, count=len(column) + 1 + column.offset)[column.offset :].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def slices(offs: np.ndarray, limit: int = _STEP) -> Iterator[tuple[int, int]]:
    """Ranges of rows that together hold about ``limit`` bytes; a longer row stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(buf: np.ndarray, offs: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; no word crosses rows."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~separator[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    before = np.zeros(len(buf), bool)
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.zeros(len(buf), bool)
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = np.empty(len(starts), U64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            base = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, base + _STEP, side="right")))
            power, inverse = powers(int(ends[j - 1] - base) + 1)
            part = buf[base : ends[j - 1]]
            total = np.zeros(len(part) + 1, U64)
            np.cumsum(_BYTE[part] * power[: len(part)], out=total[1:])
            a, b = starts[i:j] - base, ends[i:j] - base
            out[i:j] = fmix((total[b] - total[a]) * inverse[a] + (b - a).astype(U64))
            i = j
    return out


def shingles(word: np.ndarray, row: np.ndarray, n_rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles in order, and the bounds of each row's (length ``n_rows`` + 1).

    A row of fewer words has one shingle, its whole sequence; a row without words has none.
    """
    per = np.bincount(row, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(per)])[:-1]
    count = np.where(per >= n, per - n + 1, np.minimum(per, 1))
    bounds = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(bounds[-1], U64)
    with np.errstate(over="ignore"):
        m = max(0, len(word) - n + 1)
        total = np.zeros(m, U64)
        for k in range(n):
            total += word[k : k + m] * _PLACE[k]
        at = np.flatnonzero(row[:m] == row[n - 1 : n - 1 + m]) if m else np.zeros(0, np.int64)
        place = bounds[row[at]] + at - first[row[at]]
        out[place] = total[at] + _LENGTH[n]
        for r in np.flatnonzero((per > 0) & (per < n)):
            w = word[first[r] : first[r] + per[r]]
            out[bounds[r]] = (w * _PLACE[: len(w)]).sum(dtype=U64) + _LENGTH[len(w)]
    return fmix(out), bounds


def row_shingles(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for each row; words are cut at ASCII white space, A-Z count as a-z."""
    data, offs = binary_parts(column)
    for i, j in slices(offs):
        buf = ASCII_LOWER[data[offs[i] : offs[j]]]
        starts, ends, row = spans(buf, offs[i : j + 1] - offs[i], ASCII_SPACE)
        sh, bounds = shingles(hashes(buf, starts, ends), row, j - i, n)
        for r in range(j - i):
            part = np.sort(sh[bounds[r] : bounds[r + 1]])
            if len(part) > 1:
                part = part[np.concatenate([[True], part[1:] != part[:-1]])]
            yield i + r, part
