"""Token-id files: an adaptive context-mixing range coder in independently reset, checksummed blocks.

Every id is predicted by three models. Order 2 names the id that last followed the two ids before it, with
the length of its run of right guesses. Order 1 keeps the ids that most often followed the one before, with
counts. Both learn as they code. Order 0 is the share of each id in the segment, written once beside the list
of its ids. Their shares of the probability are mixed by weights that are learnt for each state of
confidence: the order-2 guess and the order-1 followers take their shares of one interval (an id that both
name gets the sum), and what is left belongs to order 0. One id is thus one step of the arithmetic coder, or
two where order 0 has to spell it. All arithmetic is on integers, so a file reads back on any machine.

Models and coder start anew in each block, which lets numpy code thousands of blocks side by side: one step
codes the t-th id of every block, and costs little more for many blocks than for few. Blocks are therefore
cut shorter, down to ``_SHORT`` ids, where a segment would have less than ``_LANES`` of them. A segment
(one row of the written table) holds whole documents, the sorted list of the ids in it with their shares, its
blocks and their CRC-32 sums, and can be read alone. Ids are any unsigned 32-bit integers.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm import scratch
from palimpsest.llm.memory import trimmed
from palimpsest.llm.wordhash import binary_parts, slices


@dataclass(frozen=True)
class Settings:
    """Tokenizer file (a path, or the name of a public vocabulary), id after each document, most ids of a block and
    (about) ids of a segment, chunks remembered by a worker, bytes of text tokenized at once."""

    tokenizer: str
    end_id: int = 0
    block: int = 16_384
    segment: int = 1 << 23
    remember: int = 690_000
    batch_bytes: int = 4 << 20


MAGIC = b"PTF4"
_TOP, _KEEP, _MASK = 62, 46, (1 << 62) - 1
#: Weights and shares add up to 1 << _SCALE.
_SCALE, _RATE = 15, 5
#: A follower is its count above the dense id of 24 bits.
_ID_BITS, _COUNT_CAP = 24, 100
_ONE, _ID = 1 << _ID_BITS, (1 << _ID_BITS) - 1
_FOLLOWERS = 3
_MIX1, _MIX2 = np.int32(0x2545F), np.int32(0x9E3B1)
#: Blocks that a segment is cut into if they have so many ids at least.
_LANES, _SHORT = 4096, 2048
#: Ids of blocks coded side by side.
_CELLS = 1 << 23
#: Steps between looks at the room left for coded digits, of which a step writes four at most.
_ROOM = 64

#: Four numbers taken and put at once: the followers of an id, and one that is not used.
_RECORD = np.dtype((np.void, 16))


def _confidence() -> np.ndarray:
    """By run of the guess, then total of the followers' counts: 1 / total in 65,536ths above the state (4 bits)."""
    run, total = np.arange(_COUNT_CAP + 1), np.arange(1 << _TOTAL_BITS)
    state = np.digitize(run, (1, 2, 4))[:, None] * 4 + np.digitize(total, (1, 2, 5))
    return (((1 << 16) // np.maximum(1, total) << 4) + state).astype(np.int32).ravel()


_TOTAL_BITS = (_FOLLOWERS * _COUNT_CAP).bit_length()
_CONFIDENCE = _confidence()


class _Model:
    """State of ``n`` blocks of at most ``longest`` ids side by side; those still open are the first ``k``."""

    def __init__(self, n: int, longest: int):
        bits = max(6, (longest - 1).bit_length())
        self.mask1, self.mask2 = np.int32((1 << bits - 2) - 1), np.int32((1 << bits - 1) - 1)
        # an empty place holds an id that no segment has, with a count of none
        self.one = np.full(n * 4 << bits - 2, _ID, np.int32).view(_RECORD)
        self.two = np.full(n << bits - 1, _ID, np.int32)
        # the followers' weight and the guess's
        self.weight = np.full(n * 16 * 2, 1 << (_SCALE - 2), np.int32).view(np.int64)
        # by context, then block: contexts that are frequent everywhere share lines of the cache and pages
        self.n, self.lane = np.int64(n), np.arange(n)
        self.prev, self.mixed = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.record, self.target = np.zeros((n, 4), np.int32), np.zeros((n, 2), np.int32)
        self.ends = np.zeros((6, n), np.int32)

    def predict(self, k: int):
        """(order-2 guess, followers' ids (3, k), ends of the intervals (6, k)) of the next id in every open block: the
        guess's, the followers' and that of order 0 lie between an end and the next."""
        a, lane = self.prev[:k], self.lane[:k]
        self.at1 = (a & self.mask1) * self.n
        self.at1 += lane
        self.at2 = ((a * _MIX1 + self.mixed[:k]) >> np.int32(3) & self.mask2) * self.n
        self.at2 += lane
        self.e1 = np.ascontiguousarray(self.one.take(self.at1).view(np.int32).reshape(k, 4).T[:_FOLLOWERS])
        self.e2 = self.two.take(self.at2)
        count = self.e1 >> _ID_BITS
        total = count[0] + count[1]
        total += count[2]
        run = self.e2 >> _ID_BITS
        sure = _CONFIDENCE.take((run << _TOTAL_BITS) + total)
        self.state = (sure & 15) * self.n
        self.state += lane
        self.weights = self.weight.take(self.state).view(np.int32).reshape(k, 2)
        sure >>= 4
        sure *= self.weights[:, 0]  # below 1 << 31
        sure >>= 8
        share = count
        share *= sure
        share >>= 8
        ids1, guess = self.e1 & _ID, self.e2 & _ID
        both = share * (ids1 == guess)
        share -= both
        if self.ends.shape[1] != k:
            self.ends = np.zeros((6, k), np.int32)
        ends = self.ends
        ends[5] = 1 << _SCALE
        mine = np.multiply(self.weights[:, 1], run > 0, out=ends[1])
        mine += both[0]
        mine += both[1]
        mine += both[2]
        np.add(mine, share[0], out=ends[2])
        np.add(ends[2], share[1], out=ends[3])
        np.add(ends[3], share[2], out=ends[4])
        return guess, ids1, ends

    def learn(self, k: int, x: np.ndarray, right: np.ndarray, m: np.ndarray) -> None:
        """Take ids ``x`` into the models; ``right`` and ``m``: where the guess and the followers name them."""
        known = m[0] | m[1]
        known |= m[2]
        fresh = x + np.int32(_ONE)
        target = self.target[:k]
        np.multiply(known > right, np.int32(1 << _SCALE), out=target[:, 0])
        np.multiply(right, np.int32(1 << _SCALE), out=target[:, 1])
        target -= self.weights
        target >>= _RATE
        target += self.weights
        self.weight[self.state] = target.view(np.int64).ravel()
        e1, record = self.e1, self.record[:k]
        e1 += m * np.int32(_ONE)
        last = np.where(known, e1[2], fresh)
        high = np.maximum(e1[1], last)
        np.minimum(e1[1], last, out=record[:, 2])
        np.minimum(e1[0], high, out=record[:, 1])
        np.maximum(e1[0], high, out=record[:, 0])
        full = (record[:, 0] >= _COUNT_CAP << _ID_BITS).nonzero()[0]
        if len(full):
            halved = record[full]
            record[full] = (halved >> (_ID_BITS + 1) << _ID_BITS) | (halved & _ID)
        self.one[self.at1] = record.view(_RECORD).ravel()
        grown = self.e2 + (self.e2 < _COUNT_CAP << _ID_BITS) * np.int32(_ONE)
        self.two[self.at2] = np.where(right, grown, fresh)
        np.multiply(self.prev[:k], _MIX2, out=self.mixed[:k])
        self.prev[:k] = x


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a // b`` of numbers from 0 whose quotients are small, without the slow division of whole numbers."""
    q = (a.astype(np.float64) / b.astype(np.float64)).astype(np.int64)
    rest = a - q * b  # without a sign a number below 0 is a large one
    return q if (rest.view(np.uint64) < b.view(np.uint64)).all() else a // b


def _frequencies(count: np.ndarray) -> np.ndarray:
    """Order-0 shares of ids that occur ``count`` times: whole numbers above 0 whose sum is a power of two."""
    v = len(count)
    total = 1 << max(16, v.bit_length() + 2)
    out = count.astype(np.int64) * (total - v) // max(1, int(count.sum())) + 1
    if v:
        out[out.argmax()] += total - int(out.sum())
    return out.astype(np.uint32)


def _encode_group(grid: np.ndarray, length: np.ndarray, longest: int, freq: np.ndarray) -> list[bytes]:
    """Coded columns of ``grid`` (steps x blocks); ``length`` may only fall."""
    steps, n = grid.shape
    m = _Model(n, longest)
    size0 = freq.astype(np.int64)
    first0 = np.cumsum(size0) - size0
    bits0 = int(size0.sum()).bit_length() - 1
    low, wide, lane = np.zeros(n, np.int64), np.full(n, 1 << _TOP, np.int64), np.arange(n)
    # digits by place, then block, as the blocks are at about the same place; what carries is kept above 16 bits
    out, pos = np.zeros((steps // 2 + 4 * _ROOM, n), np.int32), lane + n
    flat = out.reshape(-1)
    open_ = np.searchsorted(-length, -np.arange(steps), side="left").tolist()
    for t in range(steps):
        k = open_[t]
        if t % _ROOM == 0 and int(pos.max()) + 4 * _ROOM * n > out.size:
            out = np.concatenate([out, np.zeros((steps // 4 + 4 * _ROOM, n), np.int32)])
            flat = out.reshape(-1)
        x = grid[t, :k]
        guess, ids, ends = m.predict(k)
        hit, hits = guess == x, ids == x
        h = hits.view(np.int8)
        which = np.int8(4) - h[0] * np.int8(3) - h[1] * np.int8(2) - h[2]
        which *= ~hit
        at = which * np.int64(k)
        at += lane[:k]
        below = ends.take(at)
        at += k
        own = ends.take(at) - below
        none = (own == 0).nonzero()[0]  # named, but without a share
        if len(none):
            at[none] = none + 5 * k
            below[none] = ends[4].take(none)
            own[none] = (1 << _SCALE) - below[none]
        spelled = (at >= 5 * k).nonzero()[0]
        lo, wd = low[:k], wide[:k]
        wd >>= _SCALE
        lo += wd * below
        wd *= own
        if len(spelled):
            ids0 = x.take(spelled)
            unit = wd.take(spelled) >> bits0
            low[spelled] += unit * first0.take(ids0)
            wide[spelled] = unit * size0.take(ids0)
        m.learn(k, x, hit, hits)
        small = (wd < (1 << _KEEP)).nonzero()[0]
        while len(small):
            lo, q = low.take(small), pos.take(small)
            flat[q] = lo >> _KEEP
            low[small] = (lo & ((1 << _KEEP) - 1)) << 16
            pos[small] = q + n
            wider = wide.take(small) << 16
            wide[small] = wider
            small = small[wider < (1 << _KEEP)]
    for _ in range(4):  # within the room of the last look
        flat[pos] = low >> _KEEP
        low = (low & ((1 << _KEEP) - 1)) << 16
        pos += n
    rows = (pos // max(n, 1)).tolist()
    for q in range(max(rows, default=1) - 1, 0, -1):
        out[q - 1] += out[q] >> 16
        out[q] &= 0xFFFF
    digits = np.ascontiguousarray(out[: max(rows, default=1)].astype("<u2").T)
    return [digits[i, 1 : rows[i]].tobytes() for i in range(n)]


def _decode_group(blocks: list[bytes], length: np.ndarray, longest: int, freq: np.ndarray) -> np.ndarray:
    """The grid (steps x blocks) of a group of coded blocks."""
    n, steps = len(blocks), int(length[0])
    digits = np.zeros((n, max(map(len, blocks)) // 2 + 8), np.uint16)
    for i, b in enumerate(blocks):
        digits[i, : len(b) // 2] = np.frombuffer(b, "<u2")
    digits = np.ascontiguousarray(digits.T)
    m = _Model(n, longest)
    size0 = freq.astype(np.int64)
    first0 = np.cumsum(size0) - size0
    bits0 = int(size0.sum()).bit_length() - 1
    named0 = np.repeat(np.arange(len(freq), dtype=np.uint16 if len(freq) <= 1 << 16 else np.int32), size0)
    first4 = digits[:4].astype(np.int64)
    dif = (first4[0] << 46) | (first4[1] << 30) | (first4[2] << 14) | (first4[3] >> 2)
    # digits are 16 bits wide and the window 62: the end of a digit comes with the start of the next
    digits[:-1] = (digits[:-1] & 3) << 14 | digits[1:] >> 2
    flat, lane = digits.reshape(-1), np.arange(n)
    pos = lane + 3 * n
    wide = np.full(n, 1 << _TOP, np.int64)
    grid = np.zeros((steps, n), np.int32)
    open_ = np.searchsorted(-length, -np.arange(steps), side="left").tolist()
    names = np.zeros((5, n), np.int32)
    for t in range(steps):
        k = open_[t]
        if names.shape[1] != k:
            names = np.zeros((5, k), np.int32)
        guess, ids, ends = m.predict(k)
        names[0], names[1:4] = guess, ids
        df, wd = dif[:k], wide[:k]
        wd >>= _SCALE
        past = (_quotient(df, wd).astype(np.int32) >= ends[1:5]).view(np.int8)
        which = past[0] + past[1]
        which += past[2]
        which += past[3]
        spelled = (which == 4).nonzero()[0]
        at = which * np.int64(k)
        at += lane[:k]
        x, below = names.take(at), ends.take(at)
        at += k
        own = ends.take(at) - below
        df -= wd * below
        wd *= own
        if len(spelled):
            unit, left = wd.take(spelled) >> bits0, df.take(spelled)
            ids0 = named0.take(_quotient(left, unit))
            x[spelled] = ids0
            dif[spelled] = left - unit * first0.take(ids0)
            wide[spelled] = unit * size0.take(ids0)
        grid[t, :k] = x
        m.learn(k, x, guess == x, ids == x)
        small = (wd < (1 << _KEEP)).nonzero()[0]
        while len(small):
            q = pos.take(small)
            dif[small] = (dif.take(small) << 16) | flat.take(q)
            pos[small] = q + n
            wider = wide.take(small) << 16
            wide[small] = wider
            small = small[wider < (1 << _KEEP)]
    return grid


def _turned(x: np.ndarray) -> np.ndarray:
    """``x`` with its rows as columns, some at once so that memory is read along rows."""
    out = np.empty(x.shape[::-1], x.dtype)
    for i in range(0, len(x), 64):
        out[:, i : i + 64] = x[i : i + 64].T
    return out


def _groups(n: int, longest: int) -> Iterator[tuple[int, int]]:
    step = max(1, _CELLS // max(longest, 1))
    for i in range(0, n, step):
        yield i, min(i + step, n)


def encode_blocks(ids: np.ndarray, block: int, v: int, freq: np.ndarray | None = None) -> list[bytes]:
    """Coded blocks of ``block`` dense ids (below ``v``) each; the last may be shorter. ``freq``: order-0 shares of
    the ids, as ``_frequencies`` gives them; alike if left out."""
    freq = _frequencies(np.ones(v, np.int64)) if freq is None else freq
    n, longest = -(-len(ids) // block), min(block, len(ids))
    out: list[bytes] = []
    for i, j in _groups(n, longest):
        part = ids[i * block : j * block]
        length = np.full(j - i, block)
        length[-1] = len(part) - (j - i - 1) * block
        grid = part.astype(np.int32, copy=False)
        if len(part) < (j - i) * block:
            grid = np.concatenate([grid, np.zeros((j - i) * block - len(part), np.int32)])
        out += _encode_group(_turned(grid.reshape(j - i, block)[:, : length[0]]), length, block, freq)
    return out


def decode_blocks(blocks: list[bytes], length: np.ndarray, v: int, freq: np.ndarray | None = None, block: int | None = None) -> np.ndarray:
    """Dense ids of coded blocks with ``length`` ids each (lengths must not grow); ``block``: ids of a whole block,
    the first one's if left out."""
    freq = _frequencies(np.ones(v, np.int64)) if freq is None else freq
    parts = []
    for i, j in _groups(len(blocks), int(length[0]) if len(blocks) else 1):
        grid = _decode_group(blocks[i:j], length[i:j], block or int(length[0]), freq)
        parts += [_turned(grid[:, : j - i - 1]).reshape(-1), grid[: length[j - 1], -1]]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


_HEAD = "<4sIQIII"


def pack(ids: np.ndarray, block: int) -> bytes:
    """A segment's bytes: head (magic, block size, ids, blocks, distinct ids, bytes of their list), the list of the
    sorted distinct ids as differences and of their order-0 shares, deflated, and its CRC-32, then size and
    CRC-32 of each block, then the blocks. Blocks are shorter than ``block`` where a segment would have few."""
    if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= 1 << 32):
        raise ValueError("ids are unsigned 32-bit integers")
    if len(ids) and int(ids.max()) < 1 << 22:
        at = ids.astype(np.intp)
        count = np.bincount(at)
        known = count.nonzero()[0]
        place = np.zeros(int(known[-1]) + 1, np.int32)
        place[known] = np.arange(len(known))
        dense, count = place.take(at), count[known]
    else:
        known, dense, count = np.unique(ids, return_inverse=True, return_counts=True)
    if len(known) >= _ONE:
        raise ValueError(f"a segment holds {len(known)} distinct ids; fewer than {_ONE} can be coded")
    block = min(block, max(_SHORT, -(-len(ids) // _LANES)))
    freq = _frequencies(count)
    blocks = encode_blocks(dense.astype(np.int32, copy=False), block, len(known), freq)
    names = zlib.compress(np.diff(known.astype(np.int64), prepend=0).astype("<u4").tobytes() + freq.astype("<u4").tobytes())
    head = struct.pack(_HEAD, MAGIC, block, len(ids), len(blocks), len(known), len(names)) + names + struct.pack("<I", zlib.crc32(names))
    return head + b"".join(struct.pack("<II", len(b), zlib.crc32(b)) for b in blocks) + b"".join(blocks)


def unpack(data: bytes) -> np.ndarray:
    """Ids of a segment; a wrong magic or checksum raises ``ValueError``."""
    magic, block, n, count, distinct, listed = struct.unpack_from(_HEAD, data)
    if magic != MAGIC:
        raise ValueError("not a token file segment")
    at = struct.calcsize(_HEAD)
    names = data[at : at + listed]
    if zlib.crc32(names) != struct.unpack_from("<I", data, at + listed)[0]:
        raise ValueError("the list of ids does not match its checksum")
    table = at + listed + 4
    at, blocks = table + 8 * count, []
    for i in range(count):
        size, crc = struct.unpack_from("<II", data, table + 8 * i)
        blocks.append(data[at : at + size])
        at += size
        if zlib.crc32(blocks[-1]) != crc:
            raise ValueError(f"block {i} does not match its checksum")
    length = np.full(count, block)
    if count:
        length[-1] = n - (count - 1) * block
    listing = np.frombuffer(zlib.decompress(names), "<u4")
    known = np.cumsum(listing[:distinct], dtype=np.int64).astype(np.uint32)
    return known[decode_blocks(blocks, length, distinct, listing[distinct:], block)]


#: Texts that hold one of these go through the library whole: runs of white space, white space at an end, any but blank and line break.
_ODD = r"^[ \n]|[ \n]$|[ \n][ \n]|[\x09\x0B\x0C\x0D\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_BLANK, _BREAK = 32, 10
#: New chunks of one call to the library, whose speed falls with longer texts.
_CALL = 250
#: Kinds of bytes: blank 1, line break 2, one of ``.,;:!?`` 4, ASCII letter or digit 8.
_KINDS = bytes(1 if c == _BLANK else 2 if c == _BREAK else 4 if c in b".,;:!?" else 8 if c < 128 and chr(c).isalnum() else 0 for c in range(256))


class Tokenizer:
    """Byte-level BPE through the tokenizers library, with the ids of chunks remembered.

    A blank or line break between two non-blanks, and one of ``.,;:!?`` after an ASCII letter or digit, always
    start a new pre-token, so the ids of what lies between such places do not depend on the rest. Only chunks
    not seen before go through the library, many joined in one call: a blank, or the line break put before
    a chunk that has none, tells where each begins in the ids that come back.
    """

    def __init__(self, path: str, remember: int):
        import tokenizers

        if not os.path.exists(path):
            import public_tokenizers

            path = public_tokenizers.path(path)
        self.t = tokenizers.Tokenizer.from_file(path)
        special = sorted(x.content for x in self.t.get_added_tokens_decoder().values() if x.content)
        quoted = ["".join(c if c.isalnum() else "\\" + c if c.isascii() else c for c in x) for x in special]
        self.odd = "|".join([_ODD, *quoted])
        begins = [(i, s) for s, i in self.t.get_vocab(with_added_tokens=True).items()]
        self.blank = np.zeros(max(i for i, _ in begins) + 1, bool)
        self.blank[[i for i, s in begins if s.startswith("Ġ")]] = True
        self.newline = self._whole("\n")[0]
        self.remember = remember
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {b"\n": 0}
        self.start, self.size, self.ids, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.int32), 1
        self.ids[0], self.size[0] = self.newline, 1
        self.used = np.zeros(1 << 16, np.int32)

    def forget(self) -> None:
        """Keep the chunks that more than one batch had of late, the first half of what is remembered at most."""
        keep = np.append(0, (self.used[1 : len(self.at)] > 1).nonzero()[0] + 1)[: self.remember // 2]
        names, kept = list(self.at), keep.tolist()  # in the order of their numbers
        size, start, used = self.size[keep], self.start[keep], self.used[keep] >> 1
        ends = np.cumsum(size)
        ids = self.ids[np.arange(ends[-1]) + np.repeat(start - (ends - size), size)]
        self.clear()
        self.at = {names[k]: i for i, k in enumerate(kept)}
        self._room(len(keep), len(ids))
        self.start[: len(keep)], self.size[: len(keep)], self.used[: len(keep)] = ends - size, size, used
        self.ids[: len(ids)], self.n = ids, len(ids)

    def _room(self, chunks: int, ids: int) -> None:
        while chunks > len(self.start):
            self.start, self.size, self.used = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.used))
        while ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])

    def _whole(self, text: str) -> list[int]:
        return self.t.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, chunks: list[bytes], lead: bool) -> np.ndarray:
        """Numbers of new chunks, all of which begin with a blank or none."""
        texts = (chunks[i : i + _CALL] for i in range(0, len(chunks), _CALL))
        texts = (b"".join(part) if lead else b"\n" + b"\n".join(part) for part in texts)
        ids = np.concatenate([np.array(self._whole(text.decode()), np.int32) for text in texts])
        first = self.blank[ids] if lead else ids == self.newline
        begin = first.nonzero()[0]
        if len(begin) != len(chunks):
            raise ValueError("this vocabulary does not cut at blanks and line breaks")
        size = np.diff(np.append(begin, len(ids))) - (not lead)
        if not lead:
            ids = ids[~first]
        k = len(self.at)
        self._room(k + len(chunks), self.n + len(ids))
        self.ids[self.n : self.n + len(ids)] = ids
        self.start[k : k + len(chunks)] = self.n + np.cumsum(size) - size
        self.size[k : k + len(chunks)] = size
        self.n += len(ids)
        self.at.update(zip(chunks, range(k, k + len(chunks)), strict=True))
        return np.arange(k, k + len(chunks))

    def _find(self, names: list[bytes]) -> np.ndarray:
        """Numbers of chunks, -1 for those not known."""
        return np.fromiter(map(self.at.get, names, repeat(-1)), np.int64, len(names))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column without nulls, each with the end id, and the number of each text's."""
        n = len(texts)
        data, offs = binary_parts(texts)
        rows = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        whole = {r: np.array(self._whole(texts[r].as_py()), np.int32) for r in rows.nonzero()[0].tolist()}
        kind = np.frombuffer(data.tobytes().translate(_KINDS), np.uint8)
        cut = np.zeros(len(data) + 1, bool)
        cut[:-1] = (kind & 3) != 0
        cut[1:-1] |= ((kind[:-1] & 2) | ((kind[1:] << 1) & kind[:-1] & 8)) != 0
        for r in whole:
            cut[offs[r] : offs[r + 1]] = False
        full = (offs[1:] > offs[:-1]).nonzero()[0]
        cut[offs[full]] = True
        at = cut[:-1].nonzero()[0]
        bounds = np.append(at, len(data)).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        code, names = chunks.indices.to_numpy(), chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        letters, begins = binary_parts(chunks.dictionary)
        mine = {int(code[np.searchsorted(at, offs[r])]): ids for r, ids in whole.items() if offs[r + 1] > offs[r]}
        known = self._find(names)
        known[list(mine)] = 0
        if len(self.at) + np.count_nonzero(known < 0) > self.remember:
            self.forget()
            known = self._find(names)
            known[list(mine)] = 0
        missing = (known < 0).nonzero()[0]
        blank = letters[begins[missing]] == _BLANK
        for part, lead in ((missing[blank], True), (missing[~blank], False)):
            if len(part):
                known[part] = self._learn([names[i] for i in part.tolist()], lead)
        self.used[known] += 1
        start, size = self.start[known], self.size[known]
        pool, more = self.ids[: self.n], []
        top = self.n
        for i, ids in mine.items():
            start[i], size[i] = top, len(ids)
            top += len(ids)
            more.append(ids)
        pool = np.concatenate([pool, *more, np.array([end_id], np.int64).astype(np.uint32).view(np.int32)])
        # every text is followed by a chunk of its own, the end id
        per = np.bincount(np.searchsorted(offs, at, side="right") - 1, minlength=n) if len(at) else np.zeros(n, np.int64)
        ends = np.cumsum(per)
        start, size = np.insert(start[code], ends, top), np.insert(size[code], ends, 1)
        stop = np.cumsum(size)
        place = np.repeat(start - (stop - size), size)
        place += np.arange(len(place))
        ids = pool.take(place)
        last = np.append(0, stop)[ends + np.arange(1, n + 1)]
        return ids, np.diff(np.append(0, last))


_READY: dict[str, Tokenizer] = {}


def _tokenizer(s: Settings) -> Tokenizer:
    """This worker's tokenizer; it and its chunks outlive a task."""
    if s.tokenizer not in _READY:
        _READY.clear()
        _READY[s.tokenizer] = Tokenizer(s.tokenizer, s.remember)
    return _READY[s.tokenizer]


def _write(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        tokenizer = _tokenizer(s)
        docs, counts, ids, held, number = [], [], [], 0, 0

        def flush(part: int) -> pa.RecordBatch:
            data = pack(np.concatenate(ids).view(np.uint32), s.block)
            cols = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([docs], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["part", "segment", "doc_ids", "counts", "data"])

        part = 0
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for i, j in slices(binary_parts(texts)[1], s.batch_bytes):
                got, n = tokenizer.encode(texts[i:j], s.end_id)
                docs += keys[i:j]
                counts += n.tolist()
                ids.append(got)
                held += len(got)
                if held >= s.segment:
                    yield flush(part)
                    docs, counts, ids, held, number = [], [], [], 0, number + 1
        if docs:
            yield flush(part)

    return run


def _read(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, keys, counts, data in zip(*(batch.column(c).to_pylist() for c in ("start", "doc_ids", "counts", "data")), strict=True):
                ids = unpack(data).astype("<u4", copy=False)
                ends = np.cumsum(counts)
                crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), counts, strict=True)]
                n, starts = np.array(counts), start + ends - np.array(counts)
                # rows go out in batches of bounded size
                for i, j in slices(np.append(0, ends), 1 << 20):
                    out = {"doc_id": keys[i:j], "start": starts[i:j], "n_tokens": counts[i:j], "ids_crc32": crc[i:j]}
                    out = {name: pa.array(values, pa.int64()) for name, values in out.items()}
                    if with_ids:
                        base = int(ends[i] - n[i])
                        out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(base, ends[i:j]) - base, pa.int32()), pa.array(ids[base : ends[j - 1]].astype(np.int64)))
                    yield pa.RecordBatch.from_pydict(out)

    return run


def write_token_files(docs: DataFrame, path: str, settings: Settings, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all texts in ascending order of id to the folder ``path``, a table of segments.

    Null and empty texts are the end id alone. Rows with a null id come first; repeated ids stand one after
    another, ordered by a hash of their text and the text. Other columns are ignored. Every task writes a
    range of ids (rows of one id may be dealt over several), so the order needs no single writer.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").withColumn("part", F.spark_partition_id())
    out = rows.select("doc_id", "text", "part").mapInArrow(trimmed(_write(settings)), "part int, segment int, doc_ids array<bigint>, counts array<bigint>, data binary")
    out.write.parquet(path)


def read_token_files(docs_path: str, like: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids of every document in the folder; ``like`` gives the session."""
    segments = like.sparkSession.read.parquet(docs_path)
    size = segments.select("part", "segment", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    parts = size.groupBy("part").agg(F.sum("n").alias("total"))  # as many rows as there were tasks
    before = parts.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("before"))
    offsets = size.join(before, "part").select("part", "segment", (F.col("before") + F.sum("n").over(W.partitionBy("part").orderBy("segment")) - F.col("n")).alias("start"))
    rows = segments.join(offsets, ["part", "segment"]).select("start", "doc_ids", "counts", "data")
    columns = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    return rows.mapInArrow(trimmed(_read(with_ids)), f"{columns}, ids array<bigint>" if with_ids else columns)


def token_files_round_trip(docs: DataFrame, settings: Settings, with_ids: bool = False) -> DataFrame:
    """Write all texts' ids to the shared folder, and what reading the files back gives."""
    path = scratch.new_path(docs.sparkSession, "token_files")
    write_token_files(docs, path, settings)
    return read_token_files(path, docs, with_ids)
