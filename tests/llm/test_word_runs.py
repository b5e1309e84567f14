import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from palimpsest.llm import word_runs
from palimpsest.llm.queries import op13_periodic_runs
from palimpsest.llm.word_runs import Settings, find_runs, islands, lag_counts, periodic_runs

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(words):
    """Every stretch of every period, and none that a smaller period fills."""
    out, n = [], len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(24, 3 * q) and not any(words[i : i + length - p] == words[i + p : i + length] for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {k for i, n, q in runs for k in range(i + q, i + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def planted(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    return words


def noisy(rng, n, kinds=6):
    """Words with repeats in repeats, at the ends, broken and overlapping."""
    out = []
    while len(out) < n:
        unit = [rng.choice("abcdefgh") for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 8, 9, 12, 25]))]
        out += unit * rng.choice([1, 1, 2, 3, 5, 9, 30]) + unit[: rng.randint(0, len(unit))]
        out += [f"w{rng.randint(0, 10**kinds)}" for _ in range(rng.choice([0, 1, 5, 30]))]
    return out[: n + rng.randint(0, 9)]


@pytest.mark.parametrize("settings", [Settings(), Settings(heavy=2, heavy_share=0.0), Settings(heavy=10**9), Settings(pairs=10)])
def test_runs_equal_brute_force(settings):
    rng = random.Random(4)
    docs = [noisy(rng, n) for n in [*range(0, 60, 3), 150, 300, 700, *[200] * 30]] + [["x"] * n for n in (23, 24, 25, 200)] + [[], ["a", "b"] * 11, ["a", "b"] * 12]
    texts = [" ".join(d).encode() for d in docs]
    offs = np.cumsum([0, *(len(t) for t in texts)])
    *_, found = find_runs(np.frombuffer(b"".join(texts), np.uint8), offs, settings)
    for d, words in enumerate(docs):
        assert found.get(d, []) == brute(words), words
    assert sum(len(x) for x in found.values()) > 50


def test_heavy_and_light_counts_are_exact():
    rng = np.random.default_rng(1)
    w = (rng.zipf(1.3, 5000) % 500).astype(np.uint64)
    row, per = np.zeros(5000, np.int64), np.array([5000])
    counts, _ = lag_counts(w, row, per, Settings())
    assert counts.tolist() == [int((w[:-q] == w[q:]).sum()) for q in range(1, 5000 // 3 + 1)]


def test_islands_beside_the_coarse_look():
    rng = np.random.default_rng(2)
    for _ in range(300):
        q, least = int(rng.integers(1, 20)), int(rng.integers(1, 40))
        w = rng.integers(0, 2, int(rng.integers(q + 1, 120))).astype(np.uint64)
        same = "".join("1" if a == b else "0" for a, b in zip(w[:-q], w[q:]))
        assert islands(w, q, least) == [m.span() for m in re.finditer("1+", same) if m.end() - m.start() >= least]


def test_words_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(word_runs, "hashes", lambda buf, starts, ends: (ends - starts).astype(np.uint64))
    words = ["ab", "cd"] * 20 + ["ef"] * 30
    text = " ".join(words).encode()
    *_, found = find_runs(np.frombuffer(text, np.uint8), np.array([0, len(text)]), Settings())
    assert found[0] == [(0, 40, 2), (40, 30, 1)] == brute(words)


def rows_of(rng):
    texts = [None, "", " \t\n", "one", "é ü\x0b日本 " * 40, "\tlead  and\r\ntrail \n", " ".join(noisy(rng, 400)), "a b c " * 9 + "d"]
    rows = [(i, texts[i % len(texts)] if i % 3 else " ".join(noisy(rng, 90))) for i in range(120)]
    return rows + [(7, "same row " * 30)] * 3 + [(None, "x y " * 40), (None, None)]


def test_texts_runs_and_query(spark, tmp_path):
    rows = rows_of(random.Random(9)) + [(500, "long words " * 150_000 + "end"), (501, "z" * 2_000_000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, runs int, n_words string")
    got = sorted((repr(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.text) for r in periodic_runs(df.filter("doc_id is null or doc_id < 500")).collect())
    want = []
    for i, t in rows[:-2]:
        words = WORD.findall(t or "")
        runs = brute(words)
        want.append((repr(i), len(words), runs, collapsed(words, runs)))
    assert got == sorted(want)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = {}
    for r in op13_periodic_runs(spark, str(tmp_path)).collect():
        out.setdefault(r.doc_id, []).append(tuple(r)[1:])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for i, t in rows:
        words = planted(i, t)
        runs = brute(words) if len(words) < 10_000 else [(0, 300_000, 2)] if i == 500 else []
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (len(runs), *four, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(collapsed(words, runs))) in out[i], i


def test_empty_table(spark):
    assert periodic_runs(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
