import math
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import piece_lattice as L

MODEL = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
TEXTS = ["", "Hello  world\n\n tail ", "▁ literal ▁▁ and \U0001f600 ก x", "a" * 300, " lead\ttab\r\nend", "Ünïcödé ünïcödé", None, "same text", "same text"]


def test_round_trip_and_reproducible(spark):
    s = L.Settings(MODEL)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string").selectExpr("*", "1 AS ids", "2 AS c0", "3 AS _text")
    rows = {n: {r.doc_id: (list(r.ids), r.decoded) for r in L.decode_pieces(L.encode_pieces(df.repartition(n), s), s).collect()} for n in (1, 4)}
    assert rows[1] == rows[4]
    assert all(rows[1][i][1] == (t or "") for i, t in enumerate(TEXTS))
    both = {r.doc_id: (list(r.ids), r.decoded, r.c0) for r in L.round_trip_pieces(df.repartition(3), s).collect()}
    assert both == {i: (*x, 2) for i, x in rows[1].items()}
    assert L.encode_pieces(df.limit(0), s).count() == L.round_trip_pieces(df.limit(0), s).count() == 0


def test_very_long_texts_and_runs_and_repeated_ids(spark):
    s = L.Settings(MODEL, remember=50)
    texts = ["word of many, " * 60_000, "x" * 20_000, None, "", "same", "same"]
    df = spark.createDataFrame([(None if k > 3 else k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    got = L.round_trip_pieces(df, s).collect()
    assert sorted(r.decoded for r in got) == sorted(t or "" for t in texts)
    assert len({tuple(r.ids) for r in got if r.decoded == "same"}) == 1


def test_sampling_follows_the_lattice():
    """Frequencies of a word's segmentations against their exact probabilities by enumeration."""
    v = L.Vocabulary(MODEL, 0.3)
    weights, ids = {}, {}
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for k in range(sp.get_piece_size()):
        if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k)):
            ids[sp.id_to_piece(k)] = k
            weights[sp.id_to_piece(k)] = (k + 10.0) ** -0.3
    word = "▁water"

    def paths(i):
        if i == len(word):
            return [((), 1.0)]
        return [((ids[word[i:j]], *p), w * weights[word[i:j]]) for j in range(i + 1, len(word) + 1) if word[i:j] in ids for p, w in paths(j)]

    exact = Counter()
    for p, w in paths(0):
        exact[p] += w
    total, n = sum(exact.values()), 20_000
    out, bounds = L.sample([" water"] * n, np.arange(n), L._Lattices(v, 100), 5)
    seen = Counter(tuple(out[bounds[i] : bounds[i + 1]].tolist()) for i in range(n))
    assert set(seen) <= set(exact)
    for p, w in exact.items():
        q = w / total
        assert abs(seen[p] / n - q) < 5 * math.sqrt(q * (1 - q) / n) + 1e-3
