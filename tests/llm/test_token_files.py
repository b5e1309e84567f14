import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import token_files as T

PATH = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
TEXTS = ["", None, "  a  b\n\n c ", "x<|endoftext|>y", " a b c", "trail ", "a\tb", "l\n m", "one line\nand another", "Ünïcödé \U0001f600 it's we'll 12345"]


def test_coder_round_trip_and_checksums():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 511, 512, 513, 5000):
        for ids in (rng.integers(0, 50257, n), np.minimum(50256, rng.zipf(1.3, n)), np.zeros(n, int), np.tile([7, 8, 9], n)[:n]):
            assert (T.unpack(T.pack(ids, 256)) == ids).all()
    data = T.pack(rng.integers(0, 50257, 600), 256)
    for at in (-3, 40):  # a block's byte, and one of the list of ids
        spoiled = bytearray(data)
        spoiled[at] ^= 1
        with pytest.raises(ValueError):
            T.unpack(bytes(spoiled))
    repeated = np.tile(rng.integers(0, 50257, 50), 100)
    assert len(T.pack(repeated, 2500)) < len(repeated)  # contexts are learnt


def test_any_unsigned_32_bit_id_and_no_other():
    ids = np.array([0, 200_000, (1 << 32) - 1, 1 << 31, 200_000] * 40)
    assert (T.unpack(T.pack(ids, 64)) == ids).all()
    for bad in (-1, 1 << 32):
        with pytest.raises(ValueError):
            T.pack(np.array([bad]), 64)


def test_all_new_ids_fit_the_room_for_digits():
    ids = np.random.default_rng(1).permutation(60_000)
    data = T.pack(ids, 16_384)
    assert (T.unpack(data) == ids).all()
    assert len(data) < 8 * len(ids)


def test_small_segments_have_many_blocks_that_know_the_segments_shares():
    rng = np.random.default_rng(5)
    ids = rng.choice(3_000, 100_000, p=(w := 1 / np.arange(1, 3_001)) / w.sum())
    data = T.pack(ids, 16_384)
    _, block, n, blocks, *_ = T.struct.unpack_from(T._HEAD, data)
    assert (n, block, blocks) == (100_000, 2_048, 49)  # 7 blocks of 16,384 took as many steps as 8 times the ids
    share = np.bincount(ids)[np.unique(ids)] / n
    assert 8 * len(data) / n < 1.06 * -(share * np.log2(share)).sum()  # random: nothing to learn but shares
    assert (T.unpack(data) == ids).all()
    for v in (1, 3, 70_000):
        freq = T._frequencies(rng.integers(1, 1 << 40, v))
        assert freq.min() > 0 and int(freq.sum()).bit_count() == 1


def test_blocks_are_coded_alike_alone_and_side_by_side(monkeypatch):
    ids = np.minimum(800, np.random.default_rng(2).zipf(1.2, 5_000)).astype(np.int32)
    together = T.encode_blocks(ids, 1_000, 801)
    assert together == [T.encode_blocks(ids[i : i + 1_000], 1_000, 801)[0] for i in range(0, 5_000, 1_000)]
    monkeypatch.setattr(T, "_CELLS", 2 * 801)  # two blocks at once
    assert T.encode_blocks(ids, 1_000, 801) == together
    assert (T.decode_blocks(together, np.full(5, 1_000), 801) == ids).all()


def test_beats_order_0_entropy_and_plain_deflate_on_texts(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(400).select("text").collect()]
    ids, n = T.Tokenizer(PATH, 400_000).encode(pa.array(texts), 0)
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    bits = 8 * len(T.pack(ids.view(np.uint32), T.Settings(PATH).block)) / len(ids)
    print(f"{bits:.2f} bits an id; order-0 entropy {-(share * np.log2(share)).sum():.2f}, deflate {8 * len(zlib.compress(ids.astype('<u2').tobytes())) / len(ids):.2f}")
    assert bits < -(share * np.log2(share)).sum()
    assert bits < 8 * len(zlib.compress(ids.astype("<u2").tobytes())) / len(ids)
    assert n.sum() == len(ids)


def test_chunks_join_to_the_ids_of_whole_texts():
    t, rng = T.Tokenizer(PATH, 60), random.Random(3)
    parts = [" ", "\n", "a", "b", "'s", "'", ".", ",", "é", "…", "1", "<|endoftext|>", "\t", "  ", " ", "ß", "!?", "我", "\u0085", ""]
    for _ in range(60):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(20)] + ["ab, " * 2_000]
        ids, n = t.encode(pa.array(texts), 7)
        want = [[*t.t.encode(x, add_special_tokens=False).ids, 7] for x in texts]
        assert n.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def test_chunks_of_many_batches_outlast_full_memory():
    t = T.Tokenizer(PATH, 200)
    often = " ".join(f"often{i}" for i in range(50))
    for k in range(12):
        text = often + " " + " ".join(f"once{k}x{i}" for i in range(60))
        ids, _ = t.encode(pa.array([text]), 0)
        assert ids.tolist() == [*t.t.encode(text, add_special_tokens=False).ids, 0]
        assert len(t.at) <= 200
        if k > 1:
            assert sum(b"often" in c for c in t.at) == 50
    t.forget()
    assert sum(b"often" in c for c in t.at) == 50 and not any(b"once" in c for c in t.at)


def test_equals_the_library(spark):
    import tokenizers

    library, start, want = tokenizers.Tokenizer.from_file(PATH), 0, []
    long = "long text, " * 90_000
    rows = [(i * 3 - 5, t) for i, t in enumerate(TEXTS * 3)] + [(200, long)]
    for i, t in sorted(rows):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS part", "2 AS start").repartition(3)
    got = T.token_files_round_trip(df, T.Settings(PATH, segment=64, block=16, remember=5))
    assert sorted(tuple(r) for r in got.collect()) == want
    with_ids = T.token_files_round_trip(df, T.Settings(PATH.split("/")[-1]), with_ids=True)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in with_ids.collect())
    assert T.token_files_round_trip(df.limit(0), T.Settings(PATH)).count() == 0


def test_repeated_and_null_ids_are_rows_of_their_own(spark):
    df = spark.createDataFrame([(None, "b"), (4, "x y"), (4, "x y"), (4, None), (None, "a"), (1, "q")], "doc_id bigint, text string")
    got = T.token_files_round_trip(df, T.Settings(PATH)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 1, 4, 4, 4]
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()


def test_quotients_are_those_of_whole_numbers():
    rng = np.random.default_rng(7)
    b = rng.integers(1 << 31, 1 << 47, 20_000)
    q = rng.integers(0, 1 << 15, 20_000)
    for rest in (np.zeros_like(b), b - 1, rng.integers(0, b)):  # no part is left, all but one, any
        assert (T._quotient(q * b + rest, b) == q).all()
    last = np.array([(1 << 47) - 1])
    assert T._quotient(last * (1 << 15) - 1, last).tolist() == [(1 << 15) - 1]  # as fractions they are alike


def test_large_segments_are_coded_in_more_lanes_and_turned_whole():
    ids = np.random.default_rng(8).integers(0, 40, 5_000_003)
    data = T.pack(ids, 16_384)
    _, block, n, blocks, *_ = T.struct.unpack_from(T._HEAD, data)
    assert (n, block, blocks) == (5_000_003, 2_048, 2_442)  # before 2,048 lanes of 2,442 ids
    assert (T.unpack(data) == ids).all()
    for shape in ((0, 3), (1, 1), (64, 5), (130, 7)):
        x = np.arange(shape[0] * shape[1]).reshape(shape)
        assert (T._turned(x) == x.T).all()


def test_states_of_confidence_and_shares_stay_in_32_bits():
    table = T._CONFIDENCE.reshape(T._COUNT_CAP + 1, -1)
    assert table.shape[1] > T._FOLLOWERS * T._COUNT_CAP
    assert [int(table[run, total] & 15) for run, total in ((0, 0), (0, 1), (1, 4), (3, 5), (100, 300))] == [0, 1, 6, 11, 15]
    assert int((table >> 4).max()) * ((1 << T._SCALE) - 1) < 1 << 31
    ids = np.tile(np.random.default_rng(9).integers(0, 5, 300), 40)  # counts and runs reach their caps
    assert (T.unpack(T.pack(ids, 16_384)) == ids).all()
    assert (T.unpack(T.pack(np.zeros(3_000, int), 16_384)) == 0).all()


def test_digests_carry_no_ids(spark):
    rows = pa.RecordBatch.from_pydict({"start": [7], "doc_ids": [[1, 2]], "counts": [[2, 1]], "data": [T.pack(np.array([5, 6, 0]), 16)]})
    (plain,), (full,) = list(T._read(False)([rows])), list(T._read(True)([rows]))
    assert plain.schema.names == ["doc_id", "start", "n_tokens", "ids_crc32"] and plain.column("start").to_pylist() == [7, 9]
    assert full.column("ids").to_pylist() == [[5, 6], [0]] and full.select(plain.schema.names) == plain
