import math

import numpy as np

from palimpsest.llm.product_topk import Best, Settings, _cut, exact_products, search, top_products


def expected(rows, k, asked=None, every=100):
    """Brute force in Python integers."""
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            vectors[i] = max(vectors.get(i, v), v)
    dims = len(vectors[min(vectors)])
    vectors = {i: [math.floor(1024 * x) for x in v] for i, v in vectors.items() if len(v) == dims}
    out = []
    for q in asked if asked is not None else [i for i in vectors if i % every == 0]:
        score = lambda v: max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(vectors[q], v))))
        best = sorted((-score(v), i) for i, v in vectors.items() if i != q)[:k]
        out += [(q, n, i, -x) for n, (x, i) in enumerate(best, 1)]
    return sorted(out)


def found(df, **options):
    return sorted(map(tuple, top_products(df, **options).collect()))


def frame(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").selectExpr("*", "1 AS v", "2 AS shard", "'x' AS length")


def test_against_brute_force_with_edges(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 12)) * rng.gamma(1.0, 1.0, (1500, 1))
    x[300:600] = x[300]  # copies
    x[600:610] = 0.0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[9].tolist()), (5, x[9].tolist())]
    rows += [(2000, None), (2100, [math.nan] * 12), (2200, [None] * 12), (2300, [1.0]), (None, [1.0] * 12), (2400, [-math.inf] * 12), (2500, []), (-100, x[0].tolist())]
    small = Settings(shard_rows=200, bucket_rows=32, head_rows=50, block_rows=8)
    assert found(frame(spark, rows), settings=small) == expected(rows, 10)
    assert found(frame(spark, rows), settings=Settings(k=3)) == expected(rows, 3)


def test_negative_products_and_few_candidates(spark):
    rows = [(0, [1.0, 2.0]), (100, [-1.0, -2.5]), (1, [-0.5, -0.5])]
    assert found(frame(spark, rows)) == expected(rows, 10)
    assert found(frame(spark, rows).limit(0)) == []
    assert found(frame(spark, [(0, [])])) == [] and found(frame(spark, [(0, []), (1, [])])) == [(0, 1, 1, 0)]


def test_own_queries(spark):
    rows = [(i, [float(i % 7), float(i % 5), -1.0]) for i in range(90)]
    asked = [(7, rows[7][1]), (8, rows[8][1])]
    assert found(frame(spark, rows), queries=frame(spark, asked)) == expected(rows, 10, asked=[7, 8])


def test_large_components(spark):
    """Beyond 2**53 and 2**62, where doubles and longs no longer hold the products."""
    rng = np.random.default_rng(5)
    for size in (2.0**20, 2.0**22, 2.0**26, 1e30, 1e150):
        rows = [(i, [float(v) for v in rng.standard_normal(4) * size]) for i in range(0, 400, 25)]
        assert found(frame(spark, rows), settings=Settings(head_rows=3, bucket_rows=4)) == expected(rows, 10)
    rows = [(0, [1e306, 1.0]), (1, [1.0, 1.0]), (100, [2.0, 3.0])]  # overflows a double when scaled: no part
    assert {r[0] for r in found(frame(spark, rows))} == {100}


def test_exact_products():
    a, b = np.array([[2.0**40, 3.0], [-(2.0**40), 1.0]]), np.array([[2.0**40, 5.0], [1.0, -7.0]])
    for bound in (2.0**60, 2.0**70, 2.0**85):
        if bound > 2**80:
            assert exact_products(a, b, bound).tolist() == [[(1 << 63) - 1, (1 << 40) - 21], [-(1 << 63), -(1 << 40) - 7]]
    assert exact_products(a, b[1:], 2.0**60).tolist() == [[(1 << 40) - 21], [-(1 << 40) - 7]]


def test_each_way_of_pruning_is_used():
    rng = np.random.default_rng(2)
    s = Settings(bucket_rows=256)
    centres = rng.standard_normal((300, 48))
    x = np.floor(1024 * (centres[rng.integers(0, 300, 20_000)] + 0.05 * rng.standard_normal((20_000, 48))) * rng.gamma(4.0, 0.3, (20_000, 1)))
    lengths = np.sqrt((x * x).sum(1))
    ids, asked = np.arange(20_000), np.arange(0, 20_000, 400)
    best = Best(ids[asked], np.full(len(asked), -np.inf), s.k)
    counts = search(_cut(ids, x, lengths, s), best, x[asked], lengths[asked], s)
    print(counts, f"verified {counts['verified'] / len(asked) / len(ids):.3f} of all pairs")
    exact = (x[asked] @ x.T).astype(np.int64)
    exact[np.arange(len(asked)), asked] = np.iinfo(np.int64).min
    for q in range(len(asked)):
        assert best.ids[q].tolist() == np.lexsort((ids, ~exact[q]))[: s.k].tolist()
    assert min(counts.values()) > 0 and counts["verified"] < 0.3 * len(asked) * len(ids)
