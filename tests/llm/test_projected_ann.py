import math

import numpy as np

from palimpsest.llm.projected_ann import Index, Settings, chi_square_quantile, nearest_by_inner_product


def test_recall_order_and_edges(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((900, 16)).astype("float32")
    x[100:200] = x[100]  # a hundred equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [math.nan] * 16), (2060, [None] * 16), (2080, [1.0]), (None, [1.0] * 16), (2100, [math.inf] * 16)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS v", "2 AS shard")
    out = nearest_by_inner_product(df, settings=Settings(shard_rows=300)).collect()
    found = {}
    for r in out:
        found.setdefault(r.query_id, []).append(r)
    assert set(found) == set(range(0, 900, 20))
    hits = 0
    for q, rs in found.items():
        rs.sort(key=lambda r: r["rank"])
        score = (x.astype(float) * x[q].astype(float)).sum(1)
        assert [r["rank"] for r in rs] == list(range(1, 21)) and q not in {r.vec_id for r in rs}
        assert all(abs(r.score - score[r.vec_id]) < 1e-9 for r in rs)
        assert [(-r.score, r.vec_id) for r in rs] == sorted((-r.score, r.vec_id) for r in rs)
        best = sorted((i for i in range(900) if i != q), key=lambda i: (-score[i], i))[:20]
        hits += len(set(best) & {r.vec_id for r in rs})
    assert hits / (20 * len(found)) >= 0.95


def test_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5]), (3, [3.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in nearest_by_inner_product(df).collect()] == [(0, 1, 3), (0, 2, 1)]
    assert nearest_by_inner_product(df.limit(0)).count() == 0


def test_stopping_test_quantile():
    assert abs(chi_square_quantile(0.95, 8) - 15.507) < 1e-3
    x = np.random.default_rng(1).standard_normal((500, 12))
    ids, score, seen = Index(np.arange(500), x, float((x * x).sum(1).max()), Settings(k=5, tau=0.5)).search(np.array([0]), x[:1])
    assert len(ids[0]) == 5 and seen <= 500


def measured(ids, x, asked, s):
    """Recall at k against brute force, and the share of pairs verified, over shards as the job cuts them."""
    bound, best, pairs = float((x * x).sum(1).max()), [], 0
    shards = max(1, -(-len(ids) // s.shard_rows))
    for k in range(shards):
        index = Index(ids[k::shards], x[k::shards], bound, s)
        parts = [index.search(ids[asked[i : i + 128]], x[asked[i : i + 128]]) for i in range(0, len(asked), 128)]
        best.append(np.concatenate([p[1] for p in parts]))
        pairs += sum(p[2] for p in parts)
    found = -np.sort(-np.concatenate(best, axis=1), axis=1)[:, : s.k]
    exact = x[asked] @ x.T
    exact[np.arange(len(asked)), asked] = -np.inf
    least = -np.sort(-exact, axis=1)[:, s.k - 1]
    return float((found >= least[:, None] - 1e-9).mean()), pairs / len(asked) / len(ids)


def test_the_stopping_test_stops_and_recall_holds(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    rows = [(r.vec_id, r.embedding) for r in rows if r.embedding and all(v is not None and math.isfinite(v) for v in r.embedding) and any(r.embedding)]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    recall, share = measured(ids, x, (ids % 20 == 0).nonzero()[0], Settings())
    print(f"sf0.1: recall {recall:.3f}, verified {share:.3f} of all pairs")
    assert recall >= 0.9 and share < 0.99
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 64))[rng.integers(0, 500, 100_000)] + 0.3 * rng.standard_normal((100_000, 64))
    recall, share = measured(np.arange(100_000), x, np.arange(0, 100_000, 500), Settings())
    print(f"100,000 clustered: recall {recall:.3f}, verified {share:.3f} of all pairs")
    assert recall >= 0.9 and share < 0.7
