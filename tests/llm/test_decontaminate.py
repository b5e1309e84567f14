import random
import re

from pyspark.sql import functions as F

from palimpsest.llm.decontaminate import Settings, _bounds, _item_shingles, _signature, contaminated, decontaminate, item_signatures


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_equals_brute_force(spark):
    rng = random.Random(4)
    words = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(12, 40)))) for i in range(15)] + [(50, None), (51, ""), (52, "Two words"), (None, "a b c d e")]
    items.append((60, " ".join(rng.choice(words) for _ in range(40))))
    docs = []
    for i in range(120):
        w = [rng.choice(words) for _ in range(rng.randint(0, 900))]
        if rng.random() < 0.5:
            part = rng.choice(items[:15])[1].split()
            part = part[: len(part) - rng.randint(0, 8)]
            k = rng.randrange(len(w) + 1)
            w[k:k] = [x.upper() for x in part]
        docs.append((i, " ".join(w)))
    halves = items[-1][1].split()
    docs += [(504, " ".join(halves[:20])), (504, " ".join(halves[20:]))]  # only both together contain it
    docs += [(500, None), (501, "  "), (502, "two\tWORDS"), (None, items[0][1]), (503, items[1][1]), (503, items[2][1])]
    want, held = set(), {}
    for i, t in docs:
        if i is not None:
            held.setdefault(i, set()).update(shingle_set(t))
    for i, s in held.items():
        for k, t in items:
            x = shingle_set(t)
            if k is not None and x and len(s & x) >= 0.75 * len(x):
                want.add((i, k, len(s & x), len(x)))
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS item_id", "2 AS h")
    b = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS doc_id")
    got = {tuple(r)[:4] for r in contaminated(d, b).collect()}
    assert got == want and len(want) > 10
    kept = {r.doc_id for r in decontaminate(d, b).collect()}
    assert kept == ({i for i, _ in docs} - {w[0] for w in want})


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert contaminated(d, none).count() == 0
    assert contaminated(d.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")).count() == 0


def test_no_item_is_lost_from_one_shingle_up(spark):
    """Items of 1 to 400 words, each whole, or with a fifth of its end cut off, in a document of its own."""
    rng = random.Random(11)
    text = lambda n: [f"u{rng.randrange(5000)}" for _ in range(n)]
    sizes = [*range(1, 9)] * 40 + [rng.randint(9, 60) for _ in range(120)] + [rng.randint(61, 400) for _ in range(120)]
    items, docs, want = [], [], set()
    for i, n in enumerate(sizes):
        item = text(n)
        part = item[: n - n // 5] if i % 2 and n > 30 else item
        # a text of fewer than five words is one shingle, its whole sequence: contained only in a text of the same words
        before, after = (text(rng.randint(0, 1500)), text(rng.randint(0, 1500))) if n >= 5 else ([], [])
        items.append((i, " ".join(item)))
        docs.append((i, " ".join(before + part + after)))
    for i, t in docs:
        mine = shingle_set(t)
        for k in {i} if len(items[i][1].split()) >= 5 else range(len(items)):
            x = shingle_set(items[k][1])
            if len(mine & x) >= 0.75 * len(x):
                want.add((i, k))
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), spark.createDataFrame(items, "item_id bigint, text string")
    for s in (Settings(), Settings(broadcast_bytes=0), Settings(agree=1), Settings(agree=9)):
        got = {tuple(r)[:2] for r in contaminated(d, b, settings=s).collect()}
        for low, high in ((1, 8), (9, 60), (61, 1000)):
            there = {w for w in want if low <= sizes[w[1]] <= high}
            print(f"items of {low} to {high} words: {len(there & got)} of {len(there)} found")
        assert want <= got and len(want) >= 500
        assert all(len(shingle_set(docs[i][1]) & shingle_set(items[k][1])) >= 0.75 * len(shingle_set(items[k][1])) for i, k in got)


def test_items_at_exactly_the_limit_and_one_below(spark):
    """Of 4 * k shingles, k are lost (kept: exactly 0.75), or k + 1."""
    rng = random.Random(12)
    items, docs, want = [], [], set()
    for i in range(120):
        k = rng.randint(2, 30)
        item = [f"u{rng.randrange(90000)}" for _ in range(4 * k + 4)]
        lost = k + i % 2
        part = item[: len(item) - lost] if i % 3 else item[lost:]
        items.append((i, " ".join(item)))
        docs.append((i, " ".join([f"x{rng.randrange(90000)}" for _ in range(rng.randint(0, 3000))] + part)))
        if lost == k:
            want.add((i, i, 3 * k, 4 * k))
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {tuple(r)[:4] for r in contaminated(d, b).collect()} == want


def test_signatures_are_shorter_than_shingles_and_follow_size(spark):
    rng = random.Random(13)
    text = lambda n: " ".join(f"u{rng.randrange(90000)}" for _ in range(n))
    items = spark.createDataFrame([(i, text(n)) for i, n in enumerate((1, 5, 6, 20, 60, 404, 4004))], "item_id bigint, text string")
    rows = item_signatures(_item_shingles(items, 5), Settings())
    sizes = {r.item_id: (r["count"], r.k, r.hits) for r in rows.groupBy("item_id", "k", "hits").count().collect()}
    assert sizes == {0: (1, 0, 1), 1: (1, 0, 1), 2: (2, 1, 2), 3: (6, 4, 2), 4: (16, 6, 2), 5: (102, 9, 2), 6: (1002, 12, 2)}
    # a document too short for any item hands over nothing, a long one a share of its hashes
    bounds = _bounds(rows.filter("item_id >= 4"))
    docs = spark.createDataFrame([(1, text(30)), (2, text(20_000)), (3, ""), (4, None)], "doc_id bigint, text string")
    n = {r.doc_id: r.n for r in docs.select("doc_id", F.size(_signature(F.col("text"), 5, bounds)).alias("n")).collect()}
    print(f"{n[2]} of 19,996 hashes handed over")
    assert n[1] == n[3] == n[4] == 0 and 4000 < n[2] < 10_000
