import random
import re
from itertools import combinations

import numpy as np

from palimpsest.llm import jaccard_join as J
from palimpsest.llm.components import connected_components
from palimpsest.llm.jaccard_join import Settings, ngram_jaccard_join

SMALL = Settings(sketch_bits=16)
#: Every limit so low that the ways behind it are taken.
TIGHT = Settings(sketch_bits=12, list_rows=3, block_rows=2, hub_split=2, central=1, broadcast_roles=0, share=7)


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_force(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    comp = {i: i for i, _ in sets}
    links = [(a, b) for (a, x), (b, y) in combinations(sets, 2) if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(comp[a], comp[b])
            changed |= comp[a] != m or comp[b] != m
            comp[a] = comp[b] = m
    return {i: (len(s), comp[i]) for i, s in sets}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 60))] for _ in range(12)]
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one  TWO"), (5, "one two three four five")]
    for i in range(6, 200):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(w) + 1)
            w[k:k] = [rng.choice(words)] if rng.random() < 0.5 else w[k : k + 1]
        out.append((i, " ".join(w)))
    out += [(200 + i, "x " * 5000 + f"tail {i}") for i in range(3)]
    return out


def test_equals_brute_force(spark):
    for seed, s in ((1, SMALL), (2, SMALL), (3, TIGHT)):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS node", "2 AS hub", "'x' AS component").repartition(5)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(df, settings=s).collect()}
        assert got == brute_force(rows)


def test_one_list_in_many_classes_is_dealt_and_whole(spark):
    """A passage that all texts share, so that its shingles are one list of many classes; some texts are near copies."""
    rng = random.Random(5)
    text = lambda n: [f"v{rng.randrange(400)}" for _ in range(n)]
    passage, rows = text(30), []
    for i in range(60):
        own = text(rng.randint(4, 40))
        rows += [(3 * i + k, " ".join(passage + own[k:])) for k in range(rng.randint(1, 3))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for s in (SMALL, TIGHT):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(df, settings=s).collect()} == brute_force(rows)


def test_salts_follow_the_count_beyond_chance():
    classes = np.zeros(1 << 12, np.uint8)
    classes[5] = 60  # 2 ** 15
    assert J._salts(classes, 1024)[60] == 32
    assert J._salts(np.full(1 << 12, 60, np.uint8), 1024)[60] == 1  # every bucket is as full


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert ngram_jaccard_join(empty, settings=SMALL).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f")], "doc_id bigint, text string")
    assert [tuple(r)[:3] for r in ngram_jaccard_join(rows, settings=SMALL).collect()] == [(7, 2, 7), (7, 2, 7)]


def test_components_of_many_shares(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100 + i, 99) for i in range(30)], "u bigint, v bigint").repartition(6)
    assert {(r.u, r.component) for r in connected_components(edges, share=5).collect()} == {(i, 0) for i in range(41)} | {(i, 99) for i in range(99, 130)}


def test_central_pairs_are_the_possible_ones_in_little_code(spark):
    """All pairs that the filters allow, and code that the JVM's compiler takes in (4,746 bytes took it 1.4 GB)."""
    schema = "shingle bigint, node bigint, n int, pos int, comp bigint, size bigint"
    rng = random.Random(4)
    size = {k: rng.randint(20, 30) for k in range(60)}
    rows = sorted({(s, k): (s, k, size[k], rng.randrange(9), k % 5, 20) for s in range(12) for k in rng.sample(range(60), 20)}.values())
    spark = spark.newSession()
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # whose plan shows its code only stage by stage
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    left = spark.createDataFrame(rows, schema)
    out = J._central_pairs(left, left, J.THRESHOLD, 100)  # as many hubs as a list has rows
    want = set()
    for a, b in combinations(rows, 2):
        a, b = sorted((a, b), key=lambda r: (r[2], r[1]))
        if a[0] == b[0] and a[4] != b[4] and J._possible(*(np.array(x) for x in (a[2], a[3], b[2], b[3])), J.THRESHOLD):
            want.add((a[1], a[2], b[1], b[2]))
    assert {tuple(r) for r in out.collect()} == want
    assert 50 < len(want) < len(list(combinations(size, 2)))
    stages = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenStringSeq(out.distinct()._jdf.queryExecution().executedPlan())
    assert 0 < max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 2500
