import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm.toxicity import Settings, fit, held_out, score_toxicity, train_toxicity


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(1)
    words, bad = [f"w{i}" for i in range(400)], ["scumbag", "worthless", "pathetic"]
    docs, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        w = [rng.choice(words) for _ in range(rng.randint(3, 80))]
        if toxic:
            for _ in range(rng.randint(2, 4)):
                w[rng.randrange(len(w))] = rng.choice(bad)
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs += [(1000, None), (1001, "")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "9 AS score", "'x' AS c0")
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id bigint, toxic int")
    out = score_toxicity(d, train_toxicity(d, lab)).withColumn("held", held_out(F.col("doc_id"))).collect()
    truth = dict(labels)
    held = [r for r in out if r.held and r.doc_id in truth]
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert sum((r.score >= 0.7) == bool(truth[r.doc_id]) for r in held) / len(held) > 0.95
    assert len(out) == 602 and all(0 <= r.score <= 1 for r in out) and out[0].c0 == "x"


def test_without_labels_and_rows(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert score_toxicity(d, train_toxicity(d, none)).first().score == 0.5
    assert score_toxicity(d.limit(0), train_toxicity(d, none)).count() == 0


def test_weights_equal_a_plain_ftrl():
    s = Settings(bits=6, alpha=0.7, beta=1.5, l1=0.4, l2=0.1, epochs=3)
    rng = random.Random(4)
    examples = [(sorted(rng.sample(range(64), rng.randint(0, 9))), rng.randint(0, 1)) for _ in range(80)]
    z, n = dict.fromkeys(range(65), 0.0), dict.fromkeys(range(65), 0.0)

    def weight(i):
        if i == 64:  # the intercept is not penalised
            return -z[i] * s.alpha / (s.beta + math.sqrt(n[i]))
        return 0.0 if abs(z[i]) <= s.l1 else -(z[i] - math.copysign(s.l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for features, y in examples:
            w = {i: weight(i) for i in [*features, 64]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i, wi in w.items():
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha
                z[i] += g - sigma * wi
                n[i] += g * g
    at, got = fit([(np.array(f, np.int64), y) for f, y in examples], s)
    want = {i: weight(i) for i in range(65) if i == 64 or weight(i)}
    assert list(at) == list(want) and np.allclose(got, list(want.values()), atol=1e-12)


def test_sample_ends_with_its_bytes(spark):
    d = spark.createDataFrame([(i, f"w{i} " * 50) for i in range(200)], "doc_id bigint, text string")
    lab = d.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic")
    whole, cut = (train_toxicity(d, lab, Settings(l1=0.1, sample_bytes=b)) for b in (1 << 20, 1000))
    assert len(cut[0]) < len(whole[0]) and cut == train_toxicity(d, lab, Settings(l1=0.1, sample_bytes=1000))


def test_repeated_ids_do_not_depend_on_arrival(spark):
    rows = [(i % 7, f"a{i} b{i % 3} c") for i in range(90)]
    lab = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id bigint, toxic int")
    one, other = (spark.createDataFrame(r, "doc_id bigint, text string") for r in (rows, rows[::-1]))
    assert train_toxicity(one, lab) == train_toxicity(other, lab)
