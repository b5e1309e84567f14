import random

import corpus_pipeline as P


def make(tmp_path, spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(30)) for i in range(3)]
    docs, labels = [], []
    for i in range(240):
        body = text(rng.randint(40, 90))
        if i % 6 == 0:
            body = body.replace(" ", " scumbag ", 3)
        labels.append((i, 0, int(i % 6 == 0)))
        docs.append([i, body, "en", f"src{i % 12}"])
    shared = text(12)
    for i in range(1, 40):
        docs[i][1] += "\n" + shared
    docs[101][1] = docs[100][1]
    docs[103][1] = docs[103][1] + " " + items[1][1]
    docs += [[900, "", "en", "src1"], [901, None, "en", None]]
    schema = "doc_id bigint, text string, lang string, source string"
    spark.createDataFrame([tuple(d) for d in docs], schema).selectExpr("*", "coalesce(length(text), 0) AS n_chars").selectExpr("doc_id", "text", "lang", "source", "cast(n_chars as bigint) n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return {d[0]: d[1] for d in docs}, shared


def test_stages_one_by_one(spark, tmp_path):
    texts, shared = make(tmp_path, spark)
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        seen[name] = docs.collect()
        if k < 4:
            assert tuple(docs.columns) == P.COLUMNS
    clean = {i for i in texts if not (i < 240 and i % 6 == 0)}
    kept = {r.doc_id for r in seen["toxicity"]}
    assert clean <= kept and len(kept - clean) <= 4
    lines = {r.doc_id: r.text for r in seen["line dedup"]}
    assert set(lines) == kept and sum(shared in (t or "") for t in lines.values()) == 1
    assert min(i for i, t in lines.items() if shared in (t or "")) == min(i for i in kept if shared in (texts[i] or ""))
    single = {r.doc_id for r in seen["n-gram Jaccard join"]}
    assert kept - single == {101} & kept
    free = {r.doc_id for r in seen["benchmark decontamination"]}
    assert single - free == {103}
    assert {r.doc_id for r in seen["SentencePiece"]} == free and all(r.lossless for r in seen["SentencePiece"])


def test_line_on_few_sites(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    docs = [[i, text(rng.randint(40, 90)), "en", f"src{i % 12}"] for i in range(240)]
    shared = text(12)
    for i in range(1, 40, 3):  # 13 documents of 4 sites
        docs[i][1] += "\n" + shared
    docs[101][1] = docs[100][1]
    want = {d[0]: d[1] if d[0] == 1 else d[1].removesuffix("\n" + shared) for d in docs}
    df = spark.createDataFrame([tuple(d) for d in docs], "doc_id bigint, text string, lang string, source string")
    assert {r.doc_id: r.text for r in P.line_dedup(spark, df, "").collect()} == want
