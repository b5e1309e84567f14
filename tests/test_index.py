import random
import re
import threading

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import index, search
from palimpsest.sources.store import Store

WORDS = "red fox den old big wild horse runs act of".split()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(WORDS[: rng.randint(2, 10)]) for _ in range(rng.randint(0, 25))), rng.choice(WORDS)) for i in range(300)]
    return [*rows, (300, None, None), (None, "red fox", "red")]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, "doc_id int, text string, heading string")


@pytest.fixture(scope="module")
def built(spark, docs, tmp_path_factory):
    index.BLOCK_DOCS, held = 16, index.BLOCK_DOCS  # many blocks
    try:
        return index.Index(index.build_index(spark, f"file://{tmp_path_factory.mktemp('index')}", docs, "doc_id", {"body": "text", "heading": "heading"}))
    finally:
        index.BLOCK_DOCS = held


@pytest.mark.parametrize("expression", ["red fox", '"red fox"', '"red den"~2', "ho*", "hrse~1", "red -fox", "(runs | old) wild", "-red", "", "zzz", '"red red fox"', ") wild ("])
def test_matches_as_the_texts_do(docs, built, expression):
    want = {r.doc_id for r in docs.filter("doc_id is not null").select("doc_id", search.terms(F.coalesce("text", F.lit(""))).alias("w")).filter(search.compile_text(expression, F.col("w"))).collect()}
    assert sorted(r.doc for r in built.match(expression).collect()) == sorted(want)


def test_best_of_blocks_are_the_best_of_all(spark, docs, built):
    queries = spark.createDataFrame([("a", "red"), ("a", "act"), ("b", "of"), ("c", "zzz"), ("d", "fox"), ("d", "fox")], "query string, term string")
    whole = {(r.query, r.doc): r.score for r in built.scores(queries, {"body": 1.0, "heading": 3.0}).collect()}
    for k, lead in ((5, 1), (10, 4), (1000, 1)):
        want = []
        for q in "abd":
            ranked = sorted(((-round(s, 9), d) for (query, d), s in whole.items() if query == q))[:k]
            want += [(q, n, d) for n, (_, d) in enumerate(ranked, 1)]
        top = built.top(queries, {"body": 1.0, "heading": 3.0}, k, lead).collect()
        assert sorted((r.query, r.rank, round(r.score, 6)) for r in top) == [(q, n, round(whole[q, d], 6)) for q, n, d in want]
        assert {(r.query, r.doc) for r in top} <= set(whole)
    plain = {(r.query, r.doc): r.score for r in search.bm25(docs.filter("doc_id is not null"), queries.distinct()).collect()}
    body = {(r.query, r.doc): r.score for r in built.scores(queries, {"body": 1.0}).collect()}
    assert body.keys() == plain.keys() and all(abs(body[x] - plain[x]) < 1e-9 for x in body)


def test_an_empty_index(spark, docs, tmp_path):
    empty = index.Index(index.build_index(spark, f"file://{tmp_path}", docs.limit(0), "doc_id", {"body": "text"}))
    assert empty.match("red").count() == 0 and empty.match("-red").count() == 0
    assert empty.top(spark.createDataFrame([("a", "red")], "query string, term string"), {"body": 1.0}).count() == 0


def test_promotion_under_readers(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    make = lambda n: store.commit({t: store.write(t, spark.range(n)) for t in ("a", "b")})
    first = make(1)
    assert store.current() is None
    store.promote(first)
    later = [make(n) for n in range(2, 5)]
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            now = Store(spark, store.root).current()
            seen.append((now.table("a").count(), now.table("b").count()))

    reader = threading.Thread(target=read)
    reader.start()
    for s in later:
        store.promote(s)
    stop.set()
    reader.join()
    assert seen and all(a == b for a, b in seen) and store.current().table("a").count() == 4
    with pytest.raises(ValueError):
        store.promote(make(9), sound=lambda s: s.table("a").count() < 9)
    assert store.current().name == later[-1].name
    with Store(spark, store.root).pinned() as held:
        store.promote(last := make(6))
        assert held.name not in store.retire() and held.table("a").count() == 4
    assert held.name in store.retire() and last.name == store.current().name
    assert store.current().table("b").count() == 6
    with pytest.raises(ValueError):
        store.snapshot(first.name)


def test_sections_retired_and_shown(spark, tmp_path):
    rows = [("/us/usc/t1/s1", 1, 1, False, "<s>red fox</s>"), ("/us/usc/t1/s1", 2, 2, True, "<s>red fox den</s>"), ("/us/usc/t1/s2", 1, 1, True, "<s>old fox</s>"), ("/us/usc/t2/s1", 2, 2, True, "<s>big</s>")]
    versions = spark.createDataFrame(rows, "identifier string, first_release_id int, first_release_seq int, is_current boolean, xml string").withColumn("seq_in_title", F.substring("identifier", -1, 1).cast("int"))
    documents = index.section_documents(versions)
    root = f"file://{tmp_path}/i"
    names = [c for c in documents.columns if c not in ("doc", "body")]
    it = index.Index(index.build_index(spark, root, documents, "doc", {"body": "body"}, names))
    fox = lambda it: it.scores(spark.createDataFrame([("q", "fox")], "query string, term string"), {"body": 1.0})
    page, total = index.shaped_results(it, fox(it), "citation")
    assert [(r.identifier, r.first_release_seq) for r in page.collect()] == [("/us/usc/t1/s1", 2), ("/us/usc/t1/s2", 1)] and total.first().total == 2
    page, total = index.shaped_results(it, fox(it), "citation", seq=1)
    assert [(r.identifier, r.first_release_seq) for r in page.collect()] == [("/us/usc/t1/s1", 1), ("/us/usc/t1/s2", 1)] and total.first().total == 2
    after = index.Index(index.retire_versions(spark, root, spark.createDataFrame([("/us/usc/t1/s1", 2), ("/us/usc/t9/s9", 1)], "identifier string, first_release_id int")))
    assert [r.identifier for r in index.shaped_results(after, fox(after))[0].collect()] == ["/us/usc/t1/s2"]
    assert index.shaped_results(it, fox(it))[1].first().total == 2  # who holds the older generation sees it unchanged
    q = search.Query(text="x", release="119-1", date=None) if "release" in search.Query.__dataclass_fields__ else None
    assert q is None or (index.want_release("118-1", None, q), index.want_release(None, None, q)) == (("118-1", None), ("119-1", None))


def exchanges(df):
    """Columns that a plan's exchanges deal rows by; those of broadcasts left out."""
    return [line.strip(" +-:") for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if re.match(r"[ +:*()\d-]*Exchange ", line)]


@pytest.fixture
def no_small_tables(spark):
    """As on a large corpus: nothing is broadcast because its files are small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_are_shuffled_once_and_postings_never(spark, docs, tmp_path, monkeypatch):
    seen, write = [], index._write_postings
    monkeypatch.setattr(index, "_write_postings", lambda df, path: (seen.append(df), write(df, path)))
    monkeypatch.setattr(index, "BLOCK_DOCS", 16)
    twice = docs.unionByName(docs.filter("doc_id % 3 = 0")).unionByName(docs.filter("doc_id % 5 = 0").withColumn("text", F.concat(F.lit("den "), "text")))
    built = index.Index(index.build_index(spark, f"file://{tmp_path}", twice, "doc_id", {"body": "text"}))
    assert len(exchanges(seen[0])) == 1 and "hashpartitioning(block" in exchanges(seen[0])[0]
    # rows of one id and length are one document, as in the scores over texts
    queries = spark.createDataFrame([("a", "red"), ("a", "den"), ("b", "of")], "query string, term string")
    plain = {(r.query, r.doc): r.score for r in search.bm25(twice.filter("doc_id is not null"), queries).collect()}
    got = {(r.query, r.doc): r.score for r in built.scores(queries, {"body": 1.0}).collect()}
    assert got.keys() == plain.keys() and all(abs(got[x] - plain[x]) < 1e-9 for x in got)
    counts = {r.term: (r.df, r.cf) for r in built.lexicon("body").collect()}
    words = twice.filter("doc_id is not null").select("doc_id", search.terms(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("term"))
    assert counts == {r.term: (r.df, r.cf) for r in words.groupBy("term").agg(F.count_distinct("doc_id", "dl").alias("df"), F.count("*").alias("cf")).collect()}


def test_postings_stay_where_they_are_in_a_collapse(spark, no_small_tables):
    from palimpsest.plans import registry

    assert not [x for x in exchanges(registry.QUERIES["search_collapse"](spark, "/root/testdata/sf0.001")) if "bucket" in x]


def test_postings_stay_where_they_are_for_a_page(spark, built, no_small_tables):
    from palimpsest.plans import registry

    assert not [x for x in exchanges(registry.QUERIES["search_page"](spark, "/root/testdata/sf0.001")) if "bucket" in x]
    terms = spark.createDataFrame([("red", 1)], "term string, i int")
    assert not exchanges(built.places(terms, "body"))


def test_postings_stay_where_they_are_in_scores_and_bounds(spark, built, no_small_tables):
    queries = spark.createDataFrame([("a", "red"), ("b", "of")], "query string, term string")
    for df in (built.scores(queries, {"body": 1.0}), built.bounds(built.wanted(queries, {"body": 1.0}))):
        assert exchanges(df) and not [x for x in exchanges(df) if "bucket" in x]
