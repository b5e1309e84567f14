import random

from pyspark.sql import functions as F

from palimpsest.operators import asof, hierarchy, layers, redline, search, versions


def test_as_of_equals_brute_force(spark):
    rng = random.Random(2)
    facts = [(rng.randrange(4), rng.randrange(50), rng.randrange(9)) for _ in range(60)]
    asked = [(rng.randrange(5), rng.randrange(-5, 60)) for _ in range(80)]
    got = asof.as_of_join(spark.createDataFrame(asked, "k int, at int"), spark.createDataFrame(facts, "k int, since int, v int"), ["k"], "at", "since", ["v"])
    best = lambda k, at: max(((s, v) for q, s, v in facts if q == k and s <= at), default=(None, None))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((k, at, *best(k, at)) for k, at in asked), key=repr)


def test_half_finished_loads_serve_nothing(spark):
    loads = spark.createDataFrame([("1", 1, 10), ("1", 2, None)], "title string, seq int, sections_loaded int")
    asked = spark.createDataFrame([("1", 5)], "title string, seq int")
    assert asof.served_from(asked, loads).first().served_seq == 1
    assert asof.served_from(asked, loads, complete_only=False).first().served_seq == 2


def test_reversion_is_current_again(spark):
    rows = spark.createDataFrame([("s", 1, "A"), ("s", 2, "B"), ("s", 3, "A")], "section string, seq int, content_hash string")
    assert versions.current_version(rows, ["section"], [F.desc("seq")]).first().content_hash == "A"
    runs = versions.version_runs(rows, ["section"], ["seq"], "content_hash").orderBy("run").collect()
    assert [r.content_hash for r in runs] == ["A", "B", "A"]


def test_upsert_is_idempotent_and_order_free(spark):
    base = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, o int, v string")
    batch = spark.createDataFrame([(2, 3, "d"), (2, 2, "c"), (3, 1, "e")], "k int, o int, v string")
    once = versions.upsert(base, batch, ["k"], ["o"])
    twice = versions.upsert(once, batch, ["k"], ["o"])
    want = [(1, 1, "a"), (2, 3, "d"), (3, 1, "e")]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == want


def test_breadcrumbs_of_any_depth_and_cycles(spark):
    """A chain of 200 levels, bushes, unknown parents, cycles and what hangs below them."""
    rng = random.Random(8)
    up = {0: None} | {i: i - 1 for i in range(1, 200)} | {i: rng.randrange(i) for i in range(200, 400)}
    up |= {500: 999, 501: 500, 600: 601, 601: 602, 602: 600, 603: 601, 604: 603, 700: 700}
    df = spark.createDataFrame(list(up.items()) + [(None, 3)], "id int, parent_id int").selectExpr("*", "1 AS n", "2 AS path")
    got = {r.id: (r.path, r.cyclic) for r in hierarchy.breadcrumbs(df).collect()}

    def way(i):
        path = []
        while i in up:
            if i in path:
                return None, True
            path.insert(0, i)
            i = up[i]
        return path, False

    assert got == {i: way(i) for i in up} and len(got[199][0]) == 200
    assert hierarchy.breadcrumbs(df.limit(0)).count() == 0


def test_call_costs_equal_a_loop(spark):
    rng = random.Random(9)
    rows = [(f"p{k % 9}", rng.randrange(6), f"c{k}", rng.choice([None, 1, 2, 3, 5]), k % 9 % 4 or None, rng.choice([True, True, False, None])) for k in range(150)]
    df = spark.createDataFrame(rows + [("none", 1, "x", None, 1, True)], "page string, place int, call string, cost int, sequential int, per_view boolean").selectExpr("*", "1 AS first", "2 AS at")
    got = {r.page: tuple(r)[1:] for r in layers.call_costs(df).collect()}
    want = {}
    for page in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == page]
        live = sorted((r for r in mine if r[3] is not None and r[5] is not False), key=lambda r: (r[1], r[2]))
        head, tail = live[: mine[0][4] or 0], live[mine[0][4] or 0 :]
        most = max((r[3] for r in tail), default=0)
        want[page] = (len(live), sum(r[5] is False for r in mine), sum(r[3] for r in head) + most, min((r[2] for r in tail if r[3] == most), default=None))
    assert got == want
    assert layers.call_costs(df.limit(0)).count() == 0


def test_structure_does_not_depend_on_load_order(spark):
    rows = [("n", 5, "new"), ("n", 2, "old"), ("m", 3, "x")]
    a, b = (hierarchy.merge_structure(spark.createDataFrame(r, "identifier string, seq int, heading string")) for r in (rows, rows[::-1]))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) == [("m", 3, 3, "x"), ("n", 2, 5, "new")]


def test_breadcrumbs_of_a_deep_chain(spark):
    rows = [(i, i - 1 if i else None) for i in range(20)]
    got = {r.id: r.path for r in hierarchy.breadcrumbs(spark.createDataFrame(rows, "id int, parent_id int")).collect()}
    assert got == {i: list(range(i + 1)) for i in range(20)}


def test_query_round_trip():
    for q in ('title:16 title:t18 heading:"wild horses" free text', 'see: also "a b" status:none date:7/12/2026', "release:119-99", "title: x"):
        once = search.parse_query(q)
        assert search.parse_query(search.unparse_query(once)) == once
    once = search.parse_query("a title:T5a")
    assert once.filters == {"title_num": ("5a",)} and search.parse_query("title: x").text == "title: x"
    assert search.without_filter(search.with_filter(once, "status", "x"), "status", "x") == once


def test_boolean_text(spark):
    df = spark.createDataFrame([(1, "the wild horse runs"), (2, "horse of the wild"), (3, "wild old horses")], "id int, t string")
    found = lambda e: [r.id for r in df.filter(search.compile_text(e, search.terms(F.col("t")))).orderBy("id").collect()]
    assert found("wild horse") == [1, 2] and found('"wild horse"') == [1] and found('"wild horses"~1') == [3]
    assert found("hors*") == [1, 2, 3] and found("hrse~1") == [1, 2] and found("wild -the") == [3]
    assert found("(runs | old) wild") == [1, 3] and found("") == [1, 2, 3] and found(") wild (") == [1, 2, 3]


def test_diff_reassembles_both_texts(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ab c") for _ in range(rng.randint(0, 12)))
    for _ in range(200):
        a, b = word(), word()
        for ops in (redline.character_ops(a, b), redline.word_ops(a, b)):
            assert "".join(o["text"] for o in ops if o["op"] != "insert") == a
            assert "".join(o["text"] for o in ops if o["op"] != "delete") == b
    rows = spark.createDataFrame([("a b c d\nx", "a b c e\nx\ny")], "old string, new string").select(redline.document_diff(F.col("old"), F.col("new")).alias("ops"))
    out = rows.select("ops", redline.diff_summary(F.col("ops")).alias("s")).first()
    assert out.s == "1 line changed, 1 line added" and out.ops[0].text == "a b c [-d-]{+e+}"
