import re

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import markup as M
from palimpsest.operators import ledger, redline, resolve, search

SECTION = (
    '<section xmlns="urn:u" xmlns:x="urn:x" identifier="/us/usc/t9/s4"><num>§ 4</num><heading>Things &amp; more</heading>'
    '<subsection identifier="/us/usc/t9/s4/a"><num>(a)</num><heading> In\n general </heading><paragraph identifier="/us/usc/t9/s4/a/1"><num>(1)</num><content x:k="1">one</content></paragraph></subsection>'
    '<subsection identifier="/us/usc/t9/s4/b"><content>no number</content></subsection><subsection identifier="/us/usc/t9/s4/a"><num>(a)</num></subsection>'
    "<sourceCredit>(1950)</sourceCredit><notes><note>n</note></notes></section>"
)


def test_provisions_are_cut_from_the_source_text():
    found, xml = M.cut_provision(SECTION, "/us/usc/t9/s4/a/1")
    assert found and xml == '<paragraph xmlns="urn:u" xmlns:x="urn:x" identifier="/us/usc/t9/s4/a/1"><num>(1)</num><content x:k="1">one</content></paragraph>'
    assert M.cut_provision(SECTION, "/us/usc/t9/s4") == (True, SECTION)
    for markup, identifier in ((SECTION, "/us/usc/t9/s4/z"), (SECTION, None), (None, "/x"), ("", "/x"), ("<a identifier='/x'>", "/x"), ("<p>not <b>closed", "/x")):
        assert M.cut_provision(markup, identifier) == (False, None)
    deep = '<s identifier="/d">' + "<i>" * 3000 + "é" * 50_000 + "</i>" * 3000 + "</s>"
    assert M.cut_provision(f"<r>{deep}</r>", "/d") == (True, deep)


def test_contents_and_identifiers(spark):
    df = spark.createDataFrame([(SECTION,), (None,), ("<broken",)], "m string")
    got = df.select(M.contents(F.col("m")).alias("c"), M.level_identifiers(F.col("m")).alias("i")).collect()
    assert [tuple(x) for x in got[0].c] == [("/us/usc/t9/s4/a", "(a)", "In general"), ("source", "Source credit", None), ("notes", "Notes", None)]
    assert got[0].i == ["/us/usc/t9/s4/a", "/us/usc/t9/s4/a/1", "/us/usc/t9/s4/b"]
    assert all(r.c == [] and r.i == [] for r in got[1:])


def test_a_provision_comes_from_the_first_occurrence_that_holds_it(spark):
    sections = spark.createDataFrame([("/us/usc/t9/s4", "9"), ("/us/usc/t9/s5", "9")], "identifier string, title string")
    loads = spark.createDataFrame([("9", 1, 2), ("9", 3, None)], "title string, seq int, sections_loaded int")
    placements = spark.createDataFrame([("/us/usc/t9/s4", 1, 1, 10, "p"), ("/us/usc/t9/s4", 1, 2, 11, "p"), ("/us/usc/t9/s4", 1, 3, 12, "p")], "identifier string, seq int, version_id int, seq_in_title int, parent_identifier string")
    versions = spark.createDataFrame([(1, "stub", "<section/>", 1), (2, "real", SECTION, 1), (3, "later", SECTION, 1)], "version_id int, heading string, markup string, first_seq int")
    asked = spark.createDataFrame([("/us/usc/t9/s4/b", 5), ("/us/usc/t9/s4/q", 5), ("/us/usc/t9/s4", 5), ("/us/usc/t9/s4", 0), ("/us/usc/t9/s5", 5), ("/us/usc/t8/s1", 5), (None, 5)], "identifier string, seq int")
    got = {(r.identifier, r.seq): (r.version_id, r.n_occurrences, r.found, r.served_seq) for r in resolve.get_sections(asked, sections, loads, placements, versions).collect()}
    none = (None, None, None, None)
    assert got == {("/us/usc/t9/s4/b", 5): (1, 3, True, 1), ("/us/usc/t9/s4/q", 5): (1, 3, False, 1), ("/us/usc/t9/s4", 5): (1, 3, None, 1), ("/us/usc/t9/s4", 0): none, ("/us/usc/t9/s5", 5): none, ("/us/usc/t8/s1", 5): none, (None, 5): none}


def test_document_diff_of_a_null_side(spark):
    df = spark.createDataFrame([(None, "a\nb"), ("a", None), (None, None), ("x", "x")], "a string, b string")
    got = [[tuple(o) for o in r[0]] for r in df.select(redline.document_diff(F.col("a"), F.col("b"))).collect()]
    assert [t for o, t in got[0] if o in ("insert", "changed")] and [t for o, t in got[1] if o in ("delete", "changed")]
    assert got[2] == [("equal", "")] and got[3] == [("equal", "x")]


def test_percentiles_of_repeated_values(spark):
    df = spark.createDataFrame([("a", v) for v in [3, 3, 3, 1, 9, None]] + [("b", 7)], "g string, v int")
    got = {r.g: (r.p50, r.p95, r.m) for r in ledger.percentiles(df, ["g"], "v", {"p50": 50, "p95": 95}, {"m": 99}).collect()}
    assert got == {"a": (3, 9, 9), "b": (7, 7, 7)}


def test_phrases_in_order_within_slop(spark):
    docs = spark.createDataFrame([(1, "red old big fox"), (2, "fox red"), (3, "red a b c fox"), (4, "red red fox den"), (5, None)], "doc_id int, text string")
    queries = spark.createDataFrame([("q", "red fox"), ("three", "red fox den"), ("one", "red"), ("signs", "red | fox")], "query string, text string")
    assert {(r.query, r.doc) for r in search.phrase_hits(docs, queries, "doc_id", "text").collect()} == {("q", 1), ("q", 4), ("three", 4)}
    with pytest.raises(ValueError):
        search.page(docs, limit=101)
    with pytest.raises(ValueError):
        search.sort_hits(docs, "best", "doc_id")


def test_scopes_of_profiles(spark):
    docs = spark.createDataFrame([(1, "red fox", True), (2, "red fox", False)], "doc_id int, text string, now boolean")
    queries = spark.createDataFrame([("q", "red")], "query string, text string")
    scores = lambda name: {r.doc: r.score for r in search.profile_scores(docs, queries, search.PROFILES[name], {"body": "text"}, current="now").collect()}
    assert set(scores("phrase")) == {1}
    every = scores("all-versions")
    assert abs(every[1] / every[2] - 6) < 1e-9


def test_sections_are_resolved_once(spark):
    """What serves a title is asked of the sections found, not of all steps that find them, and only placements in releases
    that serve travel to their sections."""
    from palimpsest.plans import registry

    plan = registry.QUERIES["get_section"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "palimpsest/sections" in plan
    assert re.search(r"BroadcastHashJoin .* LeftSemi", plan)
