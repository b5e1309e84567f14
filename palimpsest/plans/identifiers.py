"""Labels, titles, identifiers, citations, dates and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import citations as C
from palimpsest.functions import identifiers as I
from palimpsest.operators import asof, hierarchy
from palimpsest.plans.tables import table


def release_labels(spark, d):
    o = table(spark, d, "orders")
    label = F.concat((F.col("o_orderkey") % 30 + 90).cast("string"), F.lit("-"), (F.col("o_custkey") % 300).cast("string"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("not"), (F.col("o_custkey") % 9).cast("string"), F.lit("not7"))).otherwise(""), F.when(F.col("o_orderkey") % 5 == 0, "u1").otherwise(""))
    rows = o.select("o_orderkey", label.alias("label")).withColumn("p", I.parse_label(F.col("label")))
    return rows.select("o_orderkey", "p.congress", "p.law", F.array_join(F.transform("p.excluded", lambda x: x.cast("string")), ",").alias("excluded"), F.col("p.update").alias("upd"), (I.format_label(F.col("p")) == F.col("label")).alias("round_trip"))


LABEL_SQL = """
SELECT o_orderkey, CAST(o_orderkey % 30 + 90 AS INTEGER) AS congress, CAST(o_custkey % 300 AS INTEGER) AS law,
       CASE WHEN o_orderkey % 3 = 0 THEN (o_custkey % 9) || ',7' ELSE '' END AS excluded, CASE WHEN o_orderkey % 5 = 0 THEN 1 END AS upd, true AS round_trip FROM orders
"""


def label_resolution(spark, d):
    """Bare labels against releases of which some carry exclusions: exact, by prefix, ambiguous or missing."""
    part = table(spark, d, "part").select("p_partkey", F.concat(F.lit("117-"), (F.col("p_partkey") % 500).cast("string")).alias("bare"), "p_size")
    rel = part.filter("p_size > 20").select(F.when(F.col("p_size") % 2 == 0, F.col("bare")).otherwise(F.concat("bare", F.lit("not"), F.col("p_size").cast("string"))).alias("label"), F.col("p_partkey").alias("seq"))
    rel = rel.groupBy("label").agg(F.min("seq").alias("seq"))
    asked = part.select(F.col("bare").alias("label")).distinct()
    return asof.resolve_labels(asked, rel).select("label", "status", "resolved", "seq")


RESOLUTION_SQL = """
WITH p AS (SELECT p_partkey, '117-' || (p_partkey % 500) AS bare, p_size FROM part),
r AS (SELECT CASE WHEN p_size % 2 = 0 THEN bare ELSE bare || 'not' || p_size END AS label, bare, min(p_partkey) AS seq FROM p WHERE p_size > 20 GROUP BY 1, 2),
a AS (SELECT DISTINCT bare FROM p),
n AS (SELECT bare, count(*) AS c, arg_min(label, seq) AS label, min(seq) AS seq FROM r WHERE label <> bare GROUP BY 1)
SELECT a.bare AS label, CASE WHEN e.seq IS NOT NULL THEN 'exact' WHEN n.c = 1 THEN 'prefix' WHEN n.c > 1 THEN 'ambiguous' ELSE 'missing' END AS status,
       CASE WHEN e.seq IS NOT NULL THEN e.label WHEN n.c = 1 THEN n.label END AS resolved, CASE WHEN e.seq IS NOT NULL THEN e.seq WHEN n.c = 1 THEN n.seq END AS seq
FROM a LEFT JOIN r e ON e.label = a.bare LEFT JOIN n ON n.bare = a.bare
"""


def _titles(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.concat((F.col("c_custkey") % 54 + 1).cast("string"), F.when(F.col("c_custkey") % 7 == 0, "a").when(F.col("c_custkey") % 11 == 0, "x").otherwise("")).alias("title"))


def title_spellings(spark, d):
    t = F.col("title")
    return _titles(spark, d).select("c_custkey", I.file_title(t).alias("strict"), I.file_title(t, False).alias("lenient"), I.url_title(I.file_title(t, False)).alias("url"), I.query_title(F.concat(F.lit(" T"), t)).alias("typed"), I.title_of(F.concat(F.lit("/us/usc/t"), t, F.lit("/ch3/s1"))).alias("of"), I.chapter_of(F.concat(F.lit("/us/usc/t"), t, F.lit("/ch3/s1"))).alias("chapter"))


SPELL_SQL = """
WITH t AS (SELECT c_custkey, c_custkey % 54 + 1 AS n, CASE WHEN c_custkey % 7 = 0 THEN 'a' WHEN c_custkey % 11 = 0 THEN 'x' ELSE '' END AS s FROM customer)
SELECT c_custkey, CASE WHEN s <> 'x' THEN lpad(CAST(n AS VARCHAR), 2, '0') || s END AS strict, CASE WHEN s <> 'x' THEN lpad(CAST(n AS VARCHAR), 2, '0') || s ELSE n || s END AS lenient,
       n || s AS url, n || s AS typed, n || s AS of, '3' AS chapter FROM t
"""


def title_code_order(spark, d):
    rows = _titles(spark, d).select("title").distinct().withColumn("o", I.title_order(F.col("title"))).withColumn("key", I.code_order_key(F.col("title"), F.lit(12)))
    from pyspark.sql import Window as W

    # titles are a dimension of some sixty rows
    return rows.select("title", F.row_number().over(W.orderBy("o.number", "o.suffix")).cast("bigint").alias("place"), "key")


ORDER_SQL = """
WITH t AS (SELECT DISTINCT c_custkey % 54 + 1 AS n, CASE WHEN c_custkey % 7 = 0 THEN 'a' WHEN c_custkey % 11 = 0 THEN 'x' ELSE '' END AS s FROM customer)
SELECT n || s AS title, row_number() OVER (ORDER BY n, s) AS place, lpad(CAST(n AS VARCHAR), 4, '0') || CASE WHEN s = '' THEN '0' ELSE s END || '|000012' AS key FROM t
"""


def longest_prefix_url_path(spark, d):
    """Paths of pages to the deepest host or folder that is the path of another page's prefix."""
    path = F.concat(F.lit("/"), F.regexp_replace(F.regexp_extract("url", r"^https?://([^?#]+)", 1), "/+$", ""))
    pages = table(spark, d, "pages").select("page_id", path.alias("path"))
    known = pages.filter("page_id % 3 = 0").select(F.regexp_extract("path", "^(/[^/]+/[^/]+)", 1).alias("identifier")).filter("identifier != ''")
    return hierarchy.longest_prefix(pages, known, "path", "identifier", least=2).select("page_id", "found", "remainder")


PREFIX_SQL = """
WITH p AS (SELECT page_id, '/' || regexp_replace(regexp_extract(url, '^https?://([^?#]+)', 1), '/+$', '') AS path FROM pages),
k AS (SELECT DISTINCT regexp_extract(path, '^(/[^/]+/[^/]+)', 1) AS id FROM p WHERE page_id % 3 = 0),
h AS (SELECT p.page_id, max(k.id) AS found FROM p JOIN k ON k.id <> '' AND (p.path = k.id OR starts_with(p.path, k.id || '/')) GROUP BY 1)
SELECT p.page_id, h.found, CASE WHEN h.found IS NOT NULL THEN substr(p.path, length(h.found) + 1) END AS remainder FROM p LEFT JOIN h ON h.page_id = p.page_id
"""


def dash_candidates(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.concat(F.lit("45a-"), F.col("p_partkey").cast("string")).alias("number"))
    known = part.select(F.when(F.col("p_partkey") % 2 == 0, F.translate("number", "-", "–")).when(F.col("p_partkey") % 3 == 0, F.col("number")).otherwise(F.lit("none")).alias("identifier"))
    return hierarchy.first_candidate(part, known, "number", "identifier").select("p_partkey", "found")


DASH_SQL = "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '45a–' || p_partkey WHEN p_partkey % 3 = 0 THEN '45a-' || p_partkey END AS found FROM part"


def _cited(spark, d):
    o = table(spark, d, "orders")
    t, s = (F.col("o_orderkey") % 54 + 1).cast("string"), (F.col("o_custkey") % 900 + 1).cast("string")
    forms = [
        F.concat(t, F.lit(" U.S.C. § "), s, F.lit("(a)(1)")),
        F.concat(F.lit("section "), s, F.lit("(B) of title "), t),
        F.concat(t, F.lit("/"), s, F.lit("/c/5")),
        F.concat(F.lit("/us/usc/t"), t, F.lit("/s"), s),
        F.concat(F.lit("Section "), s, F.lit("(a)(2), "), t, F.lit(" U.S.C.")),
        F.concat(t, F.lit(" usc ch. "), s),
        F.concat(F.lit("("), t, F.lit(" U. S. C. App. "), s, F.lit(" note)")),
        F.concat(F.lit("Title "), t),
        F.concat(t, F.lit(" CFR "), s),
        F.concat(t, F.lit("a USC "), s),
        F.concat(F.lit("section "), s, F.lit(" of title "), t, F.lit("a")),
    ]
    text = F.get(F.array(*forms), (F.col("o_orderkey") % 11).cast("int"))
    return o.select("o_orderkey", text.alias("text"))


def citation_parse(spark, d):
    rows = _cited(spark, d).withColumn("c", C.parse_citation(F.col("text")))
    return rows.select("o_orderkey", "c.identifier", "c.section_identifier", "c.note", "c.appendix")


CITE_SQL = """
WITH o AS (SELECT o_orderkey, o_orderkey % 11 AS f, '/us/usc/t' || (o_orderkey % 54 + 1) AS t, o_custkey % 900 + 1 AS s FROM orders)
SELECT o_orderkey, CASE f WHEN 0 THEN t || '/s' || s || '/a/1' WHEN 1 THEN t || '/s' || s || '/B' WHEN 2 THEN t || '/s' || s || '/c/5' WHEN 3 THEN t || '/s' || s WHEN 4 THEN t || '/s' || s || '/a/2'
            WHEN 5 THEN t || '/ch' || s WHEN 7 THEN t WHEN 8 THEN NULL ELSE t || 'a/s' || s END AS identifier,
       CASE f WHEN 5 THEN t || '/ch' || s WHEN 7 THEN t WHEN 8 THEN NULL ELSE t || CASE WHEN f IN (6, 9, 10) THEN 'a' ELSE '' END || '/s' || s END AS section_identifier,
       CASE WHEN f <> 8 THEN f = 6 END AS note, CASE WHEN f <> 8 THEN f IN (6, 9, 10) END AS appendix FROM o
"""


def citation_format(spark, d):
    return citation_parse(spark, d).filter("identifier is not null").select("o_orderkey", C.format_citation(F.col("identifier")).alias("written"))


FORMAT_SQL = """
WITH o AS (SELECT o_orderkey, o_orderkey % 11 AS f, CAST(o_orderkey % 54 + 1 AS VARCHAR) AS t, CAST(o_custkey % 900 + 1 AS VARCHAR) AS s FROM orders)
SELECT o_orderkey, CASE f WHEN 5 THEN t || ' U.S.C. chapter ' || s WHEN 6 THEN t || ' U.S.C. App. § ' || s WHEN 9 THEN t || ' U.S.C. App. § ' || s WHEN 10 THEN t || ' U.S.C. App. § ' || s WHEN 7 THEN 'Title ' || t
       ELSE t || ' U.S.C. § ' || s || CASE f WHEN 0 THEN '(a)(1)' WHEN 1 THEN '(B)' WHEN 2 THEN '(c)(5)' WHEN 4 THEN '(a)(2)' ELSE '' END END AS written FROM o WHERE f <> 8
"""


def date_params(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    slashed = F.concat(F.month("day").cast("string"), F.lit("/"), F.dayofmonth("day").cast("string"), F.lit("/"), F.year("day").cast("string"))
    text = F.when(F.col("o_orderkey") % 3 == 0, slashed).when(F.col("o_orderkey") % 3 == 1, F.col("day").cast("string")).otherwise(F.concat(F.lit("on "), slashed))
    prose = F.concat(F.lit("Public law of "), F.date_format("day", "MMMM d, yyyy"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" ("), slashed, F.lit(")"))).otherwise(""))
    return o.select("o_orderkey", I.parse_date(text).alias("strict"), (I.date_in_prose(prose) == F.col("day")).alias("in_prose"))


DATE_SQL = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS strict, true AS in_prose FROM orders"


def source_checks(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_type") != "error").alias("ok"), F.col("ts").cast("timestamp").alias("ts"))
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return e.select("event_id", I.is_stale(F.col("ok"), F.col("ts"), now).alias("stale"), I.hours_since(F.col("ts"), now).alias("hours"))


CHECK_SQL = "SELECT event_id, event_type = 'error' OR ts < TIMESTAMP '2024-01-20' - INTERVAL 7 DAYS AS stale, sign(epoch(TIMESTAMP '2024-01-20') - floor(epoch(ts))) * floor(abs(epoch(TIMESTAMP '2024-01-20') - floor(epoch(ts))) / 36 + 0.5) / 100 AS hours FROM events"


def reference_targets(spark, d):
    o = table(spark, d, "orders")
    n = F.col("o_orderkey")
    href = F.get(F.array(F.concat(F.lit("/us/usc/t16/s"), n.cast("string"), F.lit("#x")), F.concat(F.lit("/us/stat/90/"), n.cast("string")), F.concat(F.lit("/us/pl/"), (n % 40 + 90).cast("string"), F.lit("/"), n.cast("string")), F.lit("https://example.org")), (n % 4).cast("int"))
    r = I.resolve_reference(href)
    return o.select("o_orderkey", r.kind.alias("kind"), r.target.alias("target"))


REF_SQL = """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'code' WHEN 1 THEN 'statute' WHEN 2 THEN CASE WHEN o_orderkey % 40 + 90 >= 104 THEN 'law' ELSE 'none' END ELSE 'none' END AS kind,
       CASE o_orderkey % 4 WHEN 0 THEN '/us/usc/t16/s' || o_orderkey WHEN 1 THEN '/us/stat/90/' || o_orderkey WHEN 2 THEN CASE WHEN o_orderkey % 40 + 90 >= 104 THEN '/us/pl/' || (o_orderkey % 40 + 90) || '/' || o_orderkey END END AS target FROM orders
"""

REGISTERED = {
    "release_label_parse": (release_labels, LABEL_SQL),
    "release_label_resolution": (label_resolution, RESOLUTION_SQL),
    "title_spellings": (title_spellings, SPELL_SQL),
    "title_code_order": (title_code_order, ORDER_SQL),
    "longest_prefix_url_path": (longest_prefix_url_path, PREFIX_SQL),
    "dash_variant_lookup": (dash_candidates, DASH_SQL),
    "citation_parse": (citation_parse, CITE_SQL),
    "citation_format": (citation_format, FORMAT_SQL),
    "date_params": (date_params, DATE_SQL),
    "source_check_staleness": (source_checks, CHECK_SQL),
    "reference_targets": (reference_targets, REF_SQL),
}
