"""Composite lookups, listings, checks and search profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import ledger, resolve, search
from palimpsest.plans.identifiers import CITE_SQL, _cited
from palimpsest.plans.tables import document_index, table


def _concat(*parts):
    return F.concat(*(F.lit(p) if p.startswith(("/", "<", '"', " ", ">")) else F.col(p).cast("string") for p in parts))


def get_section(spark, d):
    """Orders as sections of five titles, line numbers as releases, a third of the loads unfinished; every fourth
    section stands twice, first as a stub."""
    placed = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("seq"), F.col("l_partkey").alias("p"))
    title, identifier = F.col("k") % 5 + 1, _concat("/us/usc/t", "title", "/s", "k")
    line = placed.groupBy("k", "seq").agg(F.min("p").alias("p")).withColumn("title", title).withColumn("identifier", identifier)
    loads = placed.select(title.alias("title"), "seq").distinct().withColumn("sections_loaded", F.when((F.col("title") + F.col("seq")) % 3 != 0, 1))
    keys = placed.select("k").distinct().withColumn("title", title).withColumn("identifier", identifier)
    number = F.col("k") * 10 + F.col("seq")
    whole = line.select("identifier", "seq", number.alias("version_id"), F.col("k").alias("seq_in_title"), "p", F.lit(False).alias("stub"))
    stubs = line.filter("k % 4 = 0").select("identifier", "seq", (-number).alias("version_id"), (F.col("k") - 1).alias("seq_in_title"), "p", F.lit(True).alias("stub"))
    rows = whole.unionByName(stubs)
    full = _concat('<section xmlns="u" identifier="', "identifier", '"><subsection identifier="', "identifier", '/a"><num>(a)</num> part ', "p", " &amp; more</subsection></section>")
    markup = F.when(F.col("stub"), _concat('<section xmlns="u" identifier="', "identifier", '"/>')).otherwise(full)
    versions = rows.select("version_id", F.lit("h").alias("heading"), markup.alias("markup"), F.col("seq").alias("first_seq"))
    placements = rows.select("identifier", "seq", "version_id", "seq_in_title", F.lit("/us/usc").alias("parent_identifier"))
    sections = keys.select("identifier", "title")
    below = F.get(F.array(F.lit(""), F.lit("/a"), F.lit("/zz")), (F.col("k") % 3).cast("int"))
    asked = keys.select(F.concat("identifier", below).alias("identifier"), F.lit(4).alias("seq"))
    out = resolve.get_sections(asked, sections, loads, placements, versions)
    return out.select("identifier", "section", "served_seq", "version_id", "n_occurrences", "found", "provision")


SECTION_SQL = """
WITH l AS (SELECT l_orderkey AS k, l_linenumber AS s, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
t AS (SELECT DISTINCT k, '/us/usc/t' || (k % 5 + 1) || '/s' || k AS id, CASE WHEN (k % 5 + 5) % 3 <> 0 THEN 4 ELSE 3 END AS served FROM l)
SELECT id || CASE t.k % 3 WHEN 0 THEN '' WHEN 1 THEN '/a' ELSE '/zz' END AS identifier, CASE WHEN p IS NOT NULL THEN id END AS section, CASE WHEN p IS NOT NULL THEN served END AS served_seq,
       CASE WHEN p IS NOT NULL THEN CASE WHEN t.k % 4 = 0 THEN -1 ELSE 1 END * (t.k * 10 + served) END AS version_id, CASE WHEN p IS NOT NULL THEN CAST(CASE WHEN t.k % 4 = 0 THEN 2 ELSE 1 END AS BIGINT) END AS n_occurrences,
       CASE WHEN p IS NOT NULL AND t.k % 3 <> 0 THEN t.k % 3 = 1 END AS found,
       CASE WHEN p IS NOT NULL AND t.k % 3 = 1 THEN '<subsection xmlns="u" identifier="' || id || '/a"><num>(a)</num> part ' || p || ' &amp; more</subsection>' END AS provision
FROM t LEFT JOIN l ON l.k = t.k AND l.s = t.served
"""


def citation_lookup(spark, d):
    """Sections of every other order, and all titles, are known."""
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 54 + 1).alias("t"), (F.col("o_custkey") % 900 + 1).alias("s"))
    sections = o.filter("o_orderkey % 2 = 0").select(_concat("/us/usc/t", "t", "/s", "s").alias("identifier"))
    nodes = o.select(_concat("/us/usc/t", "t").alias("identifier"))
    return resolve.lookup_citations(_cited(spark, d), sections, nodes).select("o_orderkey", "status", "identifier", "actual", "message")


LOOKUP_SQL = f"""
WITH c AS ({CITE_SQL}), k AS (SELECT DISTINCT '/us/usc/t' || (o_orderkey % 54 + 1) || '/s' || (o_custkey % 900 + 1) AS id FROM orders WHERE o_orderkey % 2 = 0),
a AS (SELECT c.*, CASE WHEN c.o_orderkey % 11 = 7 THEN c.identifier ELSE k.id END AS actual FROM c LEFT JOIN k ON k.id = c.section_identifier)
SELECT o_orderkey, CASE WHEN identifier IS NULL THEN 'unread' WHEN actual IS NOT NULL THEN 'found' ELSE 'absent' END AS status, identifier, actual,
       CASE WHEN identifier IS NOT NULL AND actual IS NULL AND appendix THEN 'appendices are published under the laws that enacted them; no flat number such as ' || identifier || ' can be looked up' END AS message FROM a
"""


def release_precedence(spark, d):
    """Requests by label, by date, by title or by nothing, against a release a day."""
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("currency_date")).distinct()
    releases = days.select("currency_date", F.datediff("currency_date", F.lit("1990-01-01")).alias("seq")).withColumn("label", _concat('"', "seq"))
    loads = releases.select((F.col("seq") % 7).alias("title"), "seq", F.when(F.col("seq") % 2 == 0, 1).alias("sections_loaded"))
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 4).alias("f"))
    asked = c.select("c_custkey", F.when(F.col("f") == 0, _concat('"', "c_custkey")).alias("label"), F.when(F.col("f") <= 1, F.expr("date_add(date'1992-01-01', cast(c_custkey as int))")).alias("date"), F.when(F.col("f") <= 2, F.col("c_custkey").cast("int") % 7).alias("title"))
    return resolve.resolve_releases(asked, releases, loads).select("c_custkey", "resolved_seq", "via")


PRECEDENCE_SQL = """
WITH r AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(CAST(o_orderdate AS DATE) - DATE '1990-01-01' AS INTEGER) AS seq FROM orders), c AS (SELECT c_custkey, c_custkey % 4 AS f FROM customer)
SELECT c_custkey, CASE f WHEN 0 THEN (SELECT seq FROM r WHERE seq = c_custkey) WHEN 1 THEN (SELECT max(seq) FROM r WHERE day <= DATE '1992-01-01' + CAST(c_custkey AS INTEGER))
       WHEN 2 THEN (SELECT max(seq) FROM r WHERE seq % 7 = c_custkey % 7 AND seq % 2 = 0) ELSE (SELECT max(seq) FROM r) END AS resolved_seq, CASE f WHEN 0 THEN 'label' WHEN 1 THEN 'date' ELSE 'latest' END AS via FROM c
"""


def title_listing(spark, d):
    titles = table(spark, d, "nation").select(F.col("n_nationkey").alias("title"), "n_name")
    loads = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("title"), (F.col("c_custkey") % 7).alias("seq")).agg(F.count("*").alias("n")).filter("title % 6 <> 0")
    return resolve.list_titles(titles, loads.select("title", "seq", F.when(F.col("n") % 5 != 0, F.col("n")).alias("sections_loaded")))


TITLES_SQL = """
WITH l AS (SELECT c_nationkey AS title, c_custkey % 7 AS seq, count(*) AS n FROM customer WHERE c_nationkey % 6 <> 0 GROUP BY 1, 2), g AS (SELECT title, count(*) AS n_loads, max(seq) AS newest_seq, arg_max(n, seq) AS n_sections FROM l WHERE n % 5 <> 0 GROUP BY 1)
SELECT n_nationkey AS title, n_name, coalesce(n_loads, 0) AS n_loads, newest_seq, n_sections FROM nation LEFT JOIN g ON g.title = n_nationkey
"""


def current_placements(spark, d):
    """Parts as sections, suppliers as versions, ship months as releases."""
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("int")
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("identifier"), F.col("l_suppkey").alias("version_id"), month.alias("seq"), F.col("l_linenumber").alias("seq_in_title"))
    return resolve.current_placements(rows, rows.groupBy("version_id").agg(F.min("seq").alias("first_seq")))


PLACEMENT_SQL = """
WITH p AS (SELECT l_partkey AS identifier, l_suppkey AS version_id, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS seq, l_linenumber AS seq_in_title FROM lineitem),
v AS (SELECT version_id, min(seq) AS first_seq FROM p GROUP BY 1), n AS (SELECT *, row_number() OVER (PARTITION BY identifier ORDER BY seq DESC, seq_in_title, version_id) AS r FROM p),
f AS (SELECT identifier, version_id, seq AS first_seq, min(seq_in_title) AS first_place FROM p GROUP BY 1, 2, 3)
SELECT n.identifier, n.version_id, n.seq, n.seq_in_title, v.first_seq, f.first_place FROM n JOIN v USING (version_id) LEFT JOIN f ON f.identifier = n.identifier AND f.version_id = n.version_id AND f.first_seq = v.first_seq WHERE r = 1
"""


def _checks(spark, d):
    recorded = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", (F.col("o_custkey") % 7).alias("n_recorded"))
    return ledger.compare_counts(recorded, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"]).filter("o_orderstatus is not null")


_CHECKS = "c AS (SELECT o_orderstatus, o_orderpriority, o_custkey % 7 AS r, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS a FROM orders WHERE o_orderstatus IS NOT NULL)"


def verification_report(spark, d):
    return ledger.verification_report(_checks(spark, d), ["o_orderstatus"])


REPORT_SQL = f"WITH {_CHECKS} SELECT o_orderstatus, count(*) AS n_checked, count(*) FILTER (WHERE a <> r) AS n_wrong, bool_and(a = r) AS sound FROM c GROUP BY 1"


def modal_gap(spark, d):
    return ledger.modal_gap(_checks(spark, d), ["o_orderpriority"])


GAP_SQL = f"""
WITH {_CHECKS}, g AS (SELECT o_orderpriority, a - r AS gap, count(*) AS n FROM c WHERE a <> r GROUP BY 1, 2)
SELECT DISTINCT ON (o_orderpriority) o_orderpriority, gap, n FROM g ORDER BY o_orderpriority, n DESC, gap
"""


def step_summary(spark, d):
    calls = table(spark, d, "events").select(F.col("event_type").alias("step"), (F.col("user_id") % 6 * 100).alias("code"), F.col("value").alias("ms"), F.col("event_id").alias("bytes"))
    out = ledger.step_summary(calls)
    return out.withColumn("codes", F.array_join(F.transform(F.map_entries("codes"), lambda e: F.concat_ws("=", e.key, e.value)), ","))


STEP_SQL = """
WITH c AS (SELECT event_type AS step, user_id % 6 * 100 AS code, value AS ms, event_id AS bytes FROM events), n AS (SELECT step, count(*) AS n, count(*) FILTER (WHERE code > 0 AND code < 400) AS n_ok FROM c GROUP BY 1),
v AS (SELECT step, list(ms ORDER BY ms) AS m, list(bytes ORDER BY bytes) AS b, count(*) AS k FROM c WHERE code > 0 AND code < 400 GROUP BY 1),
h AS (SELECT step, string_agg(code || '=' || x, ',' ORDER BY code) AS codes FROM (SELECT step, code, count(*) AS x FROM c GROUP BY 1, 2) GROUP BY 1)
SELECT n.step, n, n_ok, m[greatest(1, least(k, CAST(floor(0.5 * k + 0.5) AS BIGINT)))] AS p50, m[greatest(1, least(k, CAST(floor(0.95 * k + 0.5) AS BIGINT)))] AS p95,
       b[least(k - 1, CAST(floor(0.5 * k) AS BIGINT)) + 1] AS median_bytes, codes FROM n LEFT JOIN v USING (step) LEFT JOIN h USING (step)
"""

_TERMS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_HEADING = "split_part(text, chr(10), 1)"


def _profiled(spark, d):
    queries = table(spark, d, "region").limit(1).select(F.explode(F.array(F.struct(F.lit("two").alias("query"), F.lit("of the").alias("text")), F.struct(F.lit("one").alias("query"), F.lit("with").alias("text")))).alias("q")).select("q.*")
    return document_index(spark, d).profile_scores(queries, search.PROFILES["phrase"])


def search_profile(spark, d):
    """A phrase of two words and a single word, under the profile with boosts, over first lines and whole texts."""
    return _profiled(spark, d).select("query", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


def _field_sql(name: str, text: str) -> str:
    return f"""
w_{name} AS (SELECT doc_id, {_TERMS.format(text)} AS w FROM documents), n_{name} AS (SELECT count(*) AS n, avg(len(w)) AS a FROM w_{name}),
t_{name} AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM w_{name}) WHERE term IN ('of', 'the', 'with') GROUP BY 1, 2, 3),
i_{name} AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM t_{name}, n_{name} GROUP BY 1),
s_{name} AS (SELECT query, doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS score FROM t_{name} JOIN i_{name} USING (term) JOIN q USING (term), n_{name} GROUP BY 1, 2),
p_{name} AS (SELECT 'two' AS query, doc_id, (SELECT sum(idf) FROM i_{name} WHERE term IN ('of', 'the')) AS score FROM w_{name}
             WHERE len(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'of' AND list_contains(w[i + 1:i + 3], 'the'))) > 0)"""


PROFILE_SQL = f"""
WITH q(query, term) AS (VALUES ('two', 'of'), ('two', 'the'), ('one', 'with')), {_field_sql("h", _HEADING)}, {_field_sql("b", "text")},
u AS (SELECT query, doc_id, 10 * score AS score FROM s_h UNION ALL SELECT * FROM s_b UNION ALL SELECT query, doc_id, 8 * score FROM p_h UNION ALL SELECT query, doc_id, 4 * score FROM p_b)
SELECT query, doc_id, round(sum(score), 6) AS score FROM u GROUP BY 1, 2
"""


def search_page(spark, d):
    """The second ten of a search in the order of sources, missing ones last, then by score."""
    hits = _profiled(spark, d).filter("query = 'two'").select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))
    hits = hits.join(table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("sort_key")), "doc_id")
    return search.page(search.sort_hits(hits, "citation", "doc_id"), limit=10, offset=10)


PAGE_SQL = f"""
SELECT doc_id, s.score, CASE WHEN doc_id % 3 <> 0 THEN source END AS sort_key FROM ({PROFILE_SQL}) s JOIN documents USING (doc_id) WHERE s.query = 'two' ORDER BY sort_key NULLS LAST, score DESC, doc_id LIMIT 10 OFFSET 10
"""

REGISTERED = {
    "get_section": (get_section, SECTION_SQL),
    "citation_lookup": (citation_lookup, LOOKUP_SQL),
    "release_precedence": (release_precedence, PRECEDENCE_SQL),
    "title_listing": (title_listing, TITLES_SQL),
    "current_placements": (current_placements, PLACEMENT_SQL),
    "verification_report": (verification_report, REPORT_SQL),
    "modal_gap": (modal_gap, GAP_SQL),
    "step_summary": (step_summary, STEP_SQL),
    "search_profile": (search_profile, PROFILE_SQL),
    "search_page": (search_page, PAGE_SQL),
}
