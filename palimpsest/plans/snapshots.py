"""Documents written from orders and read back by the snapshot reader: sections, notes, metadata, depths, elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import markup, shape
from palimpsest.plans.tables import table
from palimpsest.sources import documents


def _say(*parts):
    return F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))


def _some(condition: str, *parts):
    return F.when(F.expr(condition), _say(*parts)).otherwise("")


def _documents(spark, d):
    """Each order is a document of one title, its lines (by number, least part) are sections up to three levels deep;
    even orders are of the older generation, every seventh is in another encoding."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("p"))
    here = F.concat(F.lit("/us/usc/t"), "k", F.lit("/s"), "n")
    p = F.col("p").cast("string")
    third = _some("p % 4 > 2", "<clause><num>(i)</num>see <ref href='/x'>it</ref> now</clause>")
    second = _some("p % 4 > 1", "<paragraph><num>(", p, ")<footnote>So in <b>original</b>.</footnote></num>", third, "</paragraph>")
    first = _some("p % 4 > 0", "<subsection identifier='", here, "/a'><num>(a)</num>", second, "</subsection>")
    credit = _some("p % 3 = 0", "<sourceCredit>(Added  <i>", p, "</i>)</sourceCredit>")
    notes = _some("p % 2 = 0", "<notes><note topic='t", (F.col("p") % 5).cast("string"), "' role='r'><heading>On <b>", p, "</b></heading></note><note>plain</note></notes>")
    section = _say("<section identifier='", here, "' temporalId='x'><num value='", F.col("n").cast("string"), "'>", F.col("n").cast("string"), ".</num><heading>R&#233;gime é</heading>", first, credit, notes, _some("p % 5 = 0", "<note topic='own'/>"), "</section>")
    body = lines.select("k", "n", section.alias("s")).groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda x: x.s), "").alias("body"))
    k = F.col("k").cast("string")
    dc = "<dc:title xmlns:dc='http://purl.org/dc/elements/1.1/'>Title "
    old = _say("<docNumber>", k, "</docNumber>", dc, k, "</dc:title><docPublicationName>Online@1-", k, "</docPublicationName><property role='is-positive-law'>", F.when(F.expr("k % 3 = 0"), "yes").otherwise("no"), "</property>")
    new = _say("<docNumber>", k, "</docNumber><docPublicationName>Online</docPublicationName><processedBy>converter</processedBy>")
    space = F.when(F.expr("k % 2 = 0"), "http://xml.house.gov/schemas/uslm/1.0").otherwise("http://schemas.gpo.gov/xml/uslm")
    encoding = F.when(F.expr("k % 7 = 0"), "ISO-8859-1").otherwise("UTF-8")
    whole = _say("<?xml version='1.0' encoding='", encoding, "'?><uscDoc xmlns='", space, "' identifier='/us/usc/t", k, "'><meta>", F.when(F.expr("k % 2 = 0"), old).otherwise(new), "</meta><main><title identifier='/us/usc/t", k, "'><num value='", k, "'>Title ", k, "</num>", F.col("body"), "</title></main></uscDoc>")
    content = F.when(F.expr("k % 7 = 0"), F.encode(whole, "ISO-8859-1")).otherwise(F.encode(whole, "UTF-8"))
    return body.select(k.alias("path"), content.alias("content"))


def _sections(spark, d, *columns):
    return documents.parse_snapshots(_documents(spark, d), ("kind", "markup", *columns)).filter("kind = 'section'")


def snapshot_sections(spark, d):
    rows = _sections(spark, d, "path", "seq", "generation", "identifier", "temporal_id", "num", "num_value", "heading", "source_credit", "ancestor_levels", "notes")
    return rows.select("path", F.col("seq").cast("bigint").alias("seq"), "generation", "identifier", "temporal_id", "num", "num_value", "heading", "source_credit", F.array_join("ancestor_levels", "/").alias("levels"), F.size("notes").cast("bigint").alias("n_notes"), F.length(documents.plain_text(F.col("markup"))).cast("bigint").alias("n_chars"))


_LINES = """SELECT k, n, p, CAST(row_number() OVER (PARTITION BY k ORDER BY n) - 1 AS BIGINT) AS seq FROM (SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2)"""
SECTIONS_SQL = f"""
WITH l AS ({_LINES})
SELECT CAST(k AS VARCHAR) AS path, seq, CASE WHEN k % 2 = 0 THEN 'uslm-1' ELSE 'uslm-2' END AS generation, '/us/usc/t' || k || '/s' || n AS identifier, 'x' AS temporal_id, n || '.' AS num, CAST(n AS VARCHAR) AS num_value, 'Régime é' AS heading,
       CASE WHEN p % 3 = 0 THEN '(Added ' || p || ')' END AS source_credit, 'title' AS levels, CAST(CASE WHEN p % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN p % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_notes,
       length(trim(concat_ws(' ', n || '.', 'R&#233;gime é', CASE WHEN p % 4 > 0 THEN '(a)' END, CASE WHEN p % 4 > 1 THEN '(' || p || ') So in original .' END, CASE WHEN p % 4 > 2 THEN '(i) see it now' END,
         CASE WHEN p % 3 = 0 THEN '(Added ' || p || ' )' END, CASE WHEN p % 2 = 0 THEN 'On ' || p || ' plain' END))) AS n_chars
FROM l
"""


def snapshot_notes(spark, d):
    notes = documents.section_notes(documents.parse_snapshots(_documents(spark, d), ("path", "kind", "identifier", "seq", "notes")))
    return notes.select("identifier", F.col("place").cast("bigint").alias("place"), "topic", "role", "heading", "markup")


NOTES_SQL = f"""
WITH l AS ({_LINES}), s AS (SELECT '/us/usc/t' || k || '/s' || n AS identifier, p FROM l)
SELECT identifier, 0 AS place, 't' || (p % 5) AS topic, 'r' AS role, 'On ' || p AS heading, '<note topic=''t' || (p % 5) || ''' role=''r''><heading>On <b>' || p || '</b></heading></note>' AS markup FROM s WHERE p % 2 = 0
UNION ALL SELECT identifier, 1, NULL, NULL, NULL, '<note>plain</note>' FROM s WHERE p % 2 = 0
UNION ALL SELECT identifier, CASE WHEN p % 2 = 0 THEN 2 ELSE 0 END, 'own', NULL, NULL, '<note topic=''own''/>' FROM s WHERE p % 5 = 0
"""


def snapshot_metadata(spark, d):
    return documents.snapshot_metadata(_documents(spark, d))


METADATA_SQL = """
WITH o AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)
SELECT CAST(k AS VARCHAR) AS path, CASE WHEN k % 2 = 0 THEN 'uslm-1' ELSE 'uslm-2' END AS generation, '/us/usc/t' || k AS identifier, CAST(k AS VARCHAR) AS doc_number, CASE WHEN k % 2 = 0 THEN 'Title ' || k END AS doc_title,
       CASE WHEN k % 2 = 0 THEN 'Online@1-' || k ELSE 'Online' END AS doc_publication_name, CASE WHEN k % 2 = 0 THEN '1-' || k END AS release_label, CASE WHEN k % 2 = 0 THEN k % 3 = 0 END AS is_positive_law,
       CAST(NULL AS VARCHAR) AS created, CASE WHEN k % 2 <> 0 THEN 'converter' END AS converter, CAST(NULL AS VARCHAR) AS publisher, CAST(NULL AS VARCHAR) AS creator FROM o
"""


def section_depths(spark, d):
    return shape.depth_ladder(_sections(spark, d, "identifier"))


DEPTHS_SQL = f"""
WITH l AS ({_LINES}), s AS (SELECT '/us/usc/t' || k || '/s' || n AS id, p, p % 4 AS m FROM l), x AS (SELECT unnest([0, 1, 2, 3]) AS depth)
SELECT CAST(depth AS INTEGER) AS depth, count(*) FILTER (WHERE m = depth) AS n_sections, min(id) FILTER (WHERE m = depth) AS example, count(*) FILTER (WHERE depth > 0 AND m >= depth) AS n_levels, count(*) FILTER (WHERE depth = 2 AND m >= 2) AS n_footnotes,
       CASE depth WHEN 0 THEN NULL WHEN 1 THEN '(a)' WHEN 3 THEN '(i)' ELSE '(' || arg_max(p, (length(CAST(p AS VARCHAR)), CAST(p AS VARCHAR))) FILTER (WHERE m >= 2) || ')' END AS widest_num
FROM s CROSS JOIN x GROUP BY depth
"""


def inline_elements(spark, d):
    """Over whole sections; a section's own element has nothing beside it."""
    return shape.inline_elements(_sections(spark, d))


INLINE_SQL = f"""
WITH l AS ({_LINES}), c AS (SELECT count(*) AS n, count(*) FILTER (WHERE p % 4 > 0) AS a, count(*) FILTER (WHERE p % 4 > 1) AS b, count(*) FILTER (WHERE p % 4 > 2) AS c, count(*) FILTER (WHERE p % 3 = 0) AS credit, count(*) FILTER (WHERE p % 2 = 0) AS even, count(*) FILTER (WHERE p % 5 = 0) AS own FROM l)
SELECT name, CAST(inline AS BIGINT) AS inline, CAST(isolated AS BIGINT) AS isolated FROM (
  SELECT 'section' AS name, 0 AS inline, n AS isolated FROM c UNION ALL SELECT 'heading', 0, n + even FROM c UNION ALL SELECT 'num', c, n + a + b FROM c UNION ALL SELECT 'subsection', 0, a FROM c UNION ALL SELECT 'paragraph', 0, b FROM c
  UNION ALL SELECT 'clause', 0, c FROM c UNION ALL SELECT 'ref', c, 0 FROM c UNION ALL SELECT 'footnote', b, 0 FROM c UNION ALL SELECT 'b', b + even, 0 FROM c UNION ALL SELECT 'sourceCredit', 0, credit FROM c UNION ALL SELECT 'i', credit, 0 FROM c
  UNION ALL SELECT 'notes', 0, even FROM c UNION ALL SELECT 'note', 0, 2 * even + own FROM c) WHERE inline + isolated > 0
"""


def section_contents(spark, d):
    """Entries of each section's own contents, in order."""
    rows = _sections(spark, d, "identifier")
    return rows.select("identifier", F.posexplode(markup.contents(F.col("markup"))).alias("place", "e")).select("identifier", F.col("place").cast("bigint").alias("place"), "e.*")


CONTENTS_SQL = f"""
WITH l AS ({_LINES}), s AS (SELECT '/us/usc/t' || k || '/s' || n AS identifier, p FROM l),
e AS (SELECT identifier, 1 AS o, identifier || '/a' AS anchor, '(a)' AS num FROM s WHERE p % 4 > 0 UNION ALL SELECT identifier, 2, 'source', 'Source credit' FROM s WHERE p % 3 = 0 UNION ALL SELECT identifier, 3, 'notes', 'Notes' FROM s WHERE p % 2 = 0)
SELECT identifier, CAST(row_number() OVER (PARTITION BY identifier ORDER BY o) - 1 AS BIGINT) AS place, anchor, num, CAST(NULL AS VARCHAR) AS heading FROM e
"""


def section_identifiers(spark, d):
    """Identifiers that can be copied from inside each section."""
    rows = _sections(spark, d, "identifier")
    return rows.select("identifier", F.array_join(markup.level_identifiers(F.col("markup")), " ").alias("inner"))


INNER_SQL = f"WITH l AS ({_LINES}) SELECT '/us/usc/t' || k || '/s' || n AS identifier, CASE WHEN p % 4 > 0 THEN '/us/usc/t' || k || '/s' || n || '/a' ELSE '' END AS inner FROM l"


REGISTERED = {
    "snapshot_sections": (snapshot_sections, SECTIONS_SQL),
    "snapshot_notes": (snapshot_notes, NOTES_SQL),
    "section_contents": (section_contents, CONTENTS_SQL),
    "section_identifiers": (section_identifiers, INNER_SQL),
    "snapshot_metadata": (snapshot_metadata, METADATA_SQL),
    "section_depths": (section_depths, DEPTHS_SQL),
    "inline_elements": (inline_elements, INLINE_SQL),
}
