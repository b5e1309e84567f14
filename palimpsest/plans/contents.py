"""Trees, markup and differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import identifiers as I
from palimpsest.functions import blocks
from palimpsest.operators import hierarchy, redline
from palimpsest.plans.tables import table


def _nodes(spark, d):
    """The world, regions, nations and suppliers as one tree."""
    r, n, s = (table(spark, d, x) for x in ("region", "nation", "supplier"))
    root = r.limit(1).select(F.lit("w").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).cast("bigint").alias("place"))
    return (
        root.unionByName(r.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("w").alias("parent_id"), F.col("r_regionkey").cast("bigint").alias("place")))
        .unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_nationkey").cast("bigint").alias("place")))
        .unionByName(s.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("parent_id"), F.col("s_suppkey").alias("place")))
    )


def tree_breadcrumb(spark, d):
    return hierarchy.breadcrumbs(_nodes(spark, d)).select("id", F.array_join("path", "/").alias("path"))


BREADCRUMB_SQL = """
SELECT 'w' AS id, 'w' AS path UNION ALL SELECT 'r' || r_regionkey, 'w/r' || r_regionkey FROM region
UNION ALL SELECT 'n' || n_nationkey, 'w/r' || n_regionkey || '/n' || n_nationkey FROM nation
UNION ALL SELECT 's' || s_suppkey, 'w/r' || n_regionkey || '/n' || n_nationkey || '/s' || s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey
"""


def toc_siblings(spark, d):
    nodes = _nodes(spark, d).filter("parent_id is not null")
    return hierarchy.sibling_order(nodes, "parent_id", "place").select("parent_id", "id", F.col("sibling").cast("bigint").alias("sibling"))


SIBLING_SQL = """
WITH n AS (SELECT 'r' || r_regionkey AS id, 'w' AS parent_id, r_regionkey AS place FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_suppkey FROM supplier)
SELECT parent_id, id, row_number() OVER (PARTITION BY parent_id ORDER BY place) - 1 AS sibling FROM n
"""


def structure_upsert(spark, d):
    """Observations of a customer in orders; descriptive fields follow the newest."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("identifier"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("heading"))
    return hierarchy.merge_structure(o)


STRUCTURE_SQL = """
SELECT o_custkey AS identifier, min(o_orderkey) AS first_seq, max(o_orderkey) AS last_seq, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_orderpriority, o_orderkey) AS heading FROM orders GROUP BY 1
"""


def toc_leaves(spark, d):
    """Sections (parts) under parents (orders) in one release (ship month), in reading order."""
    line = table(spark, d, "lineitem").select(F.col("l_partkey").alias("version_id"), F.concat(F.lit("o"), "l_orderkey").alias("parent_identifier"), F.date_format("l_shipdate", "yyyy-MM").alias("release_seq"), F.col("l_linenumber").alias("seq_in_title"))
    version = table(spark, d, "part").select(F.col("p_partkey").alias("version_id"), F.col("p_brand").alias("section_id"), F.col("p_name").alias("heading"), F.col("p_type").alias("status"))
    section = version.select("section_id").distinct().withColumn("identifier", F.concat(F.lit("/s/"), "section_id"))
    return hierarchy.leaves(section, version, line.filter("release_seq = '1997-03'"))


LEAVES_SQL = """
SELECT '1997-03' AS release_seq, 'o' || l_orderkey AS parent_identifier, '/s/' || p_brand AS identifier, p_name AS heading, p_type AS status, l_linenumber AS seq_in_title
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE strftime(l_shipdate, '%Y-%m') = '1997-03'
"""


def guid_resolution(spark, d):
    o = table(spark, d, "orders")
    pins = o.select(F.concat(F.lit("g"), "o_orderkey").alias("guid"), F.lit(1).alias("release_id"), F.concat(F.lit("/us/usc/t"), F.col("o_custkey") % 50, F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.concat(F.lit("/s"), F.col("o_custkey"), F.lit("/a/1")))).alias("identifier"))
    nodes = o.select(F.concat(F.lit("/us/usc/t"), F.col("o_custkey") % 50).alias("identifier")).distinct()
    sections = o.filter("o_custkey % 3 = 0").select(F.concat(F.lit("/us/usc/t"), F.col("o_custkey") % 50, F.lit("/s"), "o_custkey").alias("identifier")).distinct()
    asked = o.select(F.concat(F.lit("g"), F.col("o_orderkey") + F.when(F.col("o_orderkey") % 7 == 0, 10**9).otherwise(0)).alias("guid"))
    return hierarchy.resolve_pins(asked, pins, nodes, sections).select("guid", "kind", "section", "remainder")


GUID_SQL = """
SELECT 'g' || (o_orderkey + CASE WHEN o_orderkey % 7 = 0 THEN 1000000000 ELSE 0 END) AS guid,
       CASE WHEN o_orderkey % 7 = 0 THEN 'missing' WHEN o_orderkey % 4 = 0 THEN 'node' WHEN o_custkey % 3 = 0 THEN 'section' ELSE 'missing' END AS kind,
       CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 4 <> 0 AND o_custkey % 3 = 0 THEN '/us/usc/t' || (o_custkey % 50) || '/s' || o_custkey END AS section,
       CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 4 <> 0 AND o_custkey % 3 = 0 THEN '/a/1' END AS remainder FROM orders
"""


def strip_tags_pages(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(I.strip_tags(F.col("html"))).alias("text_md5"), F.length(I.strip_tags(F.col("html"))).cast("bigint").alias("n"))


STRIP_SQL = "WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS x FROM pages) SELECT page_id, md5(x) AS text_md5, length(x) AS n FROM t"


def hrefs_pages(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(I.link_targets(F.col("html"))).alias("pos", "href")).select("page_id", F.col("pos").cast("bigint").alias("pos"), "href")


HREF_SQL = """
WITH l AS (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1) AS h FROM pages) SELECT page_id, unnest(range(len(h))) AS pos, unnest(h) AS href FROM l
"""


def cited_identifiers(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(I.cited_identifiers(I.link_targets(F.col("html")), "/t"), " ").alias("cited"))


CITED_SQL = """
WITH l AS (SELECT page_id, list_filter(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1), lambda x: starts_with(x, '/t')) AS h FROM pages),
u AS (SELECT page_id, regexp_replace(unnest(h), '[?#].*$', '') AS x, unnest(range(len(h))) AS p FROM l), f AS (SELECT page_id, x, min(p) AS p FROM u GROUP BY 1, 2)
SELECT l.page_id, coalesce(string_agg(f.x, ' ' ORDER BY f.p), '') AS cited FROM l LEFT JOIN f ON f.page_id = l.page_id GROUP BY 1
"""


def content_keys(spark, d):
    html = F.concat(F.lit('<x id="'), F.col("page_id").cast("string"), F.lit("\" xml:id='k'>"), F.col("html"))
    return table(spark, d, "pages").select("page_id", I.content_hash(html).alias("content_hash"), I.source_delta(html, F.replace(html, F.lit(' id="'), F.lit(' id="z'))).alias("delta"))


KEY_SQL = """
SELECT page_id, sha256(regexp_replace('<x xml:id=''k''>' || html, '\\sid=("[^"]*"|''[^'']*'')', '', 'g')) AS content_hash, 'ids-only' AS delta FROM pages
"""


def _pairs(spark, d):
    """Each document with the next one of its source."""
    from pyspark.sql import Window as W

    docs = table(spark, d, "documents")
    return docs.withColumn("old", F.lag("text").over(W.partitionBy("source").orderBy("doc_id"))).filter("old is not null").select("doc_id", "old", F.col("text").alias("new"))


def line_multiset_diff(spark, d):
    out = redline.line_multiset_diff(_pairs(spark, d), "doc_id", "old", "new")
    return out.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum("n_old").alias("n_old"), F.sum("n_new").alias("n_new"))


MULTISET_SQL = """
WITH p AS (SELECT doc_id, text, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS old FROM documents),
x AS (SELECT doc_id, unnest(string_split(old, chr(10))) AS line, 0 AS s FROM p WHERE old IS NOT NULL UNION ALL SELECT doc_id, unnest(string_split(text, chr(10))), 1 FROM p WHERE old IS NOT NULL),
g AS (SELECT doc_id, line, count(*) FILTER (WHERE s = 0) AS o, count(*) FILTER (WHERE s = 1) AS n FROM x GROUP BY 1, 2)
SELECT doc_id, count(*) AS n_lines, CAST(sum(o) AS BIGINT) AS n_old, CAST(sum(n) AS BIGINT) AS n_new FROM g WHERE o <> n GROUP BY 1
"""


def document_diff(spark, d):
    """Line redline of every conversation turn against the one before it."""
    from pyspark.sql import Window as W

    turns = table(spark, d, "conversations").withColumn("old", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))).filter("old is not null")
    ops = redline.document_diff(F.col("old"), F.col("text"))
    rows = turns.select("conv_id", "turn", ops.alias("ops"))
    return rows.select("conv_id", "turn", redline.diff_summary(F.col("ops")).alias("summary"), F.size("ops").alias("n_ops"))


def _section_versions(spark, d):
    """Orders with their first two lines as versions of a section: (a) names the part, the old one may have a (b), the new
    one a note; both have a note inside a sentence, and the new one is indented in another way."""
    line = table(spark, d, "lineitem").filter("l_linenumber <= 2").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.min(F.when(F.col("l_linenumber") == 1, F.col("l_partkey"))).alias("p"), F.min(F.when(F.col("l_linenumber") == 2, F.col("l_partkey"))).alias("q")
    ).filter("p is not null and q is not null")

    def markup(part, gap, more):
        head = F.concat(F.lit("<section><num>§ "), F.col("k").cast("string"), F.lit(".</num>" + gap + "<heading>Supply</heading>" + gap))
        body = F.concat(F.lit("<subsection><num>(a)</num><chapeau>Whoever needs part "), F.col(part).cast("string"), F.lit(",<note>see below</note> shall<i>soon</i> order it.</chapeau></subsection>"))
        return F.concat(head, body, more, F.lit("</section>"))

    second = F.when(F.col("p") % 2 == 0, "<subsection><num>(b)</num><content>No more than one.</content></subsection>").otherwise("")
    note = F.when(F.col("q") % 3 == 0, "<notes><note><heading>History</heading><p>Added later.</p></note></notes>").otherwise("")
    return line.select("k", "p", "q", markup("p", "", second).alias("old"), markup("q", "\n  ", note).alias("new"))


def reading_lines(spark, d):
    """The lines of every section's old version."""
    rows = _section_versions(spark, d).select("k", F.posexplode(blocks.reading_blocks("old")).alias("at", "line"))
    return rows.select("k", F.col("at").cast("bigint").alias("at"), F.col("line.depth").cast("bigint").alias("depth"), "line.kind", "line.text")


_TWO_SQL = "SELECT a.l_orderkey AS k, min(a.l_partkey) AS p, min(b.l_partkey) AS q FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2 GROUP BY 1"
READING_SQL = f"""
WITH s AS ({_TWO_SQL})
SELECT k, CAST(0 AS BIGINT) AS at, CAST(1 AS BIGINT) AS depth, 'text' AS kind, '§ ' || k || '. Supply' AS text FROM s
UNION ALL SELECT k, 1, 2, 'text', '(a) Whoever needs part ' || p || ',see below shallsoon order it.' FROM s
UNION ALL SELECT k, 2, 2, 'text', '(b) No more than one.' FROM s WHERE p % 2 = 0
"""


def section_redline(spark, d):
    """Every section's new version against its old one: summary, marked line of (a), characters of markup that differ."""
    rows = _section_versions(spark, d).select("k", redline.block_diff(blocks.reading_blocks("old"), blocks.reading_blocks("new")).alias("d"))
    marks = F.transform(F.get("d", F.lit(1)).spans, lambda s: F.when(s.op == "equal", s.text).otherwise(F.concat(F.substring(s.op, 1, 1), F.lit("<"), s.text, F.lit(">"))))
    return rows.select("k", redline.diff_summary(F.col("d")).alias("summary"), F.concat_ws("", marks).alias("marked"), F.size("d").cast("bigint").alias("n_lines"))


REDLINE_SQL = f"""
WITH s AS ({_TWO_SQL})
SELECT k, CASE WHEN p = q AND p % 2 <> 0 AND q % 3 <> 0 THEN 'No changes' ELSE
    concat_ws(', ', CASE WHEN p <> q THEN '1 line changed' END, CASE WHEN q % 3 = 0 THEN '2 lines added' END, CASE WHEN p % 2 = 0 THEN '1 line removed' END) END AS summary,
  '(a) Whoever needs part ' || CASE WHEN p = q THEN p || ',see' ELSE 'd<' || p || ',see>i<' || q || ',see>' END || ' below shallsoon order it.' AS marked,
  CAST(2 + CASE WHEN p % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN q % 3 = 0 THEN 2 ELSE 0 END AS BIGINT) AS n_lines FROM s
"""


REGISTERED = {
    "tree_breadcrumb": (tree_breadcrumb, BREADCRUMB_SQL),
    "toc_sibling_order": (toc_siblings, SIBLING_SQL),
    "structure_upsert": (structure_upsert, STRUCTURE_SQL),
    "toc_leaves": (toc_leaves, LEAVES_SQL),
    "guid_resolution": (guid_resolution, GUID_SQL),
    "strip_tags_pages": (strip_tags_pages, STRIP_SQL),
    "hrefs_pages": (hrefs_pages, HREF_SQL),
    "cited_identifiers_pages": (cited_identifiers, CITED_SQL),
    "content_keys_pages": (content_keys, KEY_SQL),
    "line_multiset_diff": (line_multiset_diff, MULTISET_SQL),
    "document_diff": (document_diff, None),
    "reading_lines": (reading_lines, READING_SQL),
    "section_redline": (section_redline, REDLINE_SQL),
}
