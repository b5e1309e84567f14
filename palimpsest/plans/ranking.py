"""Search, facets and relevance over documents."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators import search
from palimpsest.plans.tables import document_index, table

_TERMS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


def term_frequencies(spark, d):
    return document_index(spark, d).lexicon("body").select("term", "df", "cf")


TF_SQL = f"WITH p AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM p GROUP BY 1"

#: Words that the corpora of the test tables hold often.
QUERY = ("with", "from", "this")


def _queries(spark, d):
    """Each of three words as a query, and all three as one."""
    one = table(spark, d, "region").limit(1)
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(q).alias("query"), F.lit(t).alias("term")) for q, t in [*((w, w) for w in QUERY), *(("all", w) for w in QUERY)]))).alias("r"))
    return rows.select("r.*")


def search_bm25(spark, d):
    return document_index(spark, d).scores(_queries(spark, d), {"body": 1.0}).select("query", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


BM25_SQL = f"""
WITH w AS (SELECT doc_id, {_TERMS} AS w FROM documents), n AS (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl FROM w),
q(query, term) AS (VALUES ('with', 'with'), ('from', 'from'), ('this', 'this'), ('all', 'with'), ('all', 'from'), ('all', 'this')),
p AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM w), t AS (SELECT doc_id, dl, term, count(*) AS tf FROM p WHERE term IN ('with', 'from', 'this') GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM t GROUP BY 1)
SELECT query, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
FROM t JOIN df USING (term) JOIN q USING (term), n GROUP BY 1, 2
"""


def search_top(spark, d):
    """The ten best of each query; blocks that can't hold one are not scored."""
    return document_index(spark, d).top(_queries(spark, d), {"body": 1.0}).select("query", F.col("rank").cast("bigint").alias("rank"), F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


TOP_SQL = f"SELECT * FROM (SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM ({BM25_SQL})) WHERE rank <= 10"


def _matching(spark, d, expression):
    return document_index(spark, d).match(expression).select(F.col("doc").alias("doc_id"))


def _any(word):
    return f"list_contains(w, '{word}')"


def search_boolean(spark, d):
    return _matching(spark, d, "with from | (this -heat)")


BOOLEAN_SQL = f"WITH t AS (SELECT doc_id, {_TERMS} AS w FROM documents) SELECT doc_id FROM t WHERE ({_any('with')} AND {_any('from')}) OR ({_any('this')} AND NOT {_any('heat')})"


def search_phrase(spark, d):
    return _matching(spark, d, '"of the"')


PHRASE_SQL = f"WITH t AS (SELECT doc_id, {_TERMS} AS w FROM documents) SELECT doc_id FROM t WHERE len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) > 0"


def search_prefix_fuzzy(spark, d):
    return _matching(spark, d, "ereat* wth~1")


FUZZY_SQL = f"WITH t AS (SELECT doc_id, {_TERMS} AS w FROM documents) SELECT doc_id FROM t WHERE len(list_filter(w, lambda x: starts_with(x, 'ereat'))) > 0 AND len(list_filter(w, lambda x: levenshtein(x, 'wth') <= 1)) > 0"


def search_collapse(spark, d):
    """One hit per source: the newest, ordered by the source's best score."""
    index = document_index(spark, d)
    hits = index.scores(_queries(spark, d).filter("query = 'all'"), {"body": 1.0}).join(index.documents, "doc").select(F.col("doc").alias("doc_id"), "source", F.round("score", 6).alias("score"))
    return search.collapse(hits, "source", "doc_id").select("source", "doc_id", "score", "best")


COLLAPSE_SQL = f"""
WITH h AS (SELECT s.doc_id, s.score, d.source FROM ({BM25_SQL}) s JOIN documents d ON d.doc_id = s.doc_id WHERE s.query = 'all')
SELECT DISTINCT ON (source) source, doc_id, score, max(score) OVER (PARTITION BY source) AS best FROM h ORDER BY source, doc_id DESC
"""


def facets(spark, d):
    docs = table(spark, d, "documents").withColumn("status", F.when(F.col("doc_id") % 3 == 0, F.col("lang")))
    out = search.facet(docs, "source", 20).withColumn("facet", F.lit("source"))
    return out.unionByName(search.facet(docs, "status", 10).withColumn("facet", F.lit("status"))).select("facet", "value", "n")


FACET_SQL = """
(SELECT 'source' AS facet, source AS value, count(*) AS n FROM documents GROUP BY 2 ORDER BY n DESC, value LIMIT 20)
UNION ALL (SELECT 'status', coalesce(CASE WHEN doc_id % 3 = 0 THEN lang END, 'none') AS value, count(*) AS n FROM documents GROUP BY 2 ORDER BY n DESC, value LIMIT 10)
"""


def scoped_search(spark, d):
    q = search.parse_query('title:t1 title:2 status:none "of the" from')
    docs = document_index(spark, d).match(q.text).select(F.col("doc").alias("doc_id"))
    docs = docs.withColumns({"title_num": (F.col("doc_id") % 5).cast("string"), "status": F.when(F.col("doc_id") % 2 == 0, "live")})
    return docs.filter(search.filter_column(q)).select("doc_id")


SCOPED_SQL = f"""
WITH t AS (SELECT doc_id, {_TERMS} AS w FROM documents) SELECT doc_id FROM t WHERE doc_id % 5 IN (1, 2) AND doc_id % 2 <> 0 AND {_any('from')}
AND len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) > 0
"""


def distinct_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("n_identifiers"), F.count("*").alias("total"))


DISTINCT_SQL = "SELECT event_type, count(DISTINCT user_id) AS n_identifiers, count(*) AS total FROM events GROUP BY 1"


def earlier_matches(spark, d):
    hits = table(spark, d, "events").withColumn("is_current", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))) == 1)
    page = hits.filter("is_current and event_type = 'click'").select("user_id", "event_id")
    return search.earlier_matches(page, hits.filter("event_type = 'click'"), "user_id")


EARLIER_SQL = """
WITH h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS cur FROM events), p AS (SELECT user_id, event_id FROM h WHERE cur AND event_type = 'click')
SELECT p.user_id, p.event_id, count(h.event_id) AS n_earlier FROM p LEFT JOIN h ON h.user_id = p.user_id AND NOT h.cur AND h.event_type = 'click' GROUP BY 1, 2
"""


def highlights(spark, d):
    return table(spark, d, "documents").select("doc_id", search.highlight(F.col("text"), "erth", 60).alias("fragment"))


HIGHLIGHT_SQL = """
WITH t AS (SELECT doc_id, text, position('erth' IN lower(text)) AS p FROM documents)
SELECT doc_id, CASE WHEN p > 0 THEN regexp_replace(substr(text, greatest(p - 30, 1), 60), '(?i)(erth)', '<em>\\1</em>', 'g') END AS fragment FROM t
"""


def _ranked(spark, d):
    """Labelled documents ranked within their source by length, quality and toxicity as the grade."""
    rows = table(spark, d, "labels").groupBy("doc_id").agg(F.max(F.col("quality") * 2 + F.col("toxic")).alias("grade")).join(table(spark, d, "documents"), "doc_id")
    return rows.select(F.col("source").alias("query"), "grade", F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))


def relevance(spark, d):
    rows = _ranked(spark, d)
    return search.ndcg(rows).join(search.recall(rows), "query")


RELEVANCE_SQL = """
WITH r AS (SELECT source AS query, l.g AS grade, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM (SELECT doc_id, max(quality * 2 + toxic) AS g FROM labels GROUP BY 1) l JOIN documents USING (doc_id)),
i AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, rank) AS best FROM r)
SELECT query, round(coalesce(sum((2 ** grade - 1) / log2(rank + 1)) FILTER (WHERE rank <= 10) / nullif(sum((2 ** grade - 1) / log2(best + 1)) FILTER (WHERE best <= 10), 0), 0), 4) AS ndcg,
       round(coalesce(count(*) FILTER (WHERE rank <= 10 AND grade > 0) / nullif(count(*) FILTER (WHERE grade > 0), 0), 0), 4) AS recall FROM i GROUP BY 1
"""


def pooled_candidates(spark, d):
    docs = table(spark, d, "documents")
    runs = None
    for k, order in enumerate((F.desc("n_chars"), F.asc("n_chars"))):
        part = docs.select(F.col("source").alias("query"), F.col("doc_id").alias("doc"), F.lit(k).alias("profile_order"), F.row_number().over(W.partitionBy("source").orderBy(order, "doc_id")).alias("rank"))
        runs = part if runs is None else runs.unionByName(part)
    return search.pool(runs).select("query", "doc", F.col("seen.profile_order").cast("bigint").alias("profile"), F.col("seen.rank").cast("bigint").alias("rank"))


POOL_SQL = """
WITH r AS (SELECT source AS query, doc_id AS doc, 0 AS profile, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents
  UNION ALL SELECT source, doc_id, 1, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) FROM documents)
SELECT DISTINCT ON (query, doc) query, doc, CAST(profile AS BIGINT) AS profile, rank FROM r WHERE rank <= 12 ORDER BY query, doc, profile, rank
"""

REGISTERED = {
    "term_frequencies": (term_frequencies, TF_SQL),
    "search_bm25": (search_bm25, BM25_SQL),
    "search_top": (search_top, TOP_SQL),
    "search_boolean": (search_boolean, BOOLEAN_SQL),
    "search_phrase": (search_phrase, PHRASE_SQL),
    "search_prefix_fuzzy": (search_prefix_fuzzy, FUZZY_SQL),
    "search_collapse": (search_collapse, COLLAPSE_SQL),
    "search_scoped": (scoped_search, SCOPED_SQL),
    "facets_source_status": (facets, FACET_SQL),
    "distinct_identifiers": (distinct_counts, DISTINCT_SQL),
    "earlier_matches": (earlier_matches, EARLIER_SQL),
    "highlight_fragments": (highlights, HIGHLIGHT_SQL),
    "ndcg_recall_eval": (relevance, RELEVANCE_SQL),
    "pooled_candidates": (pooled_candidates, POOL_SQL),
}
