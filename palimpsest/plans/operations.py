"""Plans, verification, percentiles, throttling."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators import accounts, layers, ledger, resolve, search
from palimpsest.plans.tables import table


def _releases(spark, d):
    """Order days as releases; the nations of an order's customers as the titles that it affects."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    return o.groupBy(day.alias("seq")).agg(F.array_sort(F.collect_set((F.col("c_nationkey") + 1).cast("string"))).alias("titles_affected"))


_RELEASES = "r AS (SELECT DISTINCT date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS seq, lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') AS title FROM orders JOIN customer ON c_custkey = o_custkey)"


def backfill_plan(spark, d):
    return ledger.plan_backfill(_releases(spark, d)).select(F.col("seq").cast("bigint").alias("seq"), "title", "baseline")


BACKFILL_SQL = f"""
WITH {_RELEASES} SELECT DISTINCT CAST((SELECT min(seq) FROM r) AS BIGINT) AS seq, title, true AS baseline FROM r UNION ALL SELECT CAST(seq AS BIGINT), title, false FROM r WHERE seq > (SELECT min(seq) FROM r)
"""


def latest_affecting(spark, d):
    rel = _releases(spark, d)
    named = rel.select("seq", F.explode("titles_affected").alias("title")).filter("seq % 3 = 0")
    return ledger.latest_affecting(named.select("title", "seq"), rel).select("title", F.col("seq").cast("bigint").alias("seq"), F.col("latest_seq").cast("bigint").alias("latest_seq"))


AFFECT_SQL = f"""
WITH {_RELEASES}, q AS (SELECT ltrim(title, '0') AS title, seq, lag(seq) OVER (PARTITION BY title ORDER BY seq) AS prev FROM r) SELECT title, CAST(seq AS BIGINT) AS seq, CAST(prev AS BIGINT) AS latest_seq FROM q WHERE seq % 3 = 0
"""


def load_plan(spark, d):
    o = table(spark, d, "orders")
    rows = o.select(F.concat(F.lit("r"), F.col("o_custkey") % 200).alias("label"), (F.col("o_orderkey") % 54).cast("string").alias("title"), F.when(F.col("o_orderstatus") == "F", "ok").otherwise("failed").alias("status")).distinct()
    rel = o.select(F.concat(F.lit("r"), F.col("o_custkey") % 200).alias("label"), (F.col("o_custkey") % 200).alias("seq")).distinct().filter("seq < 150")
    done = o.filter("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("r"), F.col("o_custkey") % 200).alias("label"), (F.col("o_orderkey") % 54).cast("string").alias("title")).distinct()
    return ledger.plan_loads(rows, rel, done).select("label", "title", "seq")


LOAD_SQL = """
WITH x AS (SELECT 'r' || (o_custkey % 200) AS label, CAST(o_orderkey % 54 AS VARCHAR) AS title, o_custkey % 200 AS seq, o_orderstatus, o_orderpriority FROM orders)
SELECT DISTINCT label, title, seq FROM x WHERE o_orderstatus = 'F' AND seq < 150 AND NOT EXISTS (SELECT 1 FROM x y WHERE y.label = x.label AND y.title = x.title AND y.o_orderpriority = '1-URGENT')
"""


def count_verification(spark, d):
    """Recorded counts (order key modulo 7) against line rows."""
    rec = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 7).alias("n_recorded"))
    return ledger.compare_counts(rec, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")), ["key"])


COUNT_SQL = """
SELECT coalesce(o_orderkey, k) AS key, o_orderkey % 7 AS n_recorded, coalesce(n, 0) AS n_actual, coalesce(o_orderkey % 7 = coalesce(n, 0), false) AS sound
FROM orders FULL JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) ON k = o_orderkey
"""


def duplicate_groups(spark, d):
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("digest"), "source", "n_chars")
    return ledger.duplicate_groups(docs, "digest", "source", "n_chars")


DUPLICATE_SQL = "SELECT sha256(text) AS digest, count(*) AS n, count(DISTINCT source) AS n_owners, max(n_chars) * (count(*) - 1) AS wasted, count(DISTINCT source) > 1 AS across FROM documents GROUP BY 1 HAVING count(*) > 1"


def vanish_guard(spark, d):
    o = table(spark, d, "orders")
    page = o.filter("o_orderdate >= '1996-01-01'").select(F.col("o_custkey").alias("label")).distinct()
    return ledger.symmetric_difference(page, o.filter("o_orderdate < '1997-01-01'").select(F.col("o_custkey").alias("label")).distinct(), "label")


VANISH_SQL = """
WITH p AS (SELECT DISTINCT o_custkey AS label FROM orders WHERE o_orderdate >= '1996-01-01'), k AS (SELECT DISTINCT o_custkey AS label FROM orders WHERE o_orderdate < '1997-01-01')
SELECT label, 'new' AS side FROM (FROM p EXCEPT FROM k) UNION ALL SELECT label, 'vanished' FROM (FROM k EXCEPT FROM p)
"""


def identifier_collisions(spark, d):
    return ledger.collisions(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


COLLISION_SQL = "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"


def rank_percentiles(spark, d):
    """By nearest rank and by index, of values per event type and a tenth of the users."""
    rows = table(spark, d, "events").select("event_type", (F.col("user_id") % 10).alias("bucket"), "value")
    return ledger.percentiles(rows, ["event_type", "bucket"], "value", {"p50": 50, "p95": 95}, {"median": 50, "p99": 99})


PERCENTILE_SQL = """
WITH s AS (SELECT event_type, user_id % 10 AS bucket, list(value ORDER BY value) AS v FROM events GROUP BY 1, 2), n AS (SELECT *, len(v) AS n FROM s)
SELECT event_type, bucket, v[greatest(1, least(n, CAST(floor(0.5 * n + 0.5) AS BIGINT)))] AS p50, v[greatest(1, least(n, CAST(floor(0.95 * n + 0.5) AS BIGINT)))] AS p95,
       v[least(n - 1, CAST(floor(0.5 * n) AS BIGINT)) + 1] AS median, v[least(n - 1, CAST(floor(0.99 * n) AS BIGINT)) + 1] AS p99 FROM n
"""


def cumulative_share(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("depth")).agg(F.count("*").alias("n"))
    # one row per depth
    return rows.select("depth", "n", F.round(F.sum("n").over(W.orderBy("depth")) / F.sum("n").over(W.partitionBy()), 3).alias("share"))


SHARE_SQL = "SELECT l_linenumber AS depth, count(*) AS n, round(sum(count(*)) OVER (ORDER BY l_linenumber) / sum(count(*)) OVER (), 3) AS share FROM lineitem GROUP BY 1"


def status_histogram(spark, d):
    out = ledger.histogram(table(spark, d, "orders"), "o_orderstatus", ["o_orderpriority"])
    return out.select("o_orderpriority", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e.key, e.value)), ",").alias("counts"))


HISTOGRAM_SQL = "SELECT o_orderpriority, string_agg(s || '=' || n, ',' ORDER BY s) AS counts FROM (SELECT o_orderpriority, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1"


def throttle_sliding(spark, d):
    errors = table(spark, d, "events").filter("event_type = 'error'").select("event_id", "user_id", "ts", (F.col("user_id") % 20).alias("ip"))
    out = accounts.throttled(errors, {"user_id": 2, "ip": 3})
    return out.select("event_id", "failures_user_id", "failures_ip", "blocked")


THROTTLE_SQL = """
WITH e AS (SELECT event_id, user_id, user_id % 20 AS ip, ts FROM events WHERE event_type = 'error'),
w AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 15 MINUTES PRECEDING AND CURRENT ROW) AS u, count(*) OVER (PARTITION BY ip ORDER BY ts RANGE BETWEEN INTERVAL 15 MINUTES PRECEDING AND CURRENT ROW) AS i FROM e)
SELECT event_id, u AS failures_user_id, i AS failures_ip, u > 2 OR i > 3 AS blocked FROM w
"""


def watchlists(spark, d):
    lists = table(spark, d, "customer").select(F.col("c_custkey").alias("watchlist_id"))
    return accounts.watchlist_counts(lists, table(spark, d, "orders").select(F.col("o_custkey").alias("watchlist_id")))


WATCH_SQL = "SELECT c_custkey AS watchlist_id, count(o_orderkey) AS n_items FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"


def json_props(spark, d):
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("top"))


JSON_SQL = "WITH e AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS top FROM e GROUP BY 1"

def layer_costs(spark, d):
    """Users as pages, three types of events as layers, events as calls; every third is cached, up to two come first."""
    e = table(spark, d, "events")
    layer = F.get(F.array(F.lit("edge"), F.lit("proxy"), F.lit("site")), F.expr("array_position(array('view', 'click', 'error'), event_type)").cast("int") - 1)
    measures = e.select(F.col("user_id").alias("step"), layer.alias("layer"), F.col("value").alias("total")).filter("layer is not null")
    calls = e.select(F.col("user_id").alias("page"), F.col("event_id").alias("place"), F.concat(F.lit("c"), "event_id").alias("call"), F.col("value").alias("cost"), (F.col("user_id") % 3).alias("sequential"), (F.col("event_id") % 3 != 0).alias("per_view"))
    return layers.attribute_layers(measures, calls, ("edge", "proxy", "site"), ("step",), "step", digits=2)


LAYER_SQL = """
WITH t AS (SELECT user_id AS step, max(value) FILTER (WHERE event_type = 'view') AS edge_total, max(value) FILTER (WHERE event_type = 'click') AS proxy_total, max(value) FILTER (WHERE event_type = 'error') AS site_total FROM events GROUP BY 1),
c AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) > user_id % 3 AS late FROM events WHERE event_id % 3 <> 0 AND value IS NOT NULL),
n AS (SELECT user_id, count(*) FILTER (WHERE event_id % 3 <> 0 AND value IS NOT NULL) AS api_calls, count(*) FILTER (WHERE event_id % 3 = 0) AS api_calls_cached FROM events GROUP BY 1),
m AS (SELECT user_id, coalesce(sum(value) FILTER (WHERE NOT late), 0) + coalesce(max(value) FILTER (WHERE late), 0) AS api_cost FROM c GROUP BY 1),
s AS (SELECT user_id, min('c' || event_id) AS slowest_parallel FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS r FROM c WHERE late) WHERE r = 1 GROUP BY 1)
SELECT step, edge_total, proxy_total, site_total, round(edge_total - proxy_total, 2) AS edge_own, round(proxy_total - site_total, 2) AS proxy_own, round(site_total - api_cost, 2) AS site_own,
       CASE WHEN api_calls > 0 THEN api_calls END AS api_calls, CASE WHEN api_calls > 0 THEN api_calls_cached END AS api_calls_cached, round(api_cost, 2) AS api_cost, slowest_parallel
FROM t JOIN n ON n.user_id = step LEFT JOIN m ON m.user_id = step LEFT JOIN s ON s.user_id = step WHERE edge_total IS NOT NULL
"""


def release_listing(spark, d):
    """Releases that affect title 5, with how many titles were loaded from each."""
    o = table(spark, d, "orders")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    loads = o.select(day.alias("seq"), (F.col("o_custkey") % 7).alias("title"), F.when(F.col("o_orderkey") % 3 != 0, 1).alias("sections_loaded"))
    out = resolve.list_releases(_releases(spark, d), loads, "5")
    return out.select(F.col("seq").cast("bigint").alias("seq"), F.size("titles_affected").cast("bigint").alias("n_affected"), "n_titles")


LISTING_SQL = f"""
WITH {_RELEASES}, l AS (SELECT date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS seq, count(DISTINCT o_custkey % 7) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1)
SELECT CAST(r.seq AS BIGINT) AS seq, count(*) AS n_affected, coalesce(max(n), 0) AS n_titles FROM r LEFT JOIN l ON l.seq = r.seq GROUP BY r.seq HAVING bool_or(title = '05')
"""


def release_scopes(spark, d):
    """Lines as matching versions of suppliers, order months as releases: in force in month 20, and newest seen by then."""
    month = F.expr("(year(l_shipdate) - 1992) * 12 + month(l_shipdate)").cast("bigint")
    hits = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), month.alias("first_seq"), F.col("l_quantity").cast("double").alias("score")).withColumn("in_force_seqs", F.array("first_seq", F.col("first_seq") + 1))
    kept = [search.at_release(hits, "key", 20, from_map).select(F.lit(scope).alias("scope"), "key", "first_seq", "score") for scope, from_map in (("in force", True), ("seen", False))]
    return kept[0].unionByName(kept[1])


SCOPES_SQL = """
WITH h AS (SELECT l_suppkey AS key, CAST((year(l_shipdate) - 1992) * 12 + month(l_shipdate) AS BIGINT) AS first_seq, CAST(l_quantity AS DOUBLE) AS score FROM lineitem),
s AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY first_seq DESC, score DESC) AS r FROM h WHERE first_seq <= 20)
SELECT 'in force' AS scope, key, first_seq, score FROM h WHERE first_seq IN (19, 20) UNION ALL SELECT 'seen', key, first_seq, score FROM s WHERE r = 1
"""


REGISTERED = {
    "release_listing": (release_listing, LISTING_SQL),
    "release_scopes": (release_scopes, SCOPES_SQL),
    "layer_costs": (layer_costs, LAYER_SQL),
    "backfill_plan": (backfill_plan, BACKFILL_SQL),
    "latest_release_affecting": (latest_affecting, AFFECT_SQL),
    "load_plan": (load_plan, LOAD_SQL),
    "count_verification_orders": (count_verification, COUNT_SQL),
    "duplicate_groups_documents": (duplicate_groups, DUPLICATE_SQL),
    "vanish_guard": (vanish_guard, VANISH_SQL),
    "identifier_collisions": (identifier_collisions, COLLISION_SQL),
    "nearest_rank_percentiles": (rank_percentiles, PERCENTILE_SQL),
    "cumulative_share": (cumulative_share, SHARE_SQL),
    "status_histogram": (status_histogram, HISTOGRAM_SQL),
    "throttle_sliding_15m": (throttle_sliding, THROTTLE_SQL),
    "watchlist_counts": (watchlists, WATCH_SQL),
    "json_fields": (json_props, JSON_SQL),
}
