"""Releases, versions and as-of resolution over events, orders and documents."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators import asof, versions
from palimpsest.plans.tables import table


def _day(df, at="ts"):
    return F.datediff(F.col(at).cast("date"), F.lit("2000-01-01").cast("date")).cast("bigint")


def asof_event_per_day(spark, d):
    events = table(spark, d, "events")
    days = events.select("user_id", (F.date_trunc("day", F.col("ts").cast("timestamp")) + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz").alias("at")).distinct()
    out = asof.as_of_join(days, events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], "at", "ts", ["event_id", "event_type"])
    return out.select("user_id", F.date_format("at", "yyyy-MM-dd").alias("day"), "event_id", "event_type")


ASOF_SQL = """
WITH d AS (SELECT DISTINCT user_id, date_trunc('day', ts) + INTERVAL 1 DAY AS at FROM events)
SELECT d.user_id, strftime(d.at, '%Y-%m-%d') AS day, e.event_id, e.event_type FROM d
LEFT JOIN LATERAL (SELECT event_id, event_type FROM events e WHERE e.user_id = d.user_id AND e.ts <= d.at ORDER BY ts DESC, event_id DESC LIMIT 1) e ON true
"""


def served_from_partial_calendar(spark, d):
    # releases are days; a title (event type) is loaded on the days it has events that do not fall on a multiple of three
    events = table(spark, d, "events").select("event_type", _day(None).alias("seq"))
    loads = events.filter("seq % 3 != 0").groupBy(F.col("event_type").alias("title"), "seq").agg(F.count("*").alias("n"))
    loads = loads.select("title", "seq", F.when(F.col("seq") % 5 != 0, F.col("n")).alias("sections_loaded"))
    days = events.select("seq").distinct()
    return asof.served_from(days.crossJoin(F.broadcast(events.select(F.col("event_type").alias("title")).distinct())), loads).select("title", "seq", "served_seq")


SERVED_SQL = """
WITH e AS (SELECT event_type AS title, CAST(date_diff('day', DATE '2000-01-01', CAST(ts AS DATE)) AS BIGINT) AS seq FROM events),
l AS (SELECT DISTINCT title, seq FROM e WHERE seq % 3 <> 0 AND seq % 5 <> 0), r AS (SELECT t.title, s.seq FROM (SELECT DISTINCT title FROM e) t, (SELECT DISTINCT seq FROM e) s)
SELECT r.title, r.seq, (SELECT max(l.seq) FROM l WHERE l.title = r.title AND l.seq <= r.seq) AS served_seq FROM r
"""


def asof_release_by_date(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    rel = orders.filter(F.dayofmonth("date") == 1).select(F.col("date").alias("currency_date")).distinct()
    rel = rel.withColumn("seq", F.datediff("currency_date", F.lit("1900-01-01").cast("date")))
    return asof.resolve_dates(orders, rel).select("o_orderkey", F.col("resolved_seq").cast("bigint").alias("resolved_seq"))


BY_DATE_SQL = """
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders), r AS (SELECT DISTINCT date AS cd, date_diff('day', DATE '1900-01-01', date) AS seq FROM o WHERE day(date) = 1)
SELECT o.o_orderkey, CAST(r.seq AS BIGINT) AS resolved_seq FROM o ASOF LEFT JOIN r ON o.date >= r.cd
"""


def content_dedupe_documents(spark, d):
    docs = table(spark, d, "documents").select("source", F.sha2("text", 256).alias("content_hash"), F.col("doc_id").alias("seq"))
    return versions.dedupe_contents(docs, ["source"], "seq", "content_hash")


DEDUPE_SQL = "SELECT source, sha256(text) AS content_hash, min(doc_id) AS first_seq, max(doc_id) AS last_seq, count(DISTINCT doc_id) AS n_releases FROM documents GROUP BY 1, 2"


def dedupe_ratios(spark, d):
    docs = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("rows"), F.count_distinct(F.sha2("text", 256)).alias("versions"))
    return docs.select("lang", F.round(versions.dedupe_ratio(F.col("rows") - F.col("versions"), F.col("versions")), 6).alias("load_ratio"), F.round(versions.store_ratio(F.col("versions"), F.col("rows")), 6).alias("store_ratio"))


RATIO_SQL = "SELECT lang, round((count(*) - count(DISTINCT sha256(text))) / count(*), 6) AS load_ratio, round(1 - count(DISTINCT sha256(text)) / count(*), 6) AS store_ratio FROM documents GROUP BY 1"


def version_runs_events(spark, d):
    return versions.version_runs(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", F.col("run").cast("bigint").alias("run"), "event_type", "n_rows", "first", "last")


RUNS_SQL = """
WITH x AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM x)
SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS n_rows, min(ts) AS first, max(ts) AS last FROM y GROUP BY 1, 2, 3
"""


def current_version(spark, d):
    events = table(spark, d, "events")
    return versions.current_version(events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


CURRENT_SQL = "SELECT DISTINCT ON (user_id) user_id, event_id, event_type FROM events ORDER BY user_id, ts DESC, event_id DESC"


def reversion_first_seen(spark, d):
    """Where the version in force is not the one first seen last: a text went back to an earlier one."""
    events = table(spark, d, "events")
    current = versions.current_version(events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", F.col("event_type").alias("in_force"))
    seen = events.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    newest = seen.groupBy("user_id").agg(F.max_by("event_type", "f").alias("first_seen_last"))
    return current.join(newest, "user_id").withColumn("reverted", F.col("in_force") != F.col("first_seen_last"))


REVERSION_SQL = """
WITH c AS (SELECT DISTINCT ON (user_id) user_id, event_type AS in_force FROM events ORDER BY user_id, ts DESC, event_id DESC),
f AS (SELECT DISTINCT ON (user_id, event_type) user_id, event_type, ts, event_id FROM events ORDER BY user_id, event_type, ts, event_id),
n AS (SELECT DISTINCT ON (user_id) user_id, event_type AS first_seen_last FROM f ORDER BY user_id, ts DESC, event_id DESC)
SELECT c.user_id, in_force, first_seen_last, in_force <> first_seen_last AS reverted FROM c JOIN n ON n.user_id = c.user_id
"""


def version_timeline(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("event_type").alias("content_hash"), _day(None).alias("seq")).distinct().withColumn("label", F.concat(F.lit("r"), F.col("seq").cast("string")))
    out = versions.timeline(rows, ["user_id"])
    return out.select("user_id", "content_hash", "first_seq", F.array_join("labels", ",").alias("labels"), "previous_hash")


TIMELINE_SQL = """
WITH r AS (SELECT DISTINCT user_id, event_type AS content_hash, CAST(date_diff('day', DATE '2000-01-01', CAST(ts AS DATE)) AS BIGINT) AS seq FROM events),
v AS (SELECT user_id, content_hash, min(seq) AS first_seq, string_agg('r' || seq, ',' ORDER BY seq) AS labels FROM r GROUP BY 1, 2)
SELECT *, lag(content_hash) OVER (PARTITION BY user_id ORDER BY first_seq, content_hash) AS previous_hash FROM v
"""


def superseded_flags(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", _day(None).alias("seq"))
    return versions.mark_current(rows, ["user_id"]).groupBy("user_id", "is_current").agg(F.count("*").alias("n"))


SUPERSEDED_SQL = """
WITH r AS (SELECT user_id, CAST(ts AS DATE) = max(CAST(ts AS DATE)) OVER (PARTITION BY user_id) AS is_current FROM events) SELECT user_id, is_current, count(*) AS n FROM r GROUP BY 1, 2
"""


def upsert_last_write(spark, d):
    """Later rows of a line replace earlier ones; the batch is every line with a discount."""
    line = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"))
    batch = table(spark, d, "lineitem").filter("l_discount > 0").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", F.col("l_partkey"))
    base = line.select("l_orderkey", "l_linenumber", F.lit(0).cast("bigint").alias("l_suppkey"), F.lit(0.0).alias("l_quantity"), "l_partkey")
    out = versions.upsert(base, batch, ["l_orderkey", "l_linenumber"], ["l_suppkey", "l_quantity", "l_partkey"])
    return out.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_suppkey").alias("suppkeys"), F.sum("l_quantity").alias("quantity"))


UPSERT_SQL = """
WITH k AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
b AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem WHERE l_discount > 0 ORDER BY l_orderkey, l_linenumber, l_suppkey DESC, l_quantity DESC, l_partkey DESC)
SELECT k.l_orderkey, count(*) AS n, CAST(coalesce(sum(b.l_suppkey), 0) AS BIGINT) AS suppkeys, coalesce(sum(b.l_quantity), 0) AS quantity FROM k LEFT JOIN b USING (l_orderkey, l_linenumber) GROUP BY 1
"""


def version_reuse(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("content_hash"))
    return versions.new_versions(docs.filter("doc_id % 2 = 1"), docs.filter("doc_id % 2 = 0"), ["lang"]).groupBy("lang", "known").agg(F.count("*").alias("n"))


REUSE_SQL = """
WITH v AS (SELECT DISTINCT lang, text FROM documents WHERE doc_id % 2 = 0)
SELECT d.lang, v.text IS NOT NULL AS known, count(*) AS n FROM documents d LEFT JOIN v ON v.lang = d.lang AND v.text = d.text WHERE d.doc_id % 2 = 1 GROUP BY 1, 2
"""


def neighbours_conversations(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", F.concat("role", F.lit("-"), F.floor(F.col("turn") / 2).cast("string")).alias("identifier"), "turn")
    return versions.neighbours(turns, ["conv_id"], "identifier", "turn")


NEIGHBOUR_SQL = """
WITH t AS (SELECT conv_id, role || '-' || (turn // 2) AS identifier, turn FROM conversations),
e AS (SELECT conv_id, identifier, min(turn) AS first_place, max(turn) AS last_place FROM t GROUP BY 1, 2)
SELECT e.*, (SELECT identifier FROM t WHERE t.conv_id = e.conv_id AND t.turn < e.first_place ORDER BY turn DESC, identifier DESC LIMIT 1) AS previous,
       (SELECT identifier FROM t WHERE t.conv_id = e.conv_id AND t.turn > e.last_place ORDER BY turn, identifier LIMIT 1) AS next FROM e
"""


def repeated_lines(spark, d):
    line = table(spark, d, "lineitem")
    out = versions.occurrences(line, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"], [])
    return out.select("l_orderkey", "l_linenumber", F.col("primary.l_partkey").alias("primary_part"), F.size("duplicates").cast("bigint").alias("n_duplicates"))


REPEATED_SQL = "SELECT l_orderkey, l_linenumber, min(l_partkey) AS primary_part, count(*) - 1 AS n_duplicates FROM lineitem GROUP BY 1, 2"


def earliest_placement(spark, d):
    events = table(spark, d, "events")
    return events.groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


EARLIEST_SQL = "SELECT DISTINCT ON (user_id, event_type) user_id, event_type, event_id FROM events ORDER BY user_id, event_type, ts, event_id"


def behind_by(spark, d):
    days = table(spark, d, "events").select(_day(None).alias("seq")).distinct()
    last = days.withColumn("loaded_seq", F.col("seq") - 7).withColumn("published_seq", F.when(F.col("seq") % 4 != 0, F.col("seq")))
    return asof.behind_by(last, days).select("seq", "behind_by")


BEHIND_SQL = """
WITH s AS (SELECT DISTINCT CAST(date_diff('day', DATE '2000-01-01', CAST(ts AS DATE)) AS BIGINT) AS seq FROM events)
SELECT seq, CASE WHEN seq % 4 <> 0 THEN (SELECT count(*) FROM s r WHERE r.seq > s.seq - 7 AND r.seq <= s.seq) END AS behind_by FROM s
"""

REGISTERED = {
    "asof_event_per_day": (asof_event_per_day, ASOF_SQL),
    "served_from_partial_calendar": (served_from_partial_calendar, SERVED_SQL),
    "asof_release_by_date": (asof_release_by_date, BY_DATE_SQL),
    "content_dedupe_documents": (content_dedupe_documents, DEDUPE_SQL),
    "dedupe_ratios": (dedupe_ratios, RATIO_SQL),
    "version_runs_events": (version_runs_events, RUNS_SQL),
    "current_version_distinct_on": (current_version, CURRENT_SQL),
    "reversion_first_seen_vs_map": (reversion_first_seen, REVERSION_SQL),
    "version_timeline": (version_timeline, TIMELINE_SQL),
    "superseded_flags": (superseded_flags, SUPERSEDED_SQL),
    "upsert_last_write": (upsert_last_write, UPSERT_SQL),
    "version_reuse": (version_reuse, REUSE_SQL),
    "neighbours_conversations": (neighbours_conversations, NEIGHBOUR_SQL),
    "repeated_identifiers": (repeated_lines, REPEATED_SQL),
    "earliest_placement": (earliest_placement, EARLIEST_SQL),
    "behind_by": (behind_by, BEHIND_SQL),
}
