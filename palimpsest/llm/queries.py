"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.chat_format import rotate_perspectives
from palimpsest.llm.decontaminate import contaminated
from palimpsest.llm.jaccard_join import ngram_jaccard_join
from palimpsest.llm.line_dedup import dedup_lines
from palimpsest.llm import piece_lattice
from palimpsest.llm.product_topk import top_products
from palimpsest.llm.projected_ann import nearest_by_inner_product
from palimpsest.llm.secret_scan import scan_secrets, spell
from palimpsest.llm.site_style import extract_main_text
from palimpsest.llm import token_files
from palimpsest.llm.toxicity import held_out, score_toxicity, train_toxicity
from palimpsest.llm.turn_repair import conversation_hashes, damage_turns, repair_conversations
from palimpsest.llm.word_runs import periodic_runs, plant_repeats, strongest

_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_ASCII_LOWER}, '[^\\x20\\x09-\\x0D]+')"
_SHINGLES = (
    "unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] "
    "ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)"
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP1_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, {_SHINGLES} AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.m)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.m) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled segmentation of each text, and whether decoding it gives the text back."""
    settings = piece_lattice.Settings(tokenizer_file("piece_bpe_32k.model"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    out = piece_lattice.round_trip_pieces(docs, settings)
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.sha2("decoded", 256) == F.col("text_sha256")).alias("lossless"))


def op6_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_by_inner_product(_table(spark, sf_dir, "embeddings"))


def op3_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every rendering as length, digest and mask spans."""
    out = rotate_perspectives(_table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda x: F.concat_ws(":", x.start, x.end)), ",")
    return out.select("conv_id", "speaker", "part", "piece", "start", "n_turns", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), mask.alias("mask"))


OP3_SQL = """
WITH c AS (SELECT conv_id, turn, CAST(floor(coalesce(turn, -1) / 128) AS BIGINT) AS part, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST, role, text) - 1) // 2048 AS piece FROM c),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
x AS (SELECT t.conv_id, speaker, part, piece, turn, role, text,
             '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant' ELSE 'user name=' || role END || chr(10) AS lead
      FROM t JOIN s ON s.conv_id = t.conv_id),
y AS (SELECT *, length(lead) + length(text) + 11 AS size,
             coalesce(sum(length(lead) + length(text) + 11) OVER (PARTITION BY conv_id, speaker, part, piece ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM x),
z AS (SELECT conv_id, speaker, part, piece, count(*) AS n_turns, sum(size) AS size, string_agg(lead || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS body,
             coalesce(string_agg(CAST(off + length(lead) AS BIGINT) || ':' || CAST(off + length(lead) + length(text) + 10 AS BIGINT), ',' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = speaker), '') AS mask
      FROM y GROUP BY conv_id, speaker, part, piece)
SELECT conv_id, speaker, part, piece, CAST(coalesce(sum(size) OVER (PARTITION BY conv_id, speaker ORDER BY part, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
       n_turns, length(body) AS n_chars, sha256(body) AS text_sha256, mask FROM z
"""


def op4_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_main_text(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cut from each document, and what is left as length and digest."""
    out = dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP5_SQL = """
WITH p AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
bad AS (SELECT trim(line) AS line FROM p WHERE length(trim(line)) >= 12 GROUP BY 1 HAVING count(DISTINCT source) >= 10),
k AS (SELECT p.doc_id, count(*) AS n_lines, count(bad.line) AS n_removed, string_agg(p.line, chr(10) ORDER BY pos) FILTER (WHERE bad.line IS NULL) AS kept
      FROM p LEFT JOIN bad ON trim(p.line) = bad.line GROUP BY p.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, length(coalesce(k.kept, '')) AS n_kept_chars, sha256(coalesce(k.kept, '')) AS text_sha256
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id
"""


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(_table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("base", lambda x: x.kind == k)).cast("bigint")
    base = F.sha2(spell(F.col("base")), 256)
    return out.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), base.alias("base_sha256"), spell(F.array_sort(F.concat("base", "entropy"))).alias("spans"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains."""
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "n_shared", "n_item", F.round("containment", 6).alias("containment"))


OP8_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, {_SHINGLES} AS sh FROM d), it AS (SELECT DISTINCT item_id, {_SHINGLES} AS sh FROM i),
n AS (SELECT item_id, count(*) AS n_item FROM it GROUP BY 1),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN it USING (sh) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shared, n_item, round(n_shared / n_item, 6) AS containment FROM c JOIN n USING (item_id) WHERE n_shared >= 0.75 * n_item
"""


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = token_files.Settings("byte_bpe_50k.json")
    return token_files.token_files_round_trip(_table(spark, sf_dir, "documents"), settings).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = train_toxicity(docs, _table(spark, sf_dir, "labels"))
    out = score_toxicity(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cost and edits of each damaged conversation, and a digest of what they make of it."""
    conversations = _table(spark, sf_dir, "conversations")
    found = repair_conversations(damage_turns(conversations))
    ids = conversations.select("conv_id").distinct()
    for part in (found.summary, conversation_hashes(found.turns)):
        part = part.withColumnRenamed("conv_id", "of")
        ids = ids.join(part, ids.conv_id.eqNullSafe(part.of), "left").drop("of")
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return ids.withColumns(zero | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))})


def _op11_sql() -> str:
    """Paths are (cost and audit as one text, repaired text), extended row by row in a recursive query."""

    def path(of: str, cost: str, letters: str, line: str | None = None) -> str:
        said = f"{of}.t" if line is None else f"{of}.t || CASE WHEN {of}.t = '' THEN '' ELSE chr(10) END || {line}"
        return f"{{'k': printf('%09d', CAST({of}.k[1:9] AS BIGINT) + {cost}) || {of}.k[10:] || {letters}, 't': {said}}}"

    least = lambda *xs: f"list_sort([x FOR x IN [{', '.join(xs)}] IF x IS NOT NULL])[1]"
    drop = lambda of: path(of, "4", "'D'")
    keep = lambda of, initial: f"CASE WHEN r.fault NOT IN (1, 2) AND r.ini = '{initial}' THEN {path(of, 'r.late', chr(39) + 'K' + chr(39), 'r.role || chr(58) || r.text')} END"
    turn = lambda of, role: f"CASE WHEN r.fault NOT IN (1, 2) THEN {path(of, '3 + r.late', chr(39) + 'R' + chr(39), chr(39) + role + ':' + chr(39) + ' || r.text')} END"
    insert = lambda of, role: path(of, "3", "'I'", f"'{role}:'")
    users = [f(of, x) for of in ("d.c0", "d.c1", "d.c3") for f, x in ((keep, "u"), (turn, "user"))]
    return f"""
WITH RECURSIVE table_of AS (SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i))),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS word FROM conversations),
h AS (SELECT o.*, xor(list_reduce([ascii(x) FOR x IN string_split(word, '')], lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % 20 AS d FROM o, table_of),
g AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM g),
f AS (SELECT *, CASE WHEN role = '' THEN ' ' ELSE left(role, 1) END AS ini,
             CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
                  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault FROM n),
r AS (SELECT *, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS late, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM f),
c AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
             count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM r GROUP BY conv_id),
q(conv_id, i, c0, c1, c2, c3) AS (
  SELECT conv_id, 0::BIGINT, {{'k': '000000000', 't': ''}}, {{'k': '900000000', 't': ''}}, {{'k': '000000003I', 't': 'user:'}}, {{'k': '000000006II', 't': 'user:' || chr(10) || 'assistant:'}} FROM c
  UNION ALL
  SELECT conv_id, i, c0, c1, c2, {least("c3", insert("c2", "assistant"))} FROM (
    SELECT conv_id, i, c0, c1, {least("c2", insert("c0", "user"), insert("c1", "user"), insert("c3", "user"))} AS c2, c3 FROM (
      SELECT r.conv_id, r.i, {drop("d.c0")} AS c0, {least(drop("d.c1"), keep("d.c0", "s"))} AS c1, {least(drop("d.c2"), *users)} AS c2, {least(drop("d.c3"), keep("d.c2", "a"), turn("d.c2", "assistant"))} AS c3
      FROM q d JOIN r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.i = d.i + 1))),
b AS (SELECT c.*, {least("c0", "c3")} AS best FROM q JOIN c ON c.conv_id IS NOT DISTINCT FROM q.conv_id AND c.n = q.i)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(CAST(best.k[1:9] AS BIGINT), 0) AS cost, coalesce(best.k[10:], '') AS audit, sha256(coalesce(best.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
"""


OP11_SQL = _op11_sql()


def op12_product_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(_table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH c AS (SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM c q JOIN c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of documents with planted repeats: their number, the strongest, and digests of all and of what is left."""
    found = periodic_runs(plant_repeats(_table(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    best = F.col("best")
    found = found.withColumn("best", strongest(F.col("runs")))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.start.alias("start"), best.length.alias("length"), best.period.alias("period"),
        F.floor(1000 * best.length / best.period).alias("exponent_milli"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_perspective_rotation": op3_perspective_rotation,
    "op4_site_style_tree": op4_site_style_tree,
    "op5_line_dedup": op5_line_dedup,
    "op6_projected_neighbours": op6_projected_neighbours,
    "op7_secret_scan": op7_secret_scan,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_token_files": op9_token_files,
    "op10_toxicity": op10_toxicity,
    "op11_turn_repair": op11_turn_repair,
    "op12_product_topk": op12_product_topk,
    "op13_periodic_runs": op13_periodic_runs,
}
SQL = {"op1_ngram_jaccard_join": OP1_SQL, "op3_perspective_rotation": OP3_SQL, "op5_line_dedup": OP5_SQL, "op8_benchmark_decontamination": OP8_SQL, "op11_turn_repair": OP11_SQL, "op12_product_topk": OP12_SQL}
