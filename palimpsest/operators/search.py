"""Ranked full-text search: scopes, boolean text, BM25, phrases, facets, collapse, highlights, evaluation."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.columns import let

#: Scope words and the fields they filter.
SCOPES = {"title": "title_num", "chapter": "chapter", "status": "status"}
_TOKEN = re.compile(r'[a-zA-Z]+:"[^"]*"|"[^"]*"|\S+')
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Query:
    """What filters and what matches."""

    text: str = ""
    headings: tuple[str, ...] = ()
    filters: dict[str, tuple[str, ...]] = field(default_factory=dict)
    release: str | None = None
    date: str | None = None


def parse_query(q: str) -> Query:
    """Scopes lifted out of a query; an unknown or empty scope stays text, a quoted run is one token."""
    text, headings, filters, times = [], [], {}, {}
    for token in _TOKEN.findall(q):
        name, colon, value = token.partition(":")
        name, value = name.lower(), value.strip('"').strip()
        if not colon or not value or not name.isalpha():
            text.append(token)
        elif name in ("release", "date"):
            times[name] = value
        elif name == "heading":
            headings.append(value)
        elif name in SCOPES:
            value = re.sub(r"^t(?=\d)", "", value.lower()) if name == "title" else value.lower()
            filters.setdefault(SCOPES[name], []).append(value)
        else:
            text.append(token)
    return Query(" ".join(text), tuple(headings), {k: tuple(v) for k, v in filters.items()}, times.get("release"), times.get("date"))


def unparse_query(q: Query) -> str:
    """A query string that parses to ``q``."""
    quote = lambda v: f'"{v}"' if re.search(r"\s", v) else v
    names = {v: k for k, v in SCOPES.items()}
    parts = [q.text] if q.text else []
    parts += [f"heading:{quote(v)}" for v in q.headings]
    parts += [f"{names[k]}:{quote(v)}" for k, vs in q.filters.items() for v in vs]
    parts += [f"{k}:{quote(v)}" for k, v in (("release", q.release), ("date", q.date)) if v]
    return " ".join(parts)


def with_filter(q: Query, name: str, value: str) -> Query:
    now = q.filters.get(name, ())
    return q if value in now else Query(q.text, q.headings, q.filters | {name: (*now, value)}, q.release, q.date)


def without_filter(q: Query, name: str, value: str) -> Query:
    now = tuple(v for v in q.filters.get(name, ()) if v != value)
    rest = {k: v for k, v in q.filters.items() if k != name}
    return Query(q.text, q.headings, rest | ({name: now} if now else {}), q.release, q.date)


def filter_column(q: Query) -> Column:
    """Values of one field are alternatives, fields are all required; ``none`` stands for a missing value."""
    out = F.lit(True)
    for name, values in q.filters.items():
        any_ = F.lower(F.col(name)).isin(*[v for v in values if v != "none"]) if set(values) - {"none"} else F.lit(False)
        out &= F.coalesce(any_, F.lit(False)) | (F.col(name).isNull() if "none" in values else F.lit(False))
    return out


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


#: What a text expression asks for, as nested tuples: ("phrase", words, slop), ("prefix", start), ("fuzzy", word, edits),
#: ("not", part), ("and", parts), ("or", parts). An empty "and" matches all, an empty "or" nothing.
Node = tuple


def parse_text(expression: str) -> Node:
    """A boolean text expression as a tree.

    ``a b`` and ``a + b`` need both, ``a | b`` either, ``-a`` excludes, ``"a b"`` is a phrase (``~n`` lets n
    words stand between), ``a*`` a prefix, ``a~n`` any word within n edits, parentheses group. Whatever does
    not parse is taken for words; an empty expression matches all.
    """
    lexemes = re.findall(r'"[^"]*"(?:~\d+)?|[()|+]|-(?=[^\s)|+])|[^\s()|+"]+', expression)
    at = 0
    everything: Node = ("and", ())

    def words(found: list[str], slop: int = 0) -> Node:
        return ("phrase", tuple(w.lower() for w in found), slop) if found else everything

    def word(x: str) -> Node:
        if x.startswith('"'):
            body, _, slop = x[1:].rpartition('"')
            return words(_WORD.findall(body), int(slop[1:] or 0) if slop.startswith("~") else 0)
        if m := re.fullmatch(r"(.+?)~(\d?)", x):
            return ("fuzzy", "".join(_WORD.findall(m[1].lower())), int(m[2] or 1))
        if x.endswith("*") and len(x) > 1:
            return ("prefix", x[:-1].lower())
        return words(_WORD.findall(x))

    def atom() -> Node:
        nonlocal at
        x = lexemes[at]
        at += 1
        if x == "-":
            return ("not", atom()) if at < len(lexemes) else everything
        if x == "(":
            inner = either()
            at += at < len(lexemes) and lexemes[at] == ")"
            return inner
        return everything if x in (")", "|", "+") else word(x)

    def all_() -> Node:
        nonlocal at
        parts = []
        while at < len(lexemes) and lexemes[at] not in ("|", ")"):
            if lexemes[at] == "+":
                at += 1
                continue
            parts.append(atom())
        return ("and", tuple(parts))

    def either() -> Node:
        nonlocal at
        parts = [all_()]
        while at < len(lexemes) and lexemes[at] == "|":
            at += 1
            parts.append(all_())
        return ("or", tuple(parts)) if len(parts) > 1 else parts[0]

    out = [either()]
    while at < len(lexemes):  # a stray closing parenthesis
        at += 1
        out.append(either())
    return ("and", tuple(out)) if len(out) > 1 else out[0]


def leaves_of(node: Node) -> list[Node]:
    """The distinct words, phrases, prefixes and fuzzy words of a tree."""
    if node[0] in ("phrase", "prefix", "fuzzy"):
        return [node]
    parts = (node[1],) if node[0] == "not" else node[1]
    return list(dict.fromkeys(leaf for part in parts for leaf in leaves_of(part)))


def predicate(node: Node, holds: Callable[[Node], Column]) -> Column:
    """A tree as a condition, given the condition of each leaf."""
    if node[0] == "not":
        return ~predicate(node[1], holds)
    if node[0] in ("and", "or"):
        out = F.lit(node[0] == "and")
        for part in node[1]:
            found = predicate(part, holds)
            out = out & found if node[0] == "and" else out | found
        return out
    return holds(node)


def compile_text(expression: str, tokens: Column) -> Column:
    """:func:`parse_text` as a predicate over a document's token array, for texts that are in no index."""

    def holds(leaf: Node) -> Column:
        if leaf[0] == "fuzzy":
            return F.exists(tokens, lambda t: F.levenshtein(t, F.lit(leaf[1]), leaf[2]) >= 0)
        if leaf[0] == "prefix":
            return F.exists(tokens, lambda t: t.startswith(leaf[1]))
        return phrase(tokens, list(leaf[1]), leaf[2])

    return predicate(parse_text(expression), holds)


def phrase(tokens: Column, words: list[str], slop: int = 0) -> Column:
    """Whether the words stand in order, with up to ``slop`` words between any two neighbours."""
    if not words:
        return F.lit(True)
    ends = F.filter(F.transform(tokens, lambda t, i: F.when(t == words[0], i)), lambda i: i.isNotNull())
    for w in words[1:]:
        ends = let(ends, _after(tokens, w, slop))
    return F.size(ends) > 0


def _after(tokens: Column, word: str, slop: int):
    """Places of ``word`` that follow one of the given places."""

    def follow(ends: Column) -> Column:
        near = lambda i: F.exists(ends, lambda p: (p < i) & (p >= i - 1 - slop))
        return F.filter(F.transform(tokens, lambda t, i: F.when((t == word) & near(i), i)), lambda i: i.isNotNull())

    return follow


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, term, tf, dl)."""
    words = docs.select(F.col(id_col).alias("doc"), terms(F.col(text_col)).alias("w"))
    rows = words.select("doc", F.size("w").alias("dl"), F.explode("w").alias("term"))
    return rows.groupBy("doc", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, doc, score) of every document with a query term; ``queries`` is query, term.

    Only postings of query terms are shuffled; collection figures are one row, broadcast.
    """
    words = docs.select(F.col(id_col).alias("doc"), terms(F.col(text_col)).alias("w")).select("doc", F.size("w").alias("dl"), "w")
    total = F.broadcast(words.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")))
    wanted = queries.select("term").distinct()
    post = words.select("doc", "dl", F.explode("w").alias("term")).join(wanted, "term", "left_semi").groupBy("term", "doc", "dl").agg(F.count("*").alias("tf"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    hit = post.join(df, "term").join(queries.select("query", "term").distinct(), "term").crossJoin(total)
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hit.groupBy("query", "doc").agg(F.sum(idf * tf).alias("score"))


def weighted_score(scores: list[tuple[DataFrame, float]]) -> DataFrame:
    """Sum of several fields' scores by weight."""
    out = None
    for df, weight in scores:
        part = df.select("query", "doc", (F.col("score") * weight).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("query", "doc").agg(F.sum("score").alias("score"))


def facet(rows: DataFrame, column: str, k: int, missing: str = "none") -> DataFrame:
    """The k most frequent values with counts, ties by value; null counts as ``missing``."""
    return rows.groupBy(F.coalesce(F.col(column), F.lit(missing)).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def collapse(hits: DataFrame, key: str, newest: str, score: str = "score") -> DataFrame:
    """One hit per key, its newest version; ordered elsewhere by ``best``, the key's best score."""
    w = W.partitionBy(key)
    out = hits.withColumn("best", F.max(score).over(w)).withColumn("_n", F.row_number().over(w.orderBy(F.desc(newest), F.desc(score))))
    return out.filter("_n = 1").drop("_n")


def at_release(hits: DataFrame, key: str, seq: int, from_map: bool = True) -> DataFrame:
    """Hits as of a release. By default only the version in force counts (``in_force_seqs`` holds it); otherwise
    the newest matching version first seen by then, which may have been superseded."""
    if from_map:
        return hits.filter(F.array_contains("in_force_seqs", seq))
    return collapse(hits.filter(F.col("first_seq") <= seq), key, "first_seq")


def earlier_matches(page: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """How many superseded versions of a page's entries match too."""
    n = hits.filter("not is_current").join(page.select(key), key, "left_semi").groupBy(key).agg(F.count("*").alias("n"))
    return page.join(n, key, "left").withColumn("n_earlier", F.coalesce("n", F.lit(0))).drop("n")


def highlight(text: Column, word: str, width: int = 220) -> Column:
    """A fragment around the first match with every match of it marked; null without one."""
    at = F.locate(word.lower(), F.lower(text))
    cut = F.substring(text, F.greatest(at - width // 2, F.lit(1)), F.lit(width))
    return F.when(at > 0, F.regexp_replace(cut, f"(?i)({re.escape(word)})", "<em>$1</em>"))


def ndcg(ranked: DataFrame, k: int = 10) -> DataFrame:
    """nDCG@k per query of rows (query, rank from 1, grade), with the ideal order of the same query's grades."""
    gain = (F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("rank") + 1)
    ideal = ranked.withColumn("_best", F.row_number().over(W.partitionBy("query").orderBy(F.desc("grade"), "rank")))
    best = (F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("_best") + 1)
    out = ideal.groupBy("query").agg(F.sum(F.when(F.col("rank") <= k, gain)).alias("_d"), F.sum(F.when(F.col("_best") <= k, best)).alias("_i"))
    return out.select("query", F.round(F.coalesce(F.col("_d") / F.nullif("_i", F.lit(0.0)), F.lit(0.0)), 4).alias("ndcg"))


def recall(ranked: DataFrame, k: int = 10) -> DataFrame:
    """Share of each query's relevant rows (grade > 0) within the first k."""
    out = ranked.groupBy("query").agg(F.count_if((F.col("rank") <= k) & (F.col("grade") > 0)).alias("_h"), F.count_if(F.col("grade") > 0).alias("_r"))
    return out.select("query", F.round(F.coalesce(F.col("_h") / F.nullif("_r", F.lit(0)), F.lit(0.0)), 4).alias("recall"))


def pool(runs: DataFrame, depth: int = 12) -> DataFrame:
    """Union of several profiles' first ``depth`` hits, each once, with the place where it was first seen."""
    return runs.filter(F.col("rank") <= depth).groupBy("query", "doc").agg(F.min(F.struct("profile_order", "rank")).alias("seen"))


@dataclass(frozen=True)
class Profile:
    """How hits are scored: fields with weights, boosts of phrases in body and heading, words that may stand between
    a phrase's words, versions searched, and the boost of versions in force where all are searched."""

    name: str
    fields: tuple[tuple[str, float], ...]
    phrase_boost: float = 0.0
    heading_phrase_boost: float = 0.0
    slop: int = 2
    scope: str = "current"
    current_boost: float = 1.0


#: Profiles with their weights.
PROFILES = {
    "deployed": Profile("deployed", (("heading", 4.0), ("body", 1.0))),
    "heading-6": Profile("heading-6", (("heading", 6.0), ("num", 2.0), ("body", 1.0))),
    "heading-10": Profile("heading-10", (("heading", 10.0), ("num", 2.0), ("body", 1.0))),
    "heading-16": Profile("heading-16", (("heading", 16.0), ("num", 2.0), ("body", 1.0))),
    "phrase": Profile("phrase", (("heading", 10.0), ("num", 2.0), ("body", 1.0)), phrase_boost=4.0, heading_phrase_boost=8.0),
    "all-versions": Profile("all-versions", (("heading", 10.0), ("num", 2.0), ("body", 1.0)), phrase_boost=4.0, heading_phrase_boost=8.0, scope="all", current_boost=6.0),
}
SORTS = ("relevance", "citation", "recent")


def phrase_hits(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, slop: int = 2) -> DataFrame:
    """(query, doc, idf) of documents in which all words of a query stand in order, up to ``slop`` words between two.

    ``queries`` is query, text, a small table. A query of one word, or with other signs than letters, digits and
    blanks, has no phrase. ``idf`` is the sum over the query's words. Places of query words only are shuffled, and
    words are joined place by place.
    """
    plain = queries.filter(F.col("text").rlike(r"^[\p{L}\p{N}_\s]+$")).select("query", terms(F.col("text")).alias("_w")).filter(F.size("_w") > 1)
    wanted = plain.select("query", F.size("_w").alias("m"), F.posexplode("_w").alias("i", "term"))
    longest = wanted.agg(F.max("m")).first()[0] or 0
    words = docs.select(F.col(id_col).alias("doc"), terms(F.col(text_col)).alias("w"))
    places = words.select("doc", F.posexplode("w").alias("at", "term")).join(wanted.select("term").distinct(), "term", "left_semi")
    total = F.broadcast(docs.agg(F.count("*").alias("_n")))  # one row
    df = places.groupBy("term").agg(F.count_distinct("doc").alias("_df")).crossJoin(total).select("term", F.log(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5)).alias("_idf"))
    weight = wanted.join(df, "term").groupBy("query").agg(F.sum("_idf").alias("idf"))
    stood = wanted.filter("i = 0").join(places, "term").select("query", "m", "doc", "at")
    done = None
    for i in range(1, longest):
        after = wanted.filter(F.col("i") == i).join(places, "term").select("query", "doc", F.col("at").alias("_next"))
        stood = stood.join(after, ["query", "doc"]).filter((F.col("_next") > F.col("at")) & (F.col("_next") <= F.col("at") + 1 + slop)).select("query", "m", "doc", F.col("_next").alias("at")).distinct()
        full = stood.filter(F.col("m") == i + 1).select("query", "doc").distinct()
        done = full if done is None else done.unionByName(full)
    if done is None:
        done = stood.select("query", "doc").limit(0)
    return done.join(weight, "query")


def profile_scores(docs: DataFrame, queries: DataFrame, profile: Profile, columns: dict[str, str], id_col: str = "doc_id", current: str | None = None) -> DataFrame:
    """(query, doc, score) under a profile: BM25 by field and weight, a phrase's boost times its words' idf.

    ``queries`` is query, text; ``columns`` maps the profile's fields to columns of ``docs``, fields without one do
    not score. ``current`` names the column that tells versions in force, by which the profile's scope filters or
    boosts; without it every row counts once.
    """
    if current and profile.scope == "current":
        docs = docs.filter(F.col(current))
    words = queries.select("query", F.explode(terms(F.col("text"))).alias("term")).distinct()
    parts = [(bm25(docs, words, id_col, columns[name]), weight) for name, weight in profile.fields if name in columns]
    for name, boost in (("body", profile.phrase_boost), ("heading", profile.heading_phrase_boost)):
        if boost and name in columns:
            parts.append((phrase_hits(docs, queries, id_col, columns[name], profile.slop).withColumnRenamed("idf", "score"), boost))
    out = weighted_score(parts)
    if current and profile.scope == "all" and profile.current_boost != 1.0:
        now = docs.select(F.col(id_col).alias("doc"), F.col(current).alias("_now"))
        out = out.join(now, "doc").select("query", "doc", (F.col("score") * F.when(F.col("_now"), profile.current_boost).otherwise(1.0)).alias("score"))
    return out


def sort_hits(hits: DataFrame, sort: str, tie: str, sort_key: str = "sort_key", first_seq: str = "first_seq") -> DataFrame:
    """Hits by ``relevance`` (score), ``citation`` (``sort_key``, missing last) or ``recent`` (``first_seq``, newest first),
    then by score and ``tie``."""
    if sort not in SORTS:
        raise ValueError(f"sort is one of {', '.join(SORTS)}")
    first = {"relevance": [], "citation": [F.col(sort_key).asc_nulls_last()], "recent": [F.col(first_seq).desc_nulls_last()]}[sort]
    return hits.orderBy(*first, F.desc("score"), tie)


def page(ordered: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """``limit`` (1 to 100) rows of an ordered result from ``offset`` (0 to 1000) on."""
    if not (1 <= limit <= 100 and 0 <= offset <= 1000):
        raise ValueError("limit is 1 to 100, offset 0 to 1000")
    return ordered.offset(offset).limit(limit)


def profile_means(scores: DataFrame) -> DataFrame:
    """Mean nDCG and recall per profile over queries (profile, query, ndcg, recall), to four places."""
    return scores.groupBy("profile").agg(F.round(F.avg("ndcg"), 4).alias("ndcg"), F.round(F.avg("recall"), 4).alias("recall"))
