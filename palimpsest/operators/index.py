"""A positional inverted index: documents are tokenised once, searches read postings.

Documents are dealt into blocks of about 1,024 by a hash of their id, the same for all terms and fields, and a task
inverts whole blocks, so texts are shuffled once and postings never. A row of ``postings`` is what one term has in one field of one block: an array of (doc, tf, dl, at) and, beside it, the greatest
tf and least length, from which a bound on any of its BM25 scores follows whatever the parameters. Rows are
partitioned by a hash of the term and sorted by term, so a search opens the folders and row groups of its words
only; a word that stands everywhere is many rows, cut by block, and no task sees more than a block of it.

``top`` scores the most promising blocks of each query first and then only blocks whose bound reaches the k-th
best score found; results equal scoring everything. Ids are as given, rows with null ids are not indexed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from palimpsest.functions.identifiers import chapter_of, code_order_key, strip_tags, title_of
from palimpsest.operators import search
from palimpsest.sources.store import Snapshot, Store

BLOCK_DOCS = 1024
BUCKETS = 64
#: Blocks that a task inverts; each task writes a file a bucket.
TASK_BLOCKS = 16
_SLACK = 1e-9  # sums of doubles in another order


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _write_postings(df: DataFrame, path: str) -> None:
    df.sortWithinPartitions("bucket", "term", "field", "block").write.partitionBy("bucket").parquet(path)


def _posting_type(doc: T.DataType) -> T.StructType:
    post = T.StructType().add("doc", doc).add("tf", "integer").add("dl", "integer").add("at", T.ArrayType(T.IntegerType()))
    return T.StructType().add("term", "string").add("field", "string").add("block", "long").add("n", "long").add("cf", "long").add("max_tf", "integer").add("min_dl", "integer").add("posts", T.ArrayType(post))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by ``block`` as one table a block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        at = batch.column("block").to_numpy()
        starts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist()] if len(at) else []
        for start, end in zip(starts, [*starts[1:], len(at)], strict=True):
            if held and held[-1].column("block")[0].as_py() != at[start]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def _inverted(docs: pa.Array, words: pa.ListArray, field: str, block: int, schema: pa.Schema) -> pa.RecordBatch:
    """The postings of one field in one block, from each document's words; rows of one id and length are one document."""
    dl = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    code = coded.indices.to_numpy()
    row = np.repeat(np.arange(len(dl)), dl)
    at = np.arange(len(row)) - np.repeat(np.cumsum(dl) - dl, dl)
    pair = docs.dictionary_encode().indices.to_numpy().astype(np.int64) * (dl.max() + 1) + dl
    _, first, same = np.unique(pair, return_index=True, return_inverse=True)
    if len(first) < len(pair):  # an id stands twice
        row = first[same][row]
        order = np.lexsort((at, row, code))
    else:
        order = np.argsort(code, kind="stable")
    code, row, at = code[order], row[order], at[order]
    starts = lambda new: np.concatenate([[0], np.flatnonzero(new) + 1])
    posts = starts((code[1:] != code[:-1]) | (row[1:] != row[:-1]))
    tf, dl, row, post_code = np.diff(posts, append=len(code)), dl[row[posts]], row[posts], code[posts]
    terms = starts(post_code[1:] != post_code[:-1])
    kind = schema.field("posts").type
    offsets = lambda begins, end: pa.array(np.append(begins, end), pa.int32())
    places = pa.ListArray.from_arrays(offsets(posts, len(code)), pa.array(at, pa.int32()), type=kind.value_type.field("at").type)
    post = pa.StructArray.from_arrays([docs.take(pa.array(row)), pa.array(tf, pa.int32()), pa.array(dl, pa.int32()), places], fields=list(kind.value_type))
    columns = [
        coded.dictionary.take(pa.array(post_code[terms])), pa.repeat(field, len(terms)), pa.repeat(pa.scalar(block, pa.int64()), len(terms)), pa.array(np.diff(terms, append=len(posts))),
        pa.array(np.add.reduceat(tf, terms)), pa.array(np.maximum.reduceat(tf, terms), pa.int32()), pa.array(np.minimum.reduceat(dl, terms), pa.int32()), pa.ListArray.from_arrays(offsets(terms, len(posts)), post, type=kind),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _inverter(names: list[str], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def invert(batches):
        for table in _blocks(batches):
            for name in names:
                kept = table.filter(pa.array([bool(n) for n in table.column(f"_{name}").combine_chunks().value_lengths().to_pylist()]))
                if kept.num_rows:
                    found = _inverted(kept.column("doc").combine_chunks(), kept.column(f"_{name}").combine_chunks(), name, kept.column("block")[0].as_py(), schema)
                    for i in range(0, found.num_rows, 8192):
                        yield found.slice(i, 8192)

    return invert


def build_index(spark: SparkSession, root: str, docs: DataFrame, id_col: str, fields: Mapping[str, str], attributes: Iterable[str] = (), promote: bool = True) -> Snapshot:
    """Index ``fields`` (name -> text column) of ``docs`` under ``root`` and let readers have it.

    Texts are shuffled once, by block, and a task inverts one block after the other and writes its postings where it is.
    ``attributes`` are columns that searches filter, sort and show by.
    """
    rows = docs.filter(F.col(id_col).isNotNull())
    sizes = rows.agg(F.count("*").alias("n_docs"), *(F.count(c).alias(f"_{name}") for name, c in fields.items())).first()
    n_docs = sizes.n_docs
    blocks = max(1, -(-n_docs // BLOCK_DOCS))
    block = F.pmod(F.xxhash64(F.col(id_col)), F.lit(blocks)).alias("block")
    tasks = min(blocks, max(spark.sparkContext.defaultParallelism, -(-blocks // TASK_BLOCKS)))
    placed = rows.select(F.col(id_col).alias("doc"), block, *(F.col(c).alias(f"_{name}") for name, c in fields.items())).repartition(tasks, "block").sortWithinPartitions("block")
    words = placed.select("doc", "block", *(search.terms(F.col(f"_{name}")).alias(f"_{name}") for name in fields))
    schema = _posting_type(words.schema["doc"].dataType)
    postings = words.mapInArrow(_inverter(list(fields), to_arrow_schema(schema)), schema)
    postings = postings.withColumn("bucket", _bucket(F.col("term"), BUCKETS))
    store = Store(spark, root)
    tables = {"postings": store.write("postings", postings, _write_postings), "documents": store.write("documents", rows.select(F.col(id_col).alias("doc"), *attributes))}
    # the dictionary comes from the written postings' narrow columns
    lexicon = store.read(tables["postings"]).groupBy("bucket", "term", "field").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"))
    tables["lexicon"] = store.write("lexicon", lexicon, lambda df, path: df.repartition("bucket").write.partitionBy("bucket").parquet(path))
    tokens = {r.field: r.cf for r in store.read(tables["lexicon"]).groupBy("field").agg(F.sum("cf").alias("cf")).collect()}
    built = store.commit(tables, {"n_docs": n_docs, "buckets": BUCKETS, "tokens": {name: tokens.get(name, 0) for name in fields}, "filled": {name: sizes[f"_{name}"] for name in fields}})
    if promote:
        store.promote(built)
    return built


@dataclass(frozen=True)
class Index:
    """A generation of an index, with the parameters of BM25."""

    snapshot: Snapshot
    k1: float = 1.2
    b: float = 0.75

    @property
    def documents(self) -> DataFrame:
        return self.snapshot.table("documents")

    def lexicon(self, field: str | None = None) -> DataFrame:
        found = self.snapshot.table("lexicon")
        return found.filter(F.col("field") == field) if field else found

    def _average(self, field: Column) -> Column:
        """Mean length of a field over the documents that have one (an empty text counts, a null one does not)."""
        out = F.lit(1.0)
        for name, tokens in self.snapshot.facts["tokens"].items():
            out = F.when(field == name, tokens / max(1, self.snapshot.facts["filled"][name])).otherwise(out)
        return out

    def idf(self, df: Column) -> Column:
        return F.log(1 + (self.snapshot.facts["n_docs"] - df + 0.5) / (df + 0.5))

    def part(self, tf: Column, dl: Column, field: Column) -> Column:
        """What a term adds to a score, without its idf."""
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / self._average(field)))

    def wanted(self, queries: DataFrame, weights: Mapping[str, float]) -> DataFrame:
        """(bucket, term, field, query, weight) of ``queries`` (query, term), a small table, which goes to the postings
        and not they to it; weight is the field's times the idf."""
        fields = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
        terms = queries.select("query", "term").distinct().withColumn("bucket", _bucket(F.col("term"), self.snapshot.facts["buckets"]))
        lexicon = self.lexicon().filter(F.col("field").isin(*weights))
        return lexicon.join(F.broadcast(terms), ["bucket", "term"]).select("bucket", "term", "field", "query", (self.idf(F.col("df")) * F.try_element_at(fields, F.col("field"))).alias("weight"))

    def _scored(self, wanted: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
        hit = self.snapshot.table("postings").select("bucket", "term", "field", "block", "posts").join(F.broadcast(wanted), ["bucket", "term", "field"])
        if blocks is not None:
            hit = hit.join(blocks, ["query", "block"])
        rows = hit.select("query", "field", "weight", F.explode("posts").alias("p"))
        return rows.select("query", F.col("p.doc").alias("doc"), (F.col("weight") * self.part(F.col("p.tf"), F.col("p.dl"), F.col("field"))).alias("s")).groupBy("query", "doc").agg(F.sum("s").alias("score"))

    def scores(self, queries: DataFrame, weights: Mapping[str, float]) -> DataFrame:
        """(query, doc, score) of every document with a word of the query in one of the fields; ``queries`` is query, term."""
        return self._scored(self.wanted(queries, weights))

    def bounds(self, wanted: DataFrame) -> DataFrame:
        """(query, block, bound): no document of the block scores more."""
        heads = self.snapshot.table("postings").select("bucket", "term", "field", "block", "max_tf", "min_dl").join(F.broadcast(wanted), ["bucket", "term", "field"])
        return heads.groupBy("query", "block").agg(F.sum(F.col("weight") * self.part(F.col("max_tf"), F.col("min_dl"), F.col("field"))).alias("bound"))

    def top(self, queries: DataFrame, weights: Mapping[str, float], k: int = 10, lead: int = 4) -> DataFrame:
        """(query, rank, doc, score): the ``k`` best of :meth:`scores` (ties to the smaller doc). ``lead`` blocks of a query
        are scored first; of the others only those that can still hold one of the k best."""
        wanted = self.wanted(queries, weights)
        order = W.partitionBy("query").orderBy(F.desc("bound"), "block")
        bounds = self.bounds(wanted).withColumn("place", F.row_number().over(order))
        best = lambda scored: scored.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "doc")))
        first = best(self._scored(wanted, bounds.filter(F.col("place") <= lead).select("query", "block"))).filter(F.col("rank") <= k)
        floor = first.filter(F.col("rank") == k).select("query", F.col("score").alias("floor"))
        rest = bounds.filter(F.col("place") > lead).join(floor, "query", "left").filter(F.col("floor").isNull() | (F.col("bound") * (1 + _SLACK) >= F.col("floor")))
        later = self._scored(wanted, rest.select("query", "block"))
        return best(first.drop("rank").unionByName(later)).filter(F.col("rank") <= k).select("query", "rank", "doc", "score")

    def places(self, terms: DataFrame, field: str) -> DataFrame:
        """(term columns, doc, at): sorted places of terms (term and any other columns, a small table) in the documents of a field."""
        terms = terms.withColumn("bucket", _bucket(F.col("term"), self.snapshot.facts["buckets"]))
        rows = self.snapshot.table("postings").filter(F.col("field") == field).select("bucket", "term", "posts").join(F.broadcast(terms), ["bucket", "term"])
        return rows.select(*(c for c in terms.columns if c != "bucket"), F.explode("posts").alias("p")).select("*", F.col("p.doc").alias("doc"), F.col("p.at").alias("at")).drop("p")

    def phrases(self, phrases: DataFrame, field: str) -> DataFrame:
        """(phrase, doc) of documents in which a phrase's words stand in order; ``phrases`` is phrase, words, slop (words
        that may stand between two neighbours). Sorted places are shifted and intersected, word by word."""
        words = phrases.select("phrase", "slop", F.size("words").alias("m"), F.posexplode("words").alias("i", "term"))
        found = self.places(words, field).groupBy("phrase", "doc", "slop", "m").agg(F.array_sort(F.collect_list(F.struct("i", "at"))).alias("w"))
        whole = found.filter(F.size("w") == F.col("m"))
        reach = lambda ends: F.flatten(F.transform(F.sequence(F.lit(1), F.col("slop") + 1), lambda d: F.transform(ends, lambda p: p + d)))
        stood = F.aggregate(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), F.get("w", F.lit(0)).at, lambda ends, x: F.array_intersect(reach(ends), x.at))
        return whole.filter(F.size(stood) > 0).select("phrase", "doc")

    def match(self, expression: str, field: str = "body") -> DataFrame:
        """(doc) of the documents that a boolean text expression matches (see ``search.parse_text``)."""
        node = search.parse_text(expression)
        leaves = search.leaves_of(node)
        spark, mask = self.snapshot.spark, lambda i: F.lit(1 << i).cast("bigint")
        if len(leaves) > 63:
            raise ValueError("an expression may have 63 different words and phrases")
        hits = None
        for i, leaf in enumerate(leaves):
            if leaf[0] == "phrase" and len(leaf[1]) > 1:
                asked = spark.range(1).select(F.lit(i).alias("phrase"), F.array(*map(F.lit, leaf[1])).alias("words"), F.lit(leaf[2]).alias("slop"))
                docs = self.phrases(asked, field).select("doc")
            else:
                lexicon = self.lexicon(field)
                if leaf[0] == "phrase":
                    # literals, so that only the word's own folder is listed and row groups are skipped
                    kept = self.snapshot.table("postings").filter((F.col("bucket") == _bucket(F.lit(leaf[1][0]), self.snapshot.facts["buckets"])) & (F.col("term") == leaf[1][0]) & (F.col("field") == field))
                elif leaf[0] == "prefix":
                    kept = self.snapshot.table("postings").filter(F.col("term").startswith(leaf[1]) & (F.col("field") == field))
                else:
                    near = lexicon.filter(F.levenshtein("term", F.lit(leaf[1]), leaf[2]) >= 0).select("bucket", "term")
                    kept = self.snapshot.table("postings").filter(F.col("field") == field).join(near, ["bucket", "term"], "left_semi")
                docs = kept.select(F.explode(F.col("posts.doc")).alias("doc"))
            part = docs.select("doc", mask(i).alias("leaf"))
            hits = part if hits is None else hits.unionByName(part)
        holds = lambda bits: lambda leaf: bits.bitwiseAND(mask(leaves.index(leaf))) != 0
        if hits is None:
            return self.documents.select("doc").filter(search.predicate(node, holds(F.lit(0))))
        hits = hits.groupBy("doc").agg(F.bit_or("leaf").alias("bits"))
        none = spark.range(1).filter(search.predicate(node, holds(F.lit(0).cast("bigint")))).take(1)
        if none:  # a document without any of the words may match
            hits = self.documents.select("doc").join(hits, "doc", "left").withColumn("bits", F.coalesce("bits", F.lit(0)))
        return hits.filter(search.predicate(node, holds(F.col("bits")))).select("doc")

    def profile_scores(self, queries: DataFrame, profile: search.Profile, current: str | None = None) -> DataFrame:
        """(query, doc, score) under a profile: BM25 by field and weight, a phrase's boost times its words' idf.

        ``queries`` is query, text; fields that are not indexed do not score. ``current`` names the attribute that
        tells versions in force, by which the profile's scope filters or boosts.
        """
        indexed = self.snapshot.facts["tokens"]
        words = queries.select("query", F.explode(search.terms(F.col("text"))).alias("term")).distinct()
        parts = [self.scores(words, {name: weight for name, weight in profile.fields if name in indexed})]
        plain = queries.filter(F.col("text").rlike(r"^[\p{L}\p{N}_\s]+$")).select(F.col("query").alias("phrase"), search.terms(F.col("text")).alias("words"), F.lit(profile.slop).alias("slop")).filter(F.size("words") > 1)
        for name, boost in (("body", profile.phrase_boost), ("heading", profile.heading_phrase_boost)):
            if boost and name in indexed:
                weight = self.wanted(plain.select(F.col("phrase").alias("query"), F.explode("words").alias("term")), {name: boost}).join(plain.select(F.col("phrase").alias("query"), F.explode("words").alias("term")), ["query", "term"])
                weight = weight.groupBy("query").agg(F.sum("weight").alias("score"))
                parts.append(self.phrases(plain, name).withColumnRenamed("phrase", "query").join(weight, "query"))
        out = search.weighted_score([(p, 1.0) for p in parts])
        if current and (profile.scope == "current" or profile.current_boost != 1.0):
            now = self.documents.select("doc", F.coalesce(F.col(current), F.lit(False)).alias("_now"))
            out = out.join(now, "doc")
            if profile.scope == "current":
                return out.filter("_now").drop("_now")
            out = out.withColumn("score", F.col("score") * F.when(F.col("_now"), profile.current_boost).otherwise(1.0)).drop("_now")
        return out.select("query", "doc", "score")


def section_documents(versions: DataFrame) -> DataFrame:
    """Versions of sections as search documents: an id of identifier and first release, the markup's text, and the title,
    chapter and place in the code's order that follow from the identifiers.

    ``versions`` is identifier, first_release_id, first_release_seq, is_current and, where known, first_release_label, num,
    heading, xml, status, version_id, parent_identifier, seq_in_title, id_collision.
    """
    optional = {"first_release_label": "string", "num": "string", "heading": "string", "xml": "string", "status": "string", "version_id": "bigint", "parent_identifier": "string", "seq_in_title": "int", "id_collision": "boolean"}
    rows = versions.withColumns({c: F.lit(None).cast(kind) for c, kind in optional.items() if c not in versions.columns})
    title = title_of(F.col("identifier"))
    return rows.select(
        F.concat("identifier", F.lit("@"), F.col("first_release_id").cast("string")).alias("doc"), F.lit("section").alias("type"), "identifier", "num", "heading", strip_tags(F.col("xml")).alias("body"), "status", "version_id",
        title.alias("title_num"), chapter_of(F.col("parent_identifier")).alias("chapter"), code_order_key(title, F.col("seq_in_title")).alias("sort_key"), F.coalesce("id_collision", F.lit(False)).alias("id_collision"),
        F.lit(None).cast("string").alias("level"), "first_release_id", "first_release_seq", "first_release_label", "is_current",
    )


def node_documents(nodes: DataFrame) -> DataFrame:
    """Nodes of the structure (identifier, level, num, heading, status, first_release_seq) as search documents: always
    current, before the sections below them in the code's order."""
    title = title_of(F.col("identifier"))
    return nodes.select(
        F.col("identifier").alias("doc"), F.lit("structure").alias("type"), "identifier", "num", "heading", "status", "level", title.alias("title_num"), chapter_of(F.col("identifier")).alias("chapter"),
        code_order_key(title, F.lit(None).cast("int")).alias("sort_key"), F.lit(False).alias("id_collision"), "first_release_seq", F.lit(True).alias("is_current"),
    )


def retire_versions(spark: SparkSession, root: str, keys: DataFrame) -> Snapshot:
    """Superseded versions (identifier, first_release_id) are no longer current. Only the documents' attributes are
    written anew; the postings of the generation before are taken over. Keys that are not indexed are passed over."""
    store = Store(spark, root)
    now = store.current()
    gone = keys.select("identifier", "first_release_id").distinct().withColumn("_gone", F.lit(True))
    docs = now.table("documents").join(gone, ["identifier", "first_release_id"], "left").withColumn("is_current", F.col("is_current") & F.col("_gone").isNull())
    table = store.write("documents", docs.select(*now.table("documents").columns))
    built = store.commit(now.tables | {"documents": table}, now.facts)
    store.promote(built)
    return built


def want_release(release: str | None, date: str | None, q: search.Query) -> tuple[str | None, str | None]:
    """Release and date to search at: what is asked for beside the query goes before what stands in it."""
    return (release if release is not None else q.release, date if date is not None else q.date)


def shaped_results(index: Index, hits: DataFrame, sort: str = "relevance", limit: int = 20, offset: int = 0, seq: int | None = None, all_versions: bool = False, fragments: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """One page of results and the total, of one query's hits (doc, score).

    By default versions in force count. As of release ``seq``, or over all versions, an identifier is one result: its
    newest version that matches (first seen by ``seq``), placed by the identifier's best score, and the total counts
    identifiers. Without a release each result tells how many superseded versions match too.
    """
    rows = index.documents.join(hits.select("doc", "score"), "doc")
    if seq is not None or all_versions:
        rows = rows.filter(F.col("first_release_seq") <= seq) if seq is not None else rows
        shown = search.collapse(rows, "identifier", "first_release_seq").withColumn("score", F.col("best")).drop("best")
    else:
        shown = rows.filter("is_current")
    total = shown.agg(F.count_distinct("identifier").alias("total") if seq is not None or all_versions else F.count("*").alias("total"))
    page = search.page(search.sort_hits(shown, sort, "doc", "sort_key", "first_release_seq"), limit, offset)
    if seq is None:
        # the join does not keep the page's order
        page = search.sort_hits(search.earlier_matches(page, rows, "identifier"), sort, "doc", "sort_key", "first_release_seq")
    return page, total
