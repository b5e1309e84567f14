"""XML snapshots, release pages and JSON ledgers as DataFrames.

Files are read by Spark (binaryFile), so any store Spark reads will do; each file is parsed by one task with
an event parser. A section's markup is kept as the source's own bytes, cut at the parser's offsets.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from palimpsest.functions.identifiers import content_hash, date_in_prose, squeeze, strip_tags, titles_in_prose
from palimpsest.functions.markup import whole_tag

#: Root namespaces and the schema generation that they mean.
GENERATIONS = {"http://xml.house.gov/schemas/uslm/1.0": "uslm-1", "http://schemas.gpo.gov/xml/uslm": "uslm-2"}
#: Element names of the levels above a section.
LEVELS = ("title", "subtitle", "chapter", "subchapter", "part", "subpart", "division", "subdivision", "appendix")
QUOTED = ("quotedContent", "quotedText")

#: Name spaces of a document's metadata.
DC, DCTERMS = "http://purl.org/dc/elements/1.1/", "http://purl.org/dc/terms/"


def _struct(**types: T.DataType | str) -> T.StructType:
    return T.StructType([T.StructField(k, T.StringType() if v == "string" else v) for k, v in types.items()])


_NAMES, _INT = T.ArrayType(T.StringType()), T.IntegerType()
_GUID = T.ArrayType(_struct(guid="string", identifier="string"))
_NOTE = T.ArrayType(_struct(topic="string", role="string", heading="string", markup="string"))
SECTION = _struct(
    path="string", generation="string", kind="string", seq=_INT, identifier="string", guid="string", temporal_id="string", level="string", num="string", num_value="string", heading="string", status="string",
    source_credit="string", parent_identifier="string", depth=_INT, ancestors=_NAMES, ancestor_levels=_NAMES, guid_refs=_GUID, notes=_NOTE, n_raw=_INT, markup="string",
)
METADATA = _struct(
    path="string", generation="string", identifier="string", doc_number="string", doc_title="string", doc_publication_name="string", release_label="string", is_positive_law=T.BooleanType(),
    created="string", converter="string", publisher="string", creator="string",
)


_ROOT = re.compile(rb"<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>|<([A-Za-z_][\w.:-]*)((?:\s[^>]*)?)>", re.S)
_SPACES = {name: re.compile(rb"xmlns(?::\w+)?=[\"']" + re.escape(space.encode()) + rb"[\"']") for space, name in GENERATIONS.items()}


def sniff_generation(head: bytes) -> str:
    """Schema generation by the root element's namespace; an unknown one is an error."""
    root = next((m for m in _ROOT.finditer(head) if m[1]), None)
    for name, space in _SPACES.items():
        if root and space.search(root[2]):
            return name
    raise ValueError("no known namespace on the root element")


def as_utf8(data: bytes) -> bytes:
    """A document's bytes in UTF-8, by its byte order mark or declaration; the parser's offsets are then offsets of UTF-8."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16").encode()
    said = re.match(rb"<\?xml[^>]*?\sencoding=[\"']([\w.-]+)", data)
    return data if not said or said[1].lower() in (b"utf-8", b"us-ascii", b"ascii") else data.decode(said[1].decode()).encode()


def _squeezed(text: list[str]) -> str | None:
    return " ".join("".join(text).split()) or None


#: What the parser makes of an element; others only count if they carry an identifier or an id, for the pins.
_KINDS = {"section": "section", "note": "note", "notes": "notes"} | dict.fromkeys(LEVELS, "level") | dict.fromkeys(QUOTED, "quoted") | dict.fromkeys(("num", "heading", "sourceCredit"), "text")


#: Elements that count for these columns only.
_FOR = {"num": {"num", "num_value"}, "heading": {"heading", "notes"}, "sourceCredit": {"source_credit"}, "note": {"notes"}, "notes": {"notes"}}


@lru_cache
def _tags(columns: frozenset[str]) -> Callable[[str], tuple[str, str | None]]:
    """Local name of an element, and its kind if it counts for one of the columns."""
    kinds = {tag: kind for tag, kind in _KINDS.items() if tag not in _FOR or _FOR[tag] & columns}

    @lru_cache(4096)
    def tag_of(name):
        tag = name.rpartition("|")[2]
        return tag, kinds.get(tag)

    return tag_of


class _Open:
    """An open element that counts."""

    __slots__ = ("tag", "kind", "attrs", "own", "row", "begin", "text", "heading", "first")

    def __init__(self, tag: str, kind: str | None, attrs: dict, own: str | None):
        self.tag, self.kind, self.attrs, self.own = tag, kind, attrs, own
        self.row = self.heading = None
        self.first = ()


def parse_document(data: bytes) -> list[dict]:
    """Structure nodes (pre-order) and real sections of one document, a section with its own notes and source credit.

    A section is real if it has an identifier and stands in no quoted content; one that is not stays inside
    its parent's markup. Equal identifiers are all kept, in document order. A section's own notes are its children and
    those of its children that group notes; notes deeper in belong to what they stand in.
    """
    return _parse_utf8(as_utf8(data), frozenset(SECTION.names))


def _parse_utf8(data: bytes, columns: frozenset[str]) -> list[dict]:
    """Rows in which the columns are right; others may be unset.

    The handlers below run for each tag, so they do nothing for elements of no account, and text is handed over only
    inside elements whose text is kept.
    """
    tag_of, pins, cuts = _tags(columns), "guid_refs" in columns, "markup" in columns
    parser = expat.ParserCreate("utf-8", "|")
    parser.buffer_text = True
    out: list[dict] = []
    stack: list[_Open | None] = []  # None: of no account
    caught: list[_Open] = []
    rows: list[dict] = []  # of the open sections and levels
    sections: list[dict] = []  # of the open sections
    named: list[str] = []  # identifiers of the open elements
    places = [0]  # of the next level below the document, and below each open row
    n_raw = n_sections = n_quoted = n_inside = 0

    def start(name, attrs):
        nonlocal n_raw, n_sections, n_quoted, n_inside
        tag, kind = tag_of(name)
        if not (kind or pins and attrs):
            stack.append(None)
            return
        own = attrs.get("identifier") or None
        if own and pins:
            named.append(own)
        if own or kind:
            node = _Open(tag, kind, attrs, own)
            if kind == "text":
                node.text = []
                caught.append(node)
                parser.CharacterDataHandler = text
            elif kind == "note":
                node.begin = parser.CurrentByteIndex
            elif kind == "quoted":
                n_quoted += 1
            elif kind == "section" or kind == "level":
                if own and not n_quoted and (kind == "section" or not n_inside):
                    if kind == "section":
                        seq = n_sections
                        n_sections += 1
                        node.begin = parser.CurrentByteIndex
                    else:
                        seq = places[-1]
                        places[-1] += 1
                    names = [r["identifier"] for r in rows]
                    node.row = {
                        "kind": "section" if kind == "section" else "node", "seq": seq, "identifier": own, "guid": attrs.get("id"), "temporal_id": attrs.get("temporalId"), "level": tag, "num": None, "num_value": None, "heading": None, "status": attrs.get("status"),
                        "source_credit": None, "parent_identifier": names[-1] if names else None, "depth": len(names), "ancestors": names, "ancestor_levels": [r["level"] for r in rows], "guid_refs": [], "notes": [], "markup": None,
                    }
                    out.append(node.row)
                    rows.append(node.row)
                    places.append(0)
                    if kind == "section":
                        sections.append(node.row)
                if kind == "section":
                    n_raw += 1
                    n_inside += 1
            stack.append(node)
        else:
            stack.append(None)
        if pins and sections and attrs.get("id"):
            sections[-1]["guid_refs"].append({"guid": attrs["id"], "identifier": named[-1] if named else None})

    def text(data_):
        for n in caught:
            n.text.append(data_)

    def source(node):
        opened = whole_tag(data, node.begin)  # an empty element ends there, and has no end tag to look for
        close = opened if data[opened - 2 : opened] == b"/>" else data.index(b">", parser.CurrentByteIndex) + 1
        return data[node.begin : close].decode()

    def end(_name):
        nonlocal n_quoted, n_inside
        node = stack.pop()
        if node is None:
            return
        kind, up = node.kind, stack[-1] if stack else None
        if kind == "text":
            caught.pop()
            if not caught:
                parser.CharacterDataHandler = None
            if up and node.tag not in up.first:  # later ones of a name do not count, even where the first is empty
                up.first += (node.tag,)
                if up.row and node.tag == "num":
                    up.row["num"], up.row["num_value"] = _squeezed(node.text), node.attrs.get("value")
                elif up.row:
                    up.row["heading" if node.tag == "heading" else "source_credit"] = _squeezed(node.text)
                elif node.tag == "heading":
                    up.heading = _squeezed(node.text)
        elif kind == "note":
            holder = stack[-2] if up and up.kind == "notes" and len(stack) > 1 else up
            if holder and holder.kind == "section" and holder.row:
                holder.row["notes"].append({"topic": node.attrs.get("topic"), "role": node.attrs.get("role"), "heading": node.heading, "markup": source(node)})
        elif kind == "quoted":
            n_quoted -= 1
        elif kind == "section":
            n_inside -= 1
        if node.row:
            rows.pop()
            places.pop()
            if kind == "section":
                if cuts:
                    node.row["markup"] = source(node)
                sections.pop()
        if node.own and pins:
            named.pop()

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.Parse(data, True)
    for r in out:
        r["n_raw"] = n_raw
    return out


class _Done(Exception):
    """Raised by a handler to stop the parser."""


def parse_metadata(data: bytes) -> dict:
    """What a document says about itself: its root's identifier and the first of each field of ``meta``, both generations.

    Reading stops behind ``meta``, or where the body begins without one. The release is what follows ``@`` in the
    publication's name.
    """
    data = as_utf8(data)
    generation = sniff_generation(data[:65536])
    parser = expat.ParserCreate("utf-8", "|")
    parser.buffer_text = True
    found: dict[tuple[str, str], str | None] = {}
    open_, root, said = [], {}, []

    def start(name, attrs):
        if not open_:
            root.update(attrs)
        elif len(open_) == 1 and name.rpartition("|")[2] != "meta":
            raise _Done
        open_.append((name, attrs))
        if len(open_) == 3:
            said.clear()
            parser.CharacterDataHandler = said.append

    def end(name):
        _, attrs = open_.pop()
        if len(open_) == 1:
            raise _Done
        if len(open_) == 2:
            parser.CharacterDataHandler = None
            space, _, tag = name.rpartition("|")
            key = ("property", attrs.get("role")) if tag == "property" else (space if space in (DC, DCTERMS) else "", tag)
            if key not in found:
                found[key] = _squeezed(said)

    parser.StartElementHandler, parser.EndElementHandler = start, end
    try:
        parser.Parse(data, True)
    except _Done:
        pass
    publication, positive = found.get(("", "docPublicationName")), ("property", "is-positive-law")
    old = generation == "uslm-1"
    return {
        "generation": generation,
        "identifier": root.get("identifier", ""),
        "doc_number": found.get(("", "docNumber")),
        "doc_title": found.get((DC, "title")),
        "doc_publication_name": publication,
        "release_label": (publication or "").partition("@")[2] or None,
        "is_positive_law": (found[positive] or "").lower() == "yes" if old and positive in found else None,
        "created": found.get((DCTERMS, "created") if old else ("", "processedDate")),
        "converter": found.get((DC, "creator") if old else ("", "processedBy")),
        "publisher": None if old else found.get((DC, "publisher")),
        "creator": None if old else found.get((DC, "creator")),
    }


def xml_member(content: bytes) -> bytes:
    """The only XML member of a zip file, or the bytes themselves."""
    if content[:2] != b"PK":
        return content
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = [n for n in z.namelist() if n.lower().endswith(".xml")]
        if len(names) != 1:
            raise ValueError(f"{len(names)} XML members, not one")
        return z.read(names[0])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            yield path, xml_member(content)


def _records(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of many documents in one batch, as a batch costs as much as many rows: of 2,048 rows, or less if their markup is long."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r.get("markup") or "")
        if len(held) == 2048 or size > 1 << 21:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _parser(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    columns = frozenset(schema.names)

    def rows(batches):
        for path, data in _contents(batches):
            data = as_utf8(data)
            generation = sniff_generation(data[:65536])
            for r in _parse_utf8(data, columns):
                r["path"], r["generation"] = path, generation
                yield r

    return lambda batches: _records(rows(batches), schema)


def _parse_metadata(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _records(({"path": path} | parse_metadata(data) for path, data in _contents(batches)), to_arrow_schema(METADATA))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def plain_text(markup: Column) -> Column:
    """Markup without tags and with single blanks; null when nothing is left."""
    return squeeze(strip_tags(markup))


def parse_snapshots(files: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Sections and structure nodes of documents given as (path, content), with content hashes; or only the ``columns`` of
    :data:`SECTION` that are named, as columns that nobody reads are handed over too."""
    schema = T.StructType([SECTION[c] for c in columns]) if columns else SECTION
    rows = files.select("path", "content").mapInArrow(_parser(to_arrow_schema(schema)), schema)
    return rows if columns else rows.withColumn("content_hash", content_hash(F.col("markup"))).withColumn("text", plain_text(F.col("markup")))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Sections and structure nodes of all XML (or zipped XML) files under ``path``, with content hashes."""
    return parse_snapshots(_files(spark, path))


def snapshot_metadata(files: DataFrame) -> DataFrame:
    """One row of metadata for each document given as (path, content)."""
    return files.select("path", "content").mapInArrow(_parse_metadata, METADATA)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row of metadata for each XML (or zipped XML) file under ``path``."""
    return snapshot_metadata(_files(spark, path))


def section_notes(sections: DataFrame) -> DataFrame:
    """One row for each note of a section: path, identifier, seq of the section, place (from 0), topic, role, heading, markup."""
    rows = sections.filter("kind = 'section'").select("path", "identifier", "seq", F.posexplode("notes").alias("place", "n"))
    return rows.select("path", "identifier", "seq", "place", "n.*")


def guid_pins(sections: DataFrame) -> DataFrame:
    """(guid, identifier) of every element with an id inside a section; the last one met wins."""
    refs = sections.filter("kind = 'section'").select("seq", F.posexplode("guid_refs").alias("pos", "r"))
    return refs.groupBy("r.guid").agg(F.max_by("r.identifier", F.struct("seq", "pos")).alias("identifier"))


def read_release_page(spark: SparkSession, path: str) -> DataFrame:
    """Releases listed on a page, newest first there: label, titles, date, description, seq (oldest 0).

    Commented entries are skipped, entries of one label are merged (all titles, first date and prose), and
    entries without a date are left out.
    """
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"(?s)<!--.*?-->", "").alias("v"))
    items = text.select(F.posexplode(F.regexp_extract_all("v", F.lit(r'(?s)<li[^>]*class="releasepoint"[^>]*>(.*?)</li>'), F.lit(1))).alias("pos", "item"))
    prose = squeeze(strip_tags(F.col("item")))
    rows = items.select("pos", F.regexp_extract("item", r"@([0-9A-Za-z-]+)\.htm", 1).alias("label"), titles_in_prose(prose).alias("titles"), date_in_prose(prose).alias("date"), prose.alias("description"))
    one = rows.filter("label != ''").groupBy("label").agg(
        F.min("pos").alias("pos"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("titles")))).alias("titles"), F.min_by("date", F.when(F.col("date").isNotNull(), F.col("pos"))).alias("date"), F.min_by("description", "pos").alias("description")
    )
    # one page of releases: small by nature, so one partition may number it
    return one.filter("date is not null").withColumn("seq", F.row_number().over(W.orderBy(F.desc("pos"))) - 1).drop("pos")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a download ledger; paths keep their last two parts."""
    rows = spark.read.json(path, multiLine=True).select(F.explode("entries").alias("e")).select("e.*")
    return rows.withColumn("path", F.array_join(F.slice(F.split("path", "/"), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(1)), 2), "/")) if "path" in rows.columns else rows


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row per release and title of the provenance manifests under ``path``."""
    rows = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.release").alias("release"), F.get_json_object("value", "$.titles").alias("t"))
    fields = "map<string, struct<deduped_section_versions:bigint, new_section_versions:bigint, raw_section_elements:bigint, sections_ingested:bigint, schema_version:string, sha256:string, structure_nodes:bigint, status_counts:map<string,bigint>>>"
    return rows.select("release", F.explode(F.from_json("t", fields)).alias("title", "m")).select("release", "title", "m.*")
