"""Notes, metadata and encodings of documents; depths and running text against a tree of the whole markup."""

import random
import re
import xml.etree.ElementTree as ET

import pyarrow as pa
import pytest
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from palimpsest.functions import markup, shape
from palimpsest.functions.markup import INNER_LEVELS
from palimpsest.functions.shape import QUOTED, depth_ladder, shape_of
from palimpsest.sources import documents as S

OLD, NEW = S.GENERATIONS
DC = f'xmlns:dc="{S.DC}" xmlns:dcterms="{S.DCTERMS}"'


def doc(body, meta="", space=OLD, head=""):
    return f'{head}<uscDoc xmlns="{space}" {DC} identifier="/us/usc/t1">{meta}<main><title identifier="/us/usc/t1">{body}</title></main></uscDoc>'


def test_notes_are_a_sections_own(spark, tmp_path):
    body = (
        "<chapter identifier='/c'><section identifier='/s'><note/><p><note>of the paragraph</note></p><notes><note topic='a'><p><heading>inner</heading></p><heading> own\n<b><i><u>deep</u></i></b></heading></note>"
        "<group><note>deeper</note></group></notes><sourceCredit/><sourceCredit>second</sourceCredit></section><section identifier='/empty' a='>'/><notes><note>of the chapter</note></notes></chapter>"
    )
    (tmp_path / "a.xml").write_text(doc(body))
    rows = S.read_snapshots(spark, str(tmp_path))
    notes = S.section_notes(rows).orderBy("place").collect()
    assert [(n.place, n.topic, n.heading, n.markup[:9]) for n in notes] == [(0, None, None, "<note/>"), (1, "a", "own deep", "<note top")]
    sections = {r.identifier: r for r in rows.filter("kind = 'section'").collect()}
    assert sections["/s"].source_credit is None and sections["/s"].ancestor_levels == ["title", "chapter"]
    assert sections["/empty"].markup == "<section identifier='/empty' a='>'/>" and sections["/empty"].notes == []


@pytest.mark.parametrize("encoding", ["UTF-8", "ISO-8859-1", "UTF-16"])
def test_encodings_give_the_same_records(encoding):
    text = doc("<section identifier='/é'><heading>Ünïcode ½</heading></section>", head=f"<?xml version='1.0' encoding='{encoding}'?>")
    rows = S.parse_document(text.encode(encoding))
    assert rows[-1]["heading"] == "Ünïcode ½" and rows[-1]["markup"] == "<section identifier='/é'><heading>Ünïcode ½</heading></section>"


def test_metadata_of_both_generations():
    old = "<meta><docNumber> 16 </docNumber><docPublicationName>Online@119-1not2</docPublicationName><property role='x'>yes</property><property role='is-positive-law'>Yes</property><dcterms:created>2025</dcterms:created><dc:creator>tool</dc:creator></meta>"
    got = S.parse_metadata(doc("", old).encode())
    assert (got["doc_number"], got["release_label"], got["is_positive_law"], got["created"], got["converter"], got["creator"]) == ("16", "119-1not2", True, "2025", "tool", None)
    new = "<meta><docPublicationName>Online</docPublicationName><processedDate>2026</processedDate><processedBy>t2</processedBy><dc:publisher>P</dc:publisher><dc:creator>C</dc:creator></meta>"
    got = S.parse_metadata(doc("", new, NEW).encode())
    assert (got["generation"], got["release_label"], got["created"], got["converter"], got["publisher"], got["creator"], got["is_positive_law"]) == ("uslm-2", None, "2026", "t2", "P", "C", None)
    # without metadata nothing behind the first body element is read, not even what is not well formed
    got = S.parse_metadata((doc("") + "<").encode())
    assert got["identifier"] == "/us/usc/t1" and got["doc_number"] is None


def random_markup(rng, depth=0):
    tag = rng.choice(["subsection", "paragraph", "p", "i", "num", "note", "quotedContent", "level"])
    inner = "".join(rng.choice(["", " ", "x ", "<!-- c -->", random_markup(rng, depth + 1) if depth < 6 else ""]) for _ in range(rng.randint(0, 5)))
    return f"<{tag}>{inner}</{tag}>"


def plain_shape(text):
    root, levels, elements = ET.fromstring(text), [], {}

    def number(e):
        return (e.text or "") + "".join(("" if c.tag in ("note", "footnote") else number(c)) + (c.tail or "") for c in e)

    def walk(e, before, after, depth, quoted):
        place = elements.setdefault(e.tag, [0, 0])
        place[not ((before or "").strip() or (after or "").strip())] += 1
        quoted = quoted or e.tag in QUOTED
        if e.tag in INNER_LEVELS and not quoted:
            depth += 1
            nums = [" ".join(number(c).split()) for c in e if c.tag == "num"]
            levels.append((depth, next((n for n in nums if n), None)))
        before = e.text
        for c in e:
            walk(c, before, c.tail, depth, quoted)
            before = c.tail

    walk(root, None, None, 0, False)
    return max((d for d, _ in levels), default=0), levels, {k: tuple(v) for k, v in elements.items()}


def test_shape_equals_a_tree(spark):
    rng = random.Random(5)
    texts = [f"<section>{''.join(random_markup(rng) for _ in range(3))}</section>" for _ in range(300)]
    for t in texts:
        depth, levels, elements = shape_of(t)
        assert (depth, [(x["depth"], x["num"]) for x in levels], {e["name"]: (e["inline"], e["isolated"]) for e in elements}) == plain_shape(t), t
    assert shape_of("<a><b></a>") is None and shape_of(None) is None
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("bad", "<a>"), ("none", None)], "identifier string, markup string").selectExpr("*", "1 AS depth", "2 AS num")
    got = {r.depth: r for r in depth_ladder(df).collect()}
    want = [plain_shape(t) for t in texts]
    for d in range(max(w[0] for w in want) + 1):
        ids = [str(i) for i, w in enumerate(want) if w[0] == d]
        nums = [n for w in want for k, n in w[1] if k == d and n]
        assert (got[d].n_sections, got[d].example, got[d].n_levels) == (len(ids), min(ids, default=None), sum(k == d for w in want for k, _ in w[1]))
        assert got[d].widest_num == max(nums, key=lambda n: (len(n), n), default=None)
    assert depth_ladder(df.limit(0)).count() == 0


def handed_over(name, spark):
    """What the Python stages of a registered query hand back to the engine, by its plan."""
    from palimpsest.plans import registry

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    return [re.findall(r"(\w+)#\d+", line.rpartition("[")[2] if "MapInArrow" in line else line) for line in plan.splitlines() if re.search("MapInArrow|EvalPython", line)]


def batches(rows, size):
    table = pa.Table.from_pylist(rows)
    return iter(table.to_batches(max_chunksize=size))


def test_documents_come_back_in_few_batches():
    """A batch costs as much as a hundred rows: many small documents share one, one long section has its own."""
    body = "".join(f"<section identifier='/s{k}'><heading>h</heading></section>" for k in range(3))
    rows = [{"path": str(k), "content": doc(body).encode()} for k in range(1000)]
    found = list(S._parser(to_arrow_schema(T.StructType([S.SECTION[c] for c in ("path", "identifier", "markup")])))(batches(rows, 100)))
    assert [b.num_rows for b in found] == [2048, 1952] and found[0].schema.names == ["path", "identifier", "markup"]
    assert [r["path"] for b in found for r in b.to_pylist() if r["identifier"] == "/s2"] == [r["path"] for r in rows]
    long = [{"path": str(k), "content": doc(f"<section identifier='/s'>{'x' * (3 << 20)}</section>").encode()} for k in range(3)]
    assert len(list(S._parser(to_arrow_schema(S.SECTION))(batches(long, 1)))) == 3


def test_elements_are_counted_where_they_lie(spark):
    texts = [{"markup": "<section>a <b/> c<p/></section>"}] * 500 + [{"markup": "<section><b/>"}, {"markup": None}]
    found = [r for b in shape._count_elements(batches(texts, 300)) for r in b.to_pylist()]
    assert len(found) == 6 and sum(r["inline"] for r in found if r["name"] == "b") == 500
    # the markup alone goes from one stage to the next
    assert all("guid_refs" not in x for x in handed_over("inline_elements", spark))
    df = spark.createDataFrame([(t["markup"],) for t in texts], "markup string")
    assert {tuple(r) for r in shape.inline_elements(df).collect()} == {("b", 500, 0), ("p", 500, 0), ("section", 0, 500)}


def test_contents_read_only_what_they_show(spark):
    text = "<section><subsection identifier='/a'><num>(<b>a</b><i><b><u>deep</u></b></i>)</num><heading/><heading>second</heading><paragraph identifier='/a/1'><num>1</num></paragraph></subsection><level identifier='/a'><num>again</num></level><q:level identifier='/b'/><notes/></section>"
    assert markup.contents_of(text) == [{"anchor": "/a", "num": "(a)", "heading": None}, {"anchor": "notes", "num": "Notes", "heading": None}]
    assert markup.identifiers_in(text) == ["/a", "/a/1", "/b"] and markup.identifiers_in(text[:-1]) == []
    assert handed_over("section_contents", spark)[-1] == ["kind", "markup", "identifier"]


def test_sections_hand_over_what_is_read(spark):
    (columns,) = handed_over("snapshot_sections", spark)
    assert "notes" in columns and "guid_refs" not in columns and "ancestors" not in columns


def test_depths_are_counted_where_they_lie(spark):
    text = "<section><subsection><num>(a)<note>n</note></num></subsection><subsection><num>(b)</num></subsection></section>"
    rows = [{"id": f"/s{k}", "markup": text} for k in range(1000)]
    found = [r for b in shape._count_depths(batches(rows, 250)) for r in b.to_pylist()]
    assert found[0] == {"depth": 1, "n_sections": 250, "example": "/s0", "n_levels": 500, "n_footnotes": 250, "width": 3, "num": "(b)"} and len(found) == 4
    assert handed_over("section_depths", spark)[-1] == ["kind", "markup", "identifier"]


def test_metadata_comes_back_in_few_batches():
    rows = [{"path": str(k), "content": doc("", f"<meta><docNumber>{k}</docNumber></meta>").encode()} for k in range(5000)]
    found = list(S._parse_metadata(batches(rows, 100)))
    assert [b.num_rows for b in found] == [2048, 2048, 904] and [r["doc_number"] for b in found for r in b.to_pylist()] == [r["path"] for r in rows]


def test_notes_hand_over_what_is_read(spark):
    assert handed_over("snapshot_notes", spark) == [["path", "kind", "identifier", "seq", "notes"]]


def test_identifiers_hand_over_what_is_read(spark):
    assert handed_over("section_identifiers", spark)[-1] == ["kind", "markup", "identifier"]


def test_columns_are_right_whatever_else_is_read():
    body = "<section identifier='/s' id='g'><num value='1'>1</num><heading>h</heading><p id='q' identifier='/p'/><sourceCredit>c</sourceCredit><notes><note topic='t'><heading>n</heading></note></notes></section>"
    data = doc(f"<num>T</num><chapter identifier='/c'><heading>C</heading>{body}<quotedContent>{body}</quotedContent></chapter>").encode()
    whole = S.parse_document(data)
    for name in whole[0]:
        assert [r[name] for r in S._parse_utf8(data, frozenset([name]))] == [r[name] for r in whole]
    # notes need no identifiers of other elements, nor the text of the section itself
    (section,) = (r for r in S._parse_utf8(data, frozenset(["notes"])) if r["kind"] == "section")
    assert section["markup"] is None and section["num"] is None and section["guid_refs"] == [] and section["notes"][0]["heading"] == "n"
