"""The shape of markup: how deep levels nest below a section, how long their numbers are, and which elements stand in
running text.

One pass of an event parser over each text, in Arrow batches; tables over a corpus are aggregations of what it finds.
Markup that is not well formed has no shape (null).
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from palimpsest.functions.markup import INNER_LEVELS

#: Elements whose content is quoted, and footnotes that stand inside a number.
QUOTED, FOOTNOTES = ("quotedContent", "quotedText"), ("note", "footnote")

_MARKED = {*QUOTED, *FOOTNOTES, *INNER_LEVELS, "num"}

_ELEMENT = T.StructType().add("name", "string").add("inline", "long").add("isolated", "long")
_DEPTH = T.StructType().add("depth", "integer").add("n_sections", "long").add("example", "string").add("n_levels", "long").add("n_footnotes", "long").add("width", "long").add("num", "string")


def shape_of(markup: str | None) -> tuple[int, list[dict], list[dict]] | None:
    """Greatest depth of levels (0 without any), each level outside quoted content with its depth and number, and how
    often each element is inline, that is, has text that is not blank right before or after it, or else isolated.

    A number's text leaves out the footnotes in it.
    """
    parser, levels = expat.ParserCreate(), []
    parser.buffer_text = True
    inline: dict[str, int] = {}
    isolated: dict[str, int] = {}
    stack: list[list] = []  # of each open element its name, whether it is inline, its level, and what held before it
    gap, closed = False, None  # whether text stands since the last tag, and the element that this tag closed
    depth, quoted, number, muted = now = 0, False, None, False  # number: the level whose number is open, and its text

    def start(name, _attrs):
        nonlocal gap, closed, depth, quoted, number, muted, now
        tag = name.rpartition(":")[2]
        if closed:  # nothing more can be known of it
            kind = inline if gap or closed[1] else isolated
            kind[closed[0]] = kind.get(closed[0], 0) + 1
            closed = None
        node = [tag, gap, None, None]
        gap = False
        if tag in _MARKED:
            node[3] = now
            quoted = quoted or tag in QUOTED
            if tag in INNER_LEVELS and not quoted:
                depth += 1
                node[2] = {"depth": depth, "num": None, "footnote": False}
                levels.append(node[2])
            elif tag == "num" and stack and (level := stack[-1][2]) and level["num"] is None and not quoted:
                number = (level, [])
            elif tag in FOOTNOTES and number:
                number[0]["footnote"] = muted = True
            now = depth, quoted, number, muted
        stack.append(node)

    def text(data):
        nonlocal gap
        gap = gap or not data.isspace()
        if number and not muted:
            number[1].append(data)

    def end(_name):
        nonlocal gap, closed, depth, quoted, number, muted, now
        if closed:
            kind = inline if gap or closed[1] else isolated
            kind[closed[0]] = kind.get(closed[0], 0) + 1
        gap, closed = False, stack.pop()
        if closed[3]:
            if number is not closed[3][2]:
                number[0]["num"] = " ".join("".join(number[1]).split()) or None
            depth, quoted, number, muted = now = closed[3]

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    try:
        parser.Parse((markup or "").encode(), True)
    except expat.ExpatError:
        return None
    isolated[closed[0]] = isolated.get(closed[0], 0) + 1  # the outermost
    found = [{"name": k, "inline": inline.get(k, 0), "isolated": isolated.get(k, 0)} for k in sorted(inline.keys() | isolated.keys())]
    return max((x["depth"] for x in levels), default=0), levels, found


def _shapes(markup: pa.Array) -> Iterator[tuple[int, tuple[int, list[dict], list[dict]]]]:
    for i, m in enumerate(markup.to_pylist()):
        if found := shape_of(m):
            yield i, found


def _count_elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each element of a batch."""
    for batch in batches:
        sums: dict[str, list[int]] = {}
        for _, (_, _, elements) in _shapes(batch.column(0)):
            for e in elements:
                x = sums.setdefault(e["name"], [0, 0])
                x[0] += e["inline"]
                x[1] += e["isolated"]
        yield pa.RecordBatch.from_pylist([{"name": k, "inline": a, "isolated": b} for k, (a, b) in sums.items()], schema=to_arrow_schema(_ELEMENT))


def _count_depths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each depth of a batch."""
    for batch in batches:
        sums: dict[int, dict] = {}
        at = lambda depth: sums.setdefault(depth, dict.fromkeys(_DEPTH.names) | {"depth": depth, "n_sections": 0, "n_levels": 0, "n_footnotes": 0})  # noqa: E731, B023
        ids = batch.column(0).to_pylist()
        for i, (deepest, levels, _) in _shapes(batch.column(1)):
            x = at(deepest)
            x["n_sections"] += 1
            if ids[i] is not None and (x["example"] is None or ids[i] < x["example"]):
                x["example"] = ids[i]
            for level in levels:
                x = at(level["depth"])
                x["n_levels"] += 1
                x["n_footnotes"] += level["footnote"]
                if (num := level["num"]) is not None and (x["num"] is None or (len(num), num) > (x["width"], x["num"])):
                    x["width"], x["num"] = len(num), num
        yield pa.RecordBatch.from_pylist(list(sums.values()), schema=to_arrow_schema(_DEPTH))


def depth_ladder(sections: DataFrame, identifier: str = "identifier", markup: str = "markup") -> DataFrame:
    """One row for each depth: depth, n_sections whose deepest level it is, the least identifier of these (null: none),
    n_levels at it, how many have a footnote in their number, and the longest number (ties: the greater text).

    Each text is parsed once and counted where it lies, so what is handed back and shuffled is a row a depth and batch.
    The last row is the deepest section's.
    """
    each = sections.select(F.col(identifier).cast("string"), F.col(markup)).mapInArrow(_count_depths, _DEPTH)
    widest = F.max(F.when(F.col("num").isNotNull(), F.struct("width", "num")))
    return each.groupBy("depth").agg(F.sum("n_sections").alias("n_sections"), F.min("example").alias("example"), F.sum("n_levels").alias("n_levels"), F.sum("n_footnotes").alias("n_footnotes"), widest.alias("_w")).select(
        "depth", "n_sections", "example", "n_levels", "n_footnotes", F.col("_w.num").alias("widest_num")
    )


def inline_elements(texts: DataFrame, markup: str = "markup") -> DataFrame:
    """(name, inline, isolated): how often each element stands in running text, and how often not; counted where the texts lie."""
    rows = texts.select(markup).mapInArrow(_count_elements, _ELEMENT)
    return rows.groupBy("name").agg(F.sum("inline").alias("inline"), F.sum("isolated").alias("isolated"))
