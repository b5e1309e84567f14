"""The lines that a reader reads in a section's markup.

A level, note, quotation, paragraph or table row begins a line; what else stands in it flows into the line, numbers and
headings parted by a blank, inline marks not. Two passes over the parser's events: the first finds which notes
and quotations stand inside a sentence (text right beside them), the second writes lines. Neither builds a tree,
so depth and length are bounded by the text alone. Markup that is null or not well formed has no lines.
"""

from __future__ import annotations

import re
from xml.parsers import expat

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Element names of the format by what they do to a line.
LEVELS = frozenset(
    "title subtitle chapter subchapter part subpart division subdivision article subarticle section subsection paragraph subparagraph clause subclause item subitem level".split()
)
BREAKS = LEVELS | {"p", "notes", "note", "sourceCredit", "quotedContent", "quotedText", "table", "tr", "toc"}
NOTES = frozenset({"notes", "note", "sourceCredit"})
INLINE = frozenset({"i", "b", "sub", "sup", "span", "inline", "a", "date", "footnote", "ref"})
EITHER = frozenset({"note", "quotedContent"})
SKIPPED = frozenset({"meta", "toc", "tocItem", "docNumber", "docPublicationName", "property"})

BLOCKS = T.ArrayType(T.StructType().add("depth", "integer").add("kind", "string").add("text", "string"))


def _local(tag: str) -> str:
    return tag.rpartition(":")[2]


def prose_elements(data: bytes) -> set[int]:
    """Which elements (counted from 0 by their start) are a note or quotation with text that is not blank right beside them."""
    parser, out, count = expat.ParserCreate(), set(), -1
    # per open element: its number if it can be either, whether text stands since its last child, that child's number
    stack: list[list] = [[None, False, None]]

    def cut(*_):
        stack[-1][1:] = [False, None]

    def start(tag, _attrs):
        nonlocal count
        count += 1
        mine = count if _local(tag) in EITHER else None
        if mine is not None and stack[-1][1]:
            out.add(mine)
        cut()
        stack.append([mine, False, None])

    def end(_tag):
        mine = stack.pop()[0]
        stack[-1][1:] = [False, mine]

    def text(piece):
        if piece.strip():
            stack[-1][1] = True
            if stack[-1][2] is not None:
                out.add(stack[-1][2])

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    parser.CommentHandler = parser.ProcessingInstructionHandler = cut
    parser.Parse(data, True)
    return out


def reading_lines(markup: str | None) -> list[dict]:
    """Lines (depth, kind, text) in reading order: depth counts levels from 1, kind is ``text`` or ``note``."""
    data = (markup or "").encode()
    try:
        prose = prose_elements(data)
    except expat.ExpatError:
        return []
    parser, out, line, count = expat.ParserCreate(), [], [], -1
    stack: list[tuple[str, int, str]] = []  # per open element: "lines", "flow" or "skip", and depth and kind of its lines
    apart = False  # the next text belongs to a part that is set off by a blank

    def flush():
        text = re.sub(r"\s+", " ", "".join(line)).strip()
        line.clear()
        if text:
            out.append({"depth": stack[-1][1], "kind": stack[-1][2], "text": text})

    def start(tag, _attrs):
        nonlocal count, apart
        count += 1
        if not stack:
            stack.append(("lines", 1, "text"))
            return
        tag, (mode, depth, kind) = _local(tag), stack[-1]
        if mode == "skip" or tag in SKIPPED:
            stack.append(("skip", depth, kind))
        elif mode == "flow" or count in prose or tag in INLINE:
            stack.append(("flow", depth, kind))
        elif tag in BREAKS:
            flush()
            stack.append(("lines", depth + (tag in LEVELS), "note" if tag in NOTES else kind))
        else:
            apart = True
            stack.append(("flow", depth, kind))

    def end(_tag):
        nonlocal apart
        if stack[-1][0] == "lines":
            flush()
        stack.pop()
        if stack and stack[-1][0] == "lines":
            apart = False

    def text(piece):
        nonlocal apart
        if stack[-1][0] == "skip":
            return
        if apart and line and not line[-1][-1].isspace() and not piece[0].isspace():
            line.append(" ")
        apart = False
        line.append(piece)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    parser.Parse(data, True)
    return out


@F.pandas_udf(BLOCKS)
def reading_blocks(markup: pd.Series) -> pd.Series:
    """Array of (depth, kind, text): the lines of a section's markup."""
    return pd.Series([reading_lines(m) for m in markup])
