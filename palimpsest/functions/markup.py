"""What lies below a section: provisions cut from its markup, its contents, and the identifiers in it.

Functions over Arrow batches; markup that is not well formed gives empty results instead of failing the job.
"""

from __future__ import annotations

import re
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Element names of the levels inside a section.
INNER_LEVELS = ("subsection", "paragraph", "subparagraph", "clause", "subclause", "item", "subitem", "subsubitem", "level")
_PROVISION = T.StructType().add("found", "boolean").add("xml", "string")
_ENTRIES = T.ArrayType(T.StructType().add("anchor", "string").add("num", "string").add("heading", "string"))

_TAG = re.compile(rb"""<(?:[^>"']|"[^"]*"|'[^']*')*>""")


def whole_tag(data: bytes, begin: int) -> int:
    """Where the tag that begins at ``begin`` ends."""
    return _TAG.match(data, begin).end()


def cut_provision(markup: str | None, identifier: str | None) -> tuple[bool, str | None]:
    """The source's own text of the first element with an identifier; declarations of name spaces that it inherits are added."""
    data = (markup or "").encode()
    parser, stack, found = expat.ParserCreate(), [], {}

    def start(tag, attrs):
        up = stack[-1] if stack else {}
        spaces = up | {k: v for k, v in attrs.items() if k == "xmlns" or k.startswith("xmlns:")}
        stack.append(spaces)
        if not found and identifier is not None and attrs.get("identifier") == identifier:
            found.update(begin=parser.CurrentByteIndex, depth=len(stack), tag=tag, more={k: v for k, v in up.items() if k not in attrs})

    def end(_tag):
        if found.get("depth") == len(stack) and "end" not in found:
            opened = whole_tag(data, found["begin"])  # an empty element ends there, and has no end tag to look for
            found["end"] = opened if data[opened - 2 : opened] == b"/>" else data.index(b">", parser.CurrentByteIndex) + 1
        stack.pop()

    parser.StartElementHandler, parser.EndElementHandler = start, end
    try:
        parser.Parse(data, True)
    except expat.ExpatError:
        return False, None
    if "end" not in found:
        return False, None
    text = data[found["begin"] : found["end"]].decode()
    lead = f"<{found['tag']}"
    return True, lead + "".join(f' {k}="{v}"' for k, v in found["more"].items()) + text[len(lead) :]


@F.pandas_udf(_PROVISION)
def provision(markup: pd.Series, identifier: pd.Series) -> pd.DataFrame:
    """Struct (found, xml) of the provision with an identifier inside a section's markup."""
    return pd.DataFrame([cut_provision(m, i) for m, i in zip(markup, identifier, strict=True)], columns=["found", "xml"])


def identifiers_in(markup: str | None) -> list[str]:
    """Identifiers of the levels inside a section, each where it stands first."""
    parser, found = expat.ParserCreate(), {}

    def start(tag, attrs):
        if attrs and (own := attrs.get("identifier")) and tag.rpartition(":")[2] in INNER_LEVELS:
            found[own] = None

    parser.StartElementHandler = start
    try:
        parser.Parse((markup or "").encode(), True)
    except expat.ExpatError:
        return []
    return list(found)


@F.arrow_udf(T.ArrayType(T.StringType()))
def level_identifiers(markup: pa.Array) -> pa.Array:
    """:func:`identifiers_in` of each text."""
    return pa.array([identifiers_in(m) for m in markup.to_pylist()], pa.list_(pa.string()))


def contents_of(markup: str | None) -> list[dict]:
    """The provisions right below a section that have a number, then its source credit and notes.

    Numbers and headings are read where they stand right below a provision, with elements in them up to two deep.
    """
    parser, entries, ends = expat.ParserCreate(), {}, set()
    parser.buffer_text = True
    depth, entry, name, said = 0, None, None, []  # the provision that is open, and which of its texts

    def start(tag, attrs):
        nonlocal depth, entry, name
        if depth == 1:
            tag, own = tag.rpartition(":")[2], attrs.get("identifier")
            if tag in ("sourceCredit", "notes"):
                ends.add(tag)
            elif own and tag in INNER_LEVELS and own not in entries:
                entry = entries[own] = {"anchor": own, "num": None, "heading": None}
        elif depth == 2 and entry and (tag := tag.rpartition(":")[2]) in ("num", "heading") and entry[tag] is None:
            name = tag
            said.clear()
            parser.CharacterDataHandler = text
        depth += 1

    def text(data):
        if depth < 6:
            said.append(data)

    def end(_tag):
        nonlocal depth, entry, name
        depth -= 1
        if depth == 2 and name:
            parser.CharacterDataHandler = None
            entry[name], name = " ".join("".join(said).split()), None
        elif depth == 1:
            entry = None

    parser.StartElementHandler, parser.EndElementHandler = start, end
    try:
        parser.Parse((markup or "").encode(), True)
    except expat.ExpatError:
        return []
    out = [e | {"heading": e["heading"] or None} for e in entries.values() if e["num"]]
    names = (("sourceCredit", "source", "Source credit"), ("notes", "notes", "Notes"))
    return out + [{"anchor": anchor, "num": num, "heading": None} for tag, anchor, num in names if tag in ends]


@F.arrow_udf(_ENTRIES)
def contents(markup: pa.Array) -> pa.Array:
    """Array of (anchor, num, heading): a section's own table of contents."""
    return pa.array([contents_of(m) for m in markup.to_pylist()], to_arrow_type(_ENTRIES))


def provision_below(markup: Column, identifier: Column, wanted: Column) -> Column:
    """``provision`` where something below the section is wanted, else null, without handing the markup to Python."""
    return F.when(wanted, provision(F.when(wanted, markup), F.when(wanted, identifier)))
