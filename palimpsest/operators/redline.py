"""Differences between two versions: characters, words, lines with words inside them, and line multisets.

Alignment needs sequence algorithms that SQL lacks (``functions/align.py``), so these are Arrow-batched functions; a pair
is one row, pairs are independent, and equal texts never reach the aligner. Scripts are shortest ones, at any length:
a pair's memory grows with its texts, its time with length times edits. A null side is an empty text.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import align

_OP = T.StructType().add("op", "string").add("text", "string")
OPS = T.ArrayType(_OP)
LINES = T.ArrayType(T.StructType().add("op", "string").add("kind", "string").add("depth", "integer").add("spans", OPS))
#: Share of the longer line's characters that must stay for a removed and an added line to count as one changed line.
CHANGED_FROM = 0.4
_WORDS = re.compile(r"\s+|\S+")


def _merge(ops: list[dict]) -> list[dict]:
    """Neighbours of a kind joined; between equal stretches one deletion, then one insertion."""
    out: list[dict] = []
    held = {"delete": "", "insert": ""}

    def flush():
        for k in ("delete", "insert"):
            if held[k]:
                out.append({"op": k, "text": held[k]})
                held[k] = ""

    for x in ops:
        if x["op"] != "equal":
            held[x["op"]] += x["text"]
        elif x["text"]:
            flush()
            if out and out[-1]["op"] == "equal":
                out[-1] = {"op": "equal", "text": out[-1]["text"] + x["text"]}
            else:
                out.append(x)
    flush()
    return out


def _worded(script: list[align.Edit], a, b) -> list[dict]:
    return _merge([{"op": op, "text": "".join(b[k:m] if op == "insert" else a[i:j])} for op, i, j, k, m in script])


def character_ops(a: str, b: str) -> list[dict]:
    if a == b:
        return [{"op": "equal", "text": a}] if a else []
    codes = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (a, b))
    return _worded(align.at_boundaries(align.tidy(align.edit_script(*codes)), a, b), a, b)


def word_ops(a: str, b: str) -> list[dict]:
    x, y = _WORDS.findall(a), _WORDS.findall(b)
    return _worded(align.edit_script(*align.numbered(x, y)), x, y)


#: A line: kind, depth, text.
Line = tuple[str, int, str]


def line_ops(a: list[Line], b: list[Line]) -> list[dict]:
    """Lines as equal, delete, insert or changed. Lines are the same if kind, depth and text are; of a removed and an added
    stretch at one place the first lines are compared with each other, the second, and so on, and a changed line has
    word-level spans and the kind and depth that it has now."""
    out: list[dict] = []

    def put(op: str, line: Line, spans: list[dict] | None = None) -> None:
        out.append({"op": op, "kind": line[0], "depth": line[1], "spans": spans or [{"op": op, "text": line[2]}]})

    script = align.edit_script(*align.numbered(a, b))
    for p, (op, i, j, k, m) in enumerate(script):
        if op == "equal":
            for line in b[k:m]:
                put("equal", line)
        elif op == "delete":
            added = b[script[p + 1][3] : script[p + 1][4]] if script[p + 1 : p + 2] and script[p + 1][0] == "insert" else []
            for n, line in enumerate(a[i:j]):
                if n >= len(added):
                    put("delete", line)
                    continue
                spans = word_ops(line[2], added[n][2])
                stays = sum(len(s["text"]) for s in spans if s["op"] == "equal")
                if stays >= CHANGED_FROM * max(len(line[2]), len(added[n][2]), 1):
                    put("changed", added[n], spans)
                else:
                    put("delete", line)
                    put("insert", added[n])
        else:
            paired = script[p - 1][2] - script[p - 1][1] if p and script[p - 1][0] == "delete" else 0
            for line in b[k + min(paired, m - k) : m]:
                put("insert", line)
    return out


@F.pandas_udf(OPS)
def character_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([character_ops(x or "", y or "") for x, y in zip(a, b, strict=True)])


@F.pandas_udf(LINES)
def _aligned(a: pd.Series, b: pd.Series) -> pd.Series:
    def lines(side):
        return [] if side is None else [(x["kind"], x["depth"], x["text"]) for x in side]

    return pd.Series([line_ops(lines(x), lines(y)) for x, y in zip(a, b, strict=True)])


def block_diff(a: Column, b: Column) -> Column:
    """Array of (op, kind, depth, spans) from two arrays of (depth, kind, text), such as ``functions.blocks.reading_blocks``
    gives. Equal sides stay in the JVM."""
    none = F.array().cast(T.ArrayType(T.StructType().add("depth", "integer").add("kind", "string").add("text", "string")))
    a, b = F.coalesce(a, none), F.coalesce(b, none)
    span = lambda x: F.array(F.struct(F.lit("equal").alias("op"), x.text.alias("text")))
    same = F.transform(a, lambda x: F.struct(F.lit("equal").alias("op"), x.kind.alias("kind"), x.depth.alias("depth"), span(x).alias("spans")))
    return F.when(a == b, same.cast(LINES)).otherwise(_aligned(F.when(a != b, a), F.when(a != b, b)))


def document_diff(a: Column, b: Column) -> Column:
    """Array of (op, text) over the lines of two plain texts; a changed line's text marks words as [-old-] and {+new+}."""
    lines = lambda c: F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.struct(F.lit(1).alias("depth"), F.lit("text").alias("kind"), x.alias("text")))

    def marked(x: Column) -> Column:
        words = F.transform(x.spans, lambda s: F.when(s.op == "delete", F.concat(F.lit("[-"), s.text, F.lit("-]"))).when(s.op == "insert", F.concat(F.lit("{+"), s.text, F.lit("+}"))).otherwise(s.text))
        return F.when(x.op == "changed", F.concat_ws("", words)).otherwise(F.concat_ws("", x.spans.text))

    return F.transform(block_diff(lines(a), lines(b)), lambda x: F.struct(x.op.alias("op"), marked(x).alias("text")))


def source_redline(a: Column, b: Column) -> Column:
    """Struct (ops, inserted, deleted): the markup itself compared by characters, and how many were added and removed."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    whole = F.when(a == "", F.array().cast(OPS)).otherwise(F.array(F.struct(F.lit("equal").alias("op"), a.alias("text"))).cast(OPS))
    ops = F.when(a == b, whole).otherwise(character_diff(F.when(a != b, a), F.when(a != b, b)))
    n = lambda k: F.aggregate(F.filter(ops, lambda x: x.op == k), F.lit(0).cast("bigint"), lambda s, x: s + F.char_length(x.text))
    return F.struct(ops.alias("ops"), n("insert").alias("inserted"), n("delete").alias("deleted"))


def diff_counts(ops: Column) -> Column:
    """Struct (changed, inserted, deleted)."""
    n = lambda k: F.size(F.filter(ops, lambda x: x.op == k)).cast("bigint")
    return F.struct(n("changed").alias("changed"), n("insert").alias("inserted"), n("delete").alias("deleted"))


def diff_summary(ops: Column) -> Column:
    """``2 lines changed, 1 line added``, or ``No changes``."""
    c = diff_counts(ops)
    parts = [F.when(c[k] > 0, F.concat(c[k].cast("string"), F.when(c[k] == 1, " line ").otherwise(" lines "), F.lit(word))) for k, word in (("changed", "changed"), ("inserted", "added"), ("deleted", "removed"))]
    return F.coalesce(F.nullif(F.concat_ws(", ", *parts), F.lit("")), F.lit("No changes"))


def line_multiset_diff(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, line, n_old, n_new) of lines that do not stand equally often in both texts."""
    sides = [pairs.select(key, F.explode(F.split(c, "\n")).alias("line"), F.lit(k).alias("_s")) for k, c in enumerate((old, new))]
    out = sides[0].unionByName(sides[1]).groupBy(key, "line").agg(F.count_if(F.col("_s") == 0).alias("n_old"), F.count_if(F.col("_s") == 1).alias("n_new"))
    return out.filter("n_old != n_new")
