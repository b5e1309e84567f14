"""Written citations to identifiers and back, as column expressions.

A citation is cut into tokens once: numbers, subdivisions in parentheses, section signs, commas and words. Each
token has a kind of one letter, so a citation's form is a short string of kinds that is matched as a whole, and
its parts are the tokens of a kind in order. Paths are cut at their slashes instead. What fits no form is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.columns import let

#: Written level and the identifier's abbreviation.
LEVELS = {
    "chapter": "ch",
    "chap": "ch",
    "ch": "ch",
    "subchapter": "sch",
    "subchap": "sch",
    "subch": "sch",
    "part": "pt",
    "pt": "pt",
    "subpart": "spt",
    "subpt": "spt",
    "subtitle": "st",
    "subtit": "st",
}

#: Kinds of words. The code's name may be spelled in one word or in three.
_KINDS = {
    **{"usc": "K", "u": "u", "s": "s", "c": "c"},
    **dict.fromkeys(("section", "sections", "sec", "secs"), "S"),
    **dict.fromkeys(("app", "appx", "appendix"), "A"),
    **dict.fromkeys(LEVELS, "L"),
    **{"of": "o", "title": "T", "note": "N", "et": "e", "seq": "q"},
}
#: A title's number glued to the code's name, a number, a subdivision, signs, a word with its stop, or any other sign.
_TOKEN = r"[0-9]+[aA]?(?=[uU]\.?\s?[sS])|[0-9][0-9A-Za-z]*(?:[-–—][0-9A-Za-z]+)*|\([0-9A-Za-z]+\)|§+|[A-Za-z]+\.?|[^\s]"

_CODE, _APP, _END = "(?:K|usc)", "(?:,?A)?", ",?(?:N|eq)?"
#: Form, the kinds that it is made of, and the places of the title's and the section's number among the numbers.
_FORMS = (
    ("standard", f"^n{_CODE}{_APP}S*np*{_END}$", 0, 1),
    ("inverted", f"^S+np*oTn{_APP}{_END}$", 1, 0),
    ("title last", f"^S+np*,n{_CODE}{_APP}{_END}$", 1, 0),
    ("level", f"^T?n{_CODE}?{_APP},?L[nwusceq]$", 0, None),
    ("title", f"^(?:Tn{_CODE}?|n{_CODE}){_APP}$", 0, None),
)


def _normal(text: Column) -> Column:
    """One blank for white space, no parentheses around the whole, no stop at the end."""
    t = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    inner = F.substring(t, F.lit(2), F.length(t) - 2)
    # they belong together if no prefix of what they hold closes more than it opens
    steps = F.transform(F.filter(F.split(inner, ""), lambda c: c.isin("(", ")")), lambda c: F.when(c == "(", 1).otherwise(-1))
    state = F.aggregate(steps, F.struct(F.lit(0).alias("open"), F.lit(0).alias("least")), lambda a, x: F.struct((a.open + x).alias("open"), F.least(a.least, a.open + x).alias("least")))
    wrapped = t.startswith("(") & t.endswith(")") & (state.open == 0) & (state.least == 0) & inner.contains(" ")
    return F.regexp_replace(F.when(wrapped, F.trim(inner)).otherwise(t), r"(?<=[^a-zA-Z.])[.,;]+$|[,;]+$", "")


def parse_citation(text: Column) -> Column:
    """Struct (form, identifier, section_identifier, title, note, et_seq, appendix), or null."""
    return let(_normal(text), lambda t: F.coalesce(_path(t), let(F.regexp_extract_all(t, F.lit(_TOKEN), F.lit(0)), _written_form)))


def _found(form: Column, title: Column, appendix: Column, section: Column, below: Column, note: Column, et_seq: Column) -> Column:
    """The struct of a citation from its parts; ``section`` and ``below`` are rests of a path, empty or with a slash first."""
    number = F.regexp_replace(F.lower(title), "a$", "")
    whole_title = F.concat(number, F.when(appendix, "a").otherwise(""))
    holder = F.concat(F.lit("/us/usc/t"), whole_title, section)
    return F.struct(form.alias("form"), F.concat(holder, below).alias("identifier"), holder.alias("section_identifier"), whole_title.alias("title"), note.alias("note"), et_seq.alias("et_seq"), appendix.alias("appendix"))


def _slashes(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit("/"), p)), "")


def _path(t: Column) -> Column:
    """An identifier, with or without its beginning, or title/section/subdivisions."""

    def of(parts: Column) -> Column:
        first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        plain = F.forall(parts, lambda p: p.rlike("^[0-9A-Za-z–—-]+$"))
        no = F.lit(False)
        tagged = plain & first.rlike("^t[0-9]+a?$")
        bare = plain & (F.size(parts) >= 2) & first.rlike("^[0-9]+a?$") & second.rlike("^[0-9]")
        below = F.slice(parts, 3, 1000)
        rest = F.slice(parts, 2, 1000)
        is_section = second.rlike("^s[0-9]")
        title = F.regexp_replace(first, "^t", "")
        of_section = lambda s: _found(F.lit("path"), title, title.endswith("a"), s, _slashes(below), no, no)
        return (
            F.when(tagged & F.coalesce(is_section, no), of_section(F.concat(F.lit("/"), second)))
            .when(tagged, _found(F.lit("path"), title, title.endswith("a"), _slashes(rest), F.lit(""), no, no))
            .when(bare, _found(F.lit("slashed"), title, title.endswith("a"), F.concat(F.lit("/s"), second), _slashes(below), no, no))
        )

    cut = F.filter(F.split(F.regexp_replace(t, "^/?us/usc/", ""), "/"), lambda p: p != "")
    return F.when(t.contains("/") | t.rlike("^t[0-9]+a?$"), let(cut, of))


def _written_form(tokens: Column) -> Column:
    kinds = F.create_map(*(F.lit(x) for kv in _KINDS.items() for x in kv))

    def kind(x: Column) -> Column:
        named = F.coalesce(F.element_at(kinds, F.lower(F.regexp_replace(x, r"\.$", ""))), F.lit("w"))
        return F.when(x.rlike("^[0-9]"), "n").when(x.rlike("^[A-Za-z]"), named).when(x.startswith("§"), "S").when(x.startswith("(") & (F.length(x) > 2), "p").when(x.isin(",", ";"), ",").otherwise("x")

    def match(shape: Column) -> Column:
        numbers = F.filter(tokens, lambda x: x.rlike("^[0-9]"))
        below = _slashes(F.transform(F.filter(tokens, lambda x: x.startswith("(")), lambda x: F.regexp_replace(x, r"[()]", "")))
        level = F.element_at(F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv)), F.lower(F.regexp_replace(F.get(tokens, F.instr(shape, "L") - 1), r"\.$", "")))
        last = F.regexp_replace(F.element_at(tokens, -1), r"\.$", "")
        out = None
        for form, pattern, at_title, at_section in _FORMS:
            title = F.get(numbers, F.lit(at_title))
            if form == "level":
                section, rest = F.concat(F.lit("/"), level, last), F.lit("")
            elif form == "title":
                section, rest = F.lit(""), F.lit("")
            else:
                section, rest = F.concat(F.lit("/s"), F.get(numbers, F.lit(at_section))), below
            appendix = shape.contains("A") | F.lower(title).endswith("a")
            found = F.when(shape.rlike(pattern) & title.rlike("^[0-9]+[aA]?$"), _found(F.lit(form), title, appendix, section, rest, shape.contains("N"), shape.contains("eq")))
            out = found if out is None else F.coalesce(out, found)
        return out

    return let(F.array_join(F.transform(tokens, kind), ""), match)


def format_citation(identifier: Column) -> Column:
    """``/us/usc/t11/s523/a/1`` -> ``11 U.S.C. § 523(a)(1)``; levels are spelled out; unknown shapes stay as they are."""
    return let(identifier, _written)


def _written(identifier: Column) -> Column:
    section = r"^/us/usc/t(\d+)(a?)/s([^/]+)((?:/[^/]+)*)$"
    title = r"^/us/usc/t(\d+)(a?)$"
    get = lambda p, k: F.regexp_extract(identifier, p, k)
    app = lambda p: F.when(get(p, 2) == "a", " App.").otherwise("")
    sub = F.array_join(F.transform(F.filter(F.split(get(section, 4), "/"), lambda x: x != ""), lambda x: F.concat(F.lit("("), x, F.lit(")"))), "")
    out = F.when(identifier.rlike(title), F.concat(F.lit("Title "), get(title, 1), app(title)))
    for short, word in (("sch", "subchapter"), ("spt", "subpart"), ("st", "subtitle"), ("ch", "chapter"), ("pt", "part")):
        level = rf"^/us/usc/t(\d+)(a?)(?:/[^/]+)*/{short}([^/a-z][^/]*)$"
        out = out.when(identifier.rlike(level), F.concat(get(level, 1), F.lit(" U.S.C."), app(level), F.lit(f" {word} "), get(level, 3)))
    return out.when(identifier.rlike(section), F.concat(get(section, 1), F.lit(" U.S.C."), app(section), F.lit(" § "), get(section, 3), sub)).otherwise(identifier)
