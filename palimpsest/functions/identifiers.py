"""Columns over labels, title numbers, identifiers, references, dates and content keys.

All are built-in expressions. Where an input does not fit, the result is null unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LABEL = r"^(\d+)-(\d+)((?:not\d+)*)(?:u(\d+))?$"
_SPACE = r"(?U)\s+"
_ID_ATTRIBUTE = r"""\sid=("[^"]*"|'[^']*')"""
FAR = 10**9


def _part(x: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


def parse_label(label: Column) -> Column:
    """``113-100not89u1`` as struct (congress, law, excluded, update); null if it is no label."""
    excluded = F.transform(F.regexp_extract_all(F.regexp_extract(label, _LABEL, 3), F.lit(r"not(\d+)")), lambda x: x.cast("int"))
    fields = F.struct(
        _part(label, _LABEL, 1).cast("int").alias("congress"), _part(label, _LABEL, 2).cast("int").alias("law"), excluded.alias("excluded"), _part(label, _LABEL, 4).cast("int").alias("update")
    )
    return F.when(label.rlike(_LABEL), fields)


def format_label(parts: Column) -> Column:
    """Inverse of ``parse_label``."""
    excluded = F.array_join(F.transform(parts.excluded, lambda x: F.concat(F.lit("not"), x.cast("string"))), "")
    return F.concat(parts.congress.cast("string"), F.lit("-"), parts.law.cast("string"), excluded, F.coalesce(F.concat(F.lit("u"), parts["update"].cast("string")), F.lit("")))


def file_title(title: Column, strict: bool = True) -> Column:
    """File spelling of a title number: ``5a`` -> ``05a``. Not a number: null, or unchanged if not ``strict``."""
    low = F.lower(F.trim(title))
    padded = F.when(low.rlike(r"^\d{1,2}a?$"), F.concat(F.lpad(F.regexp_extract(low, r"^0*(\d+)", 1), 2, "0"), F.regexp_extract(low, "(a?)$", 1)))
    return padded if strict else F.coalesce(padded, title)


def url_title(title: Column) -> Column:
    """URL spelling of a title number: no leading zeros."""
    return F.regexp_replace(title, r"^0+(?=\d)", "")


def query_title(title: Column) -> Column:
    """A title as typed in a query: ``T5a`` -> ``5a``."""
    return F.regexp_replace(F.lower(F.trim(title)), r"^t(?=\d)", "")


def title_of(identifier: Column) -> Column:
    return _part(identifier, r"^/us/usc/t(\d+[a-z]?)(?:/|$)")


def chapter_of(identifier: Column) -> Column:
    return _part(identifier, r"/ch([^/]+)")


def normal_identifier(path: Column) -> Column:
    """One leading slash, none behind."""
    return F.concat(F.lit("/"), F.regexp_replace(F.trim(path), "^/+|/+$", ""))


def title_order(title: Column) -> Column:
    """Sort key of titles: number, then suffix; what is no title comes last."""
    shape = r"^(\d+)([A-Za-z]*)$"
    number = F.coalesce(_part(title, shape, 1).cast("bigint"), F.lit(FAR))
    return F.struct(number.alias("number"), F.lower(F.regexp_extract(title, shape, 2)).alias("suffix"))


def code_order_key(title: Column, seq: Column) -> Column:
    """String that sorts in the order of the code: four digits, suffix or 0, bar, six digits of the place."""
    shape = r"^(\d+)([A-Za-z]*)$"
    suffix = F.coalesce(F.nullif(F.lower(F.regexp_extract(title, shape, 2)), F.lit("")), F.lit("0"))
    number = F.coalesce(_part(title, shape, 1).cast("int"), F.lit(9999))
    return F.concat(F.lpad(number.cast("string"), 4, "0"), suffix, F.lit("|"), F.lpad(F.coalesce(seq, F.lit(0)).cast("string"), 6, "0"))


def squeeze(text: Column) -> Column:
    """White space of any script collapsed and trimmed; null when nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(text, _SPACE, " ")), F.lit(""))


def strip_tags(markup: Column, gap: str = " ") -> Column:
    """Text without tags; entities stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(markup, "<[^>]+>", gap), r"\s+", " "))


def trim_number(num: Column) -> Column:
    """One final full stop dropped."""
    return F.regexp_replace(num, r"\.$", "")


def provision_label(path: Column) -> Column:
    """``/c/5`` -> ``(c)(5)``."""
    return F.array_join(F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("("), x, F.lit(")"))), "")


def link_targets(markup: Column, tag: str = "a") -> Column:
    """Every href of a tag in document order, as written."""
    return F.regexp_extract_all(markup, F.lit(rf'<{tag}\s[^>]*?href="([^"]*)"'), F.lit(1))


def cited_identifiers(hrefs: Column, prefix: str = "/us/usc/") -> Column:
    """Distinct identifiers among references in first-seen order, without query and fragment."""
    return F.array_distinct(F.transform(F.filter(hrefs, lambda x: x.startswith(prefix)), lambda x: F.regexp_replace(x, "[?#].*$", "")))


def resolve_reference(href: Column) -> Column:
    """Struct (kind, target): code, statute, law (from the 104th congress on) or none."""
    law = r"^/us/pl/(\d+)/(\d+)"
    statute = r"^/us/stat/(\d+)/(\d+)"
    kind = (
        F.when(href.rlike("^/us/usc/t"), "code")
        .when(href.rlike(statute), "statute")
        .when(href.rlike(law) & (F.coalesce(_part(href, law).cast("int"), F.lit(0)) >= 104), "law")
        .otherwise("none")
    )
    return F.struct(kind.alias("kind"), F.when(kind != "none", F.regexp_replace(href, "[?#].*$", "")).alias("target"))


def content_key(markup: Column) -> Column:
    """Markup with every ``id`` attribute removed, and only that: ``xml:id`` and ``temporalId`` stay."""
    return F.regexp_replace(markup, _ID_ATTRIBUTE, "")


def content_hash(markup: Column) -> Column:
    return F.sha2(content_key(markup), 256)


def source_delta(a: Column, b: Column) -> Column:
    """identical, ids-only or beyond-ids."""
    return F.when(a.eqNullSafe(b), "identical").when(content_key(a) == content_key(b), "ids-only").otherwise("beyond-ids")


def dash_variants(number: Column) -> Column:
    """The number as typed, then with every dash written as hyphen, en dash and em dash."""
    dashes = "-–—"
    return F.array_distinct(F.array(number, *(F.translate(number, dashes, d * 3) for d in dashes)))


def prefixes(identifier: Column, least: int = 4) -> Column:
    """All path prefixes of an identifier, longest first, of at least ``least`` parts (the empty one before the first slash counts)."""
    parts = F.split(identifier, "/")
    n = F.size(parts)
    return F.when(n >= least, F.transform(F.sequence(n, F.lit(least), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))


def fuzzify(query: Column) -> Column:
    """``~1`` on every word that has no operator in it."""
    words = F.filter(F.split(query, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(w.rlike(r"^[\p{L}\p{N}_]+$"), F.concat(w, F.lit("~1"))).otherwise(w)), " ")


def cites_argument(query: Column) -> Column:
    """What follows ``cites``, else null."""
    return _part(query, r"(?i)^\s*cites\s+(.+?)\s*$")


def escape_markup(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def highlight_markup(fragment: Column) -> Column:
    """Everything escaped but the highlighter's own em tags."""
    out = escape_markup(fragment)
    return F.replace(F.replace(out, F.lit("&lt;em&gt;"), F.lit("<em>")), F.lit("&lt;/em&gt;"), F.lit("</em>"))


def parse_date(text: Column) -> Column:
    """``7/12/2026`` or ``2026-07-12``; null otherwise."""
    t = F.trim(text)
    return F.coalesce(F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(t, "M/d/yyyy")), F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd")))


def date_in_prose(text: Column) -> Column:
    """The first numeric date, or the first one with a month's name if there is none."""
    months = "January|February|March|April|May|June|July|August|September|October|November|December"
    named = F.regexp_replace(F.regexp_extract(text, rf"((?:{months})\s+\d{{1,2}},\s*\d{{4}})", 1), r"\s+", " ")
    return F.coalesce(parse_date(F.regexp_extract(text, r"(\d{1,2}/\d{1,2}/\d{4})", 1)), F.try_to_date(named, "MMMM d, yyyy"))


def is_stale(ok: Column, checked_at: Column, now: Column, days: int = 7) -> Column:
    """A failed check is stale at once, a good one after ``days``."""
    return ~ok | (checked_at < now - F.expr(f"INTERVAL {days} DAYS"))


def hours_since(checked_at: Column, now: Column) -> Column:
    return F.round((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(checked_at.cast("timestamp"))) / 3600, 2)


def titles_in_prose(text: Column) -> Column:
    """File spellings of the titles named after ``affecting title(s)``, up to the full stop, distinct, in order."""
    listed = F.regexp_extract(text, r"(?i)affecting\s+titles?\s+([^.]*)", 1)
    return F.array_distinct(F.filter(F.transform(F.split(listed, r"\s*(?:,|\band\b)\s*"), lambda x: file_title(x)), lambda x: x.isNotNull()))
