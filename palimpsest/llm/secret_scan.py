"""Secret scan: three base patterns and sliding-window Shannon entropy, in built-in functions only.

Java regular expressions have no positions in Spark SQL, so every pattern is matched as ``(.*?)(pattern)``:
the lengths of the skipped text and of the matches add up to code-point offsets. Only texts in which a
pattern occurs at all pay for that. Entropy slides over candidate strings with counts that are updated for
the character that enters and the one that leaves: a step touches a few packed longs, whatever the width.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.columns import let

_NAME = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?"""
_VALUE = "[A-Za-z0-9+/_.=-]+"
ASSIGN = _NAME + _VALUE
ACCESS = r"AKIA[A-Z0-9]{14,}"
#: Longest runs, so the least length can stand in the pattern.
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{%d,}={0,2}"

#: Character classes with the entropy in bits that a full window, and one of a candidate shorter than that, must
#: reach: about the first percentile of random strings of 20 and of 16 characters. The first class that all of a
#: candidate belongs to counts.
CLASSES = (("hex", "^[0-9a-fA-F]+$", 2.90, 2.67), ("upper", "^[A-Z0-9]+$", 3.40, 3.14), ("alnum", "^[A-Za-z0-9]+$", 3.64, 3.32), ("base64", "^[A-Za-z0-9+/_=-]+$", 3.64, 3.32))
#: Values that look random but are public: digests of nothing, filler, identifiers of documents, words and numbers in a chain.
ALLOW = (
    r"^(?i:[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12})$",
    r"^(?i:d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709)$",
    r"^(?i:(?:(?:example|placeholder|changeme|x{4,}|your|my|key|secret|token|password|api)[-_/=]*)+[0-9]{0,4}=*)$",
    r"^wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY$",
    r"^[A-Za-z]+$",
    r"^[0-9]+$",
    r"^[-_/]*(?:[A-Za-z]?[a-z]{0,15}|[0-9]{1,8})(?:[-_/]+(?:[A-Za-z]?[a-z]{0,15}|[0-9]{1,8}))+$",
)


@dataclass(frozen=True)
class Settings:
    """Width of the window, shortest candidate (its window is as wide if the candidate has no full one), classes
    with thresholds, and allow-list."""

    window: int = 20
    shortest: int = 16
    classes: tuple = CLASSES
    allow: tuple = field(default=ALLOW)


_SPAN = "struct<start:bigint,kind:int,end:bigint,hit:string>"
_BLOCK = 256


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """Array of (start, kind, end, hit) of all leftmost non-overlapping matches of ``pattern``."""
    # the end of the text ends the last gap, else the search would start anew at each of its characters
    gaps, hits = (F.regexp_extract_all(text, F.lit(f"(?s)(.*?)({pattern}|\\z)"), F.lit(k)) for k in (1, 2))
    steps = F.filter(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), lambda x: x.hit != "")
    none = F.array().cast(f"array<{_SPAN}>")

    def add(state: Column, x: Column) -> Column:
        start = state.at + F.length(x.gap)
        end = start + F.length(x.hit)
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x.hit.alias("hit"))
        return F.struct(end.alias("at"), F.concat(state.out, F.array(span)).alias("out"))

    # lists grow block by block: adding to one long list would copy it once a match
    def block(state: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(state.at.alias("at"), none.alias("out")), add)
        return F.struct(done.at.alias("at"), F.concat(state.out, done.out).alias("out"))

    first = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))

    def walk(steps: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(steps) / _BLOCK).cast("int")), lambda k: F.slice(steps, k * _BLOCK + 1, _BLOCK))
        return F.aggregate(blocks, first, block, lambda s: s.out)

    return F.when(text.rlike(pattern), let(steps, walk)).otherwise(none)


def _xlog(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n)).otherwise(0.0)


def _peak(s: Column, width: int) -> Column:
    """Highest Shannon entropy (bits a character) of any window, by counts kept as the window moves.

    The state holds the count of each printable ASCII character, several to a long, and the sum of n*log2(n).
    """
    bits = width.bit_length()
    each, most = 63 // bits, (1 << bits) - 1
    longs = -(-96 // each)
    zero = F.struct(F.array_repeat(F.lit(0).cast("bigint"), longs).alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("peak"))

    def place(c: Column) -> Column:
        return F.struct(c.alias("code"), (c / each).cast("int").alias("at"), (c % each * bits).alias("shift"))

    def count(n: Column, x: Column) -> Column:
        return F.call_function("shiftrightunsigned", F.element_at(n, x["at"] + 1), x["shift"]).bitwiseAND(F.lit(most).cast("bigint"))

    def one(x: Column, i: Column) -> Column:
        return F.when(x["at"] == i, F.call_function("shiftleft", F.lit(1).cast("bigint"), x["shift"])).otherwise(0)

    def move(state: Column, x: Column) -> Column:
        into, outof = x["into"], x["outof"]
        counts = F.transform(state.n, lambda v, i: v + one(into, i) - one(outof, i))
        n_in, n_out = count(state.n, into), count(state.n, outof)
        leave = F.when(outof.isNotNull(), _xlog(n_out - 1) - _xlog(n_out)).otherwise(0.0)
        total = state["sum"] + F.when(F.equal_null(into.code, outof.code), 0.0).otherwise(_xlog(n_in + 1) - _xlog(n_in) + leave)
        here = F.when(x.full, F.log2(F.lit(float(width))) - total / width).otherwise(0.0)
        return F.struct(counts.alias("n"), total.alias("sum"), F.greatest(state.peak, here).alias("peak"))

    def steps(chars: Column) -> Column:
        return F.transform(chars, lambda c, i: F.struct(c.alias("into"), F.get(chars, i - width).alias("outof"), (i >= width - 1).alias("full")))

    return F.aggregate(let(F.transform(F.split(s, ""), lambda c: place(F.ascii(c) - 32)), steps), zero, move, lambda st: st.peak)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Per row: doc_id, base and entropy spans as arrays of (start, kind, end, hit).

    Base kinds: 0 assign, 1 access, 2 hex, each leftmost and non-overlapping within its kind. ``entropy``
    holds candidate strings, kind 3, of ``shortest`` characters or more in which some window reaches the
    entropy of the candidate's class and that no allow-list pattern matches; a string inside a base span
    is not repeated. Offsets are code points, ends exclusive. Null and empty texts have no spans; repeated
    rows are scanned each for itself; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    candidate = CANDIDATE % settings.shortest

    def random(x: Column) -> Column:
        full = F.length(x.hit) >= settings.window
        bits = F.lit(99.0)
        for _, pattern, least, least_short in reversed(settings.classes):
            bits = F.when(x.hit.rlike(pattern), F.when(full, F.lit(least)).otherwise(F.lit(least_short))).otherwise(bits)
        return F.when(full, _peak(x.hit, settings.window)).otherwise(_peak(x.hit, settings.shortest)) >= bits

    def allowed(x: Column) -> Column:
        return F.coalesce(*(F.when(x.hit.rlike(p), True) for p in settings.allow), F.lit(False))

    def inside(x: Column, base: Column) -> Column:
        return F.exists(base, lambda b: (b.start <= x.start) & (b.end >= x.end))

    def scan(t: Column) -> Column:
        assign = F.filter(_spans(t, ASSIGN, 0), lambda x: F.length(F.regexp_extract(x.hit, f"^{_NAME}({_VALUE})$", 1)) >= 12)
        base = F.array_sort(F.concat(assign, _spans(t, ACCESS, 1), _spans(t, HEX, 2)))
        return let(base, lambda b: F.struct(b.alias("base"), F.filter(_spans(t, candidate, 3), lambda x: ~inside(x, b) & ~allowed(x) & random(x)).alias("entropy")))

    rows = docs.select(F.col(id_col).alias("doc_id"), let(text, scan).alias("s"))
    return rows.select("doc_id", F.col("s.base").alias("base"), F.col("s.entropy").alias("entropy"))


KINDS = ("assign", "access", "hex", "entropy")


def spell(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined in the array's order."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x.kind + 1), x.start, x.end)), ",")
