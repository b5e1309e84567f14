"""Chat formatting by perspective rotation, in built-in functions only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and all
others as named users; a mask marks what a model is to learn, the assistant's own words. System turns keep
their role in every rendering and are never learnt.

A conversation is cut into parts by its turn numbers, and each part into pieces of equally many rows in its order, so
that one with millions of turns is many rows of bounded size; they carry their offset in the whole rendering.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm import scratch
from palimpsest.llm.columns import let


@dataclass(frozen=True)
class Settings:
    """Turn numbers of one part, rows of a piece (a part's last has what is left), the markup around a turn, and the
    role that is no participant."""

    part_turns: int = 128
    piece_rows: int = 2048
    head: str = "<|im_start|>"
    tail: str = "<|im_end|>\n"
    system: str = "system"


_TURN = "struct<turn:bigint,role:string,text:string>"


def _dealt(rows: DataFrame, s: Settings) -> DataFrame:
    """Distinct rows of parts as (conv_id, part, piece, turn, role, text, copies), by rank in the part's order.

    Only parts with more rows than a piece have rows beyond piece 0, and only theirs are ranked: sorted by ranges, so
    that no part lies in one task; a range's rows are numbered on their own, and what the ranges before hold is added.
    """
    keys = ["conv_id", "part"]
    once = rows.groupBy(*keys, "turn", "role", "text").agg(F.count("*").alias("copies"))
    large = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > s.piece_rows).select(*keys)
    large = scratch.materialise(large, "large_parts")
    zero = F.lit(0).cast("bigint").alias("piece")
    if large.isEmpty():
        return once.select(*keys, zero, "turn", "role", "text", "copies")
    small = once.join(large, keys, "left_anti").select(*keys, zero, "turn", "role", "text", "copies")
    order = [*keys, "turn", "role", "text"]
    # written, as another run of a range sort may cut elsewhere
    ranged = once.join(large, keys, "left_semi").repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    ranged = scratch.materialise(ranged, "ranges")
    before = W.partitionBy(*keys).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offset = ranged.groupBy(*keys, "range").agg(F.sum("copies").alias("n"))
    offset = offset.select(*keys, "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy(*keys, "range").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, -1)
    first = F.col("offset") + F.coalesce(F.sum("copies").over(inside), F.lit(0))
    placed = ranged.join(offset, [*keys, "range"]).withColumn("first", first).withColumn("end", F.col("first") + F.col("copies"))
    size = F.lit(s.piece_rows)
    # copies of one row may reach over several pieces
    placed = placed.withColumn("piece", F.explode(F.sequence(F.floor(F.col("first") / size), F.floor((F.col("end") - 1) / size))))
    copies = F.least("end", (F.col("piece") + 1) * size) - F.greatest("first", F.col("piece") * size)
    return small.unionByName(placed.select(*keys, F.col("piece").cast("bigint").alias("piece"), "turn", "role", "text", copies.alias("copies")))


def _pieces(rows: DataFrame, s: Settings) -> DataFrame:
    """(conv_id, part, piece, turns) with a piece's turns in order, copies repeated."""
    found = _dealt(rows, s).groupBy("conv_id", "part", "piece").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", F.col("copies").cast("int").alias("copies")))).alias("turns"))
    turns = F.flatten(F.transform("turns", lambda x: F.array_repeat(F.struct(x.turn.alias("turn"), x.role.alias("role"), x.text.alias("text")), x.copies)))
    return found.select("conv_id", "part", "piece", turns.cast(f"array<{_TURN}>").alias("turns"))


def _starts(parts: DataFrame, speakers: DataFrame, s: Settings) -> DataFrame:
    """(conv_id, speaker, part, piece, start): where each piece begins in each speaker's rendering, from lengths alone."""
    plain = len(s.head) + 1 + len(s.tail)
    size = lambda name, t: F.length(name) + plain + F.length(t.text)
    as_other = lambda t: size(F.when(t.role == s.system, F.lit(s.system)).otherwise(F.concat(F.lit("user name="), t.role)), t)
    total = F.aggregate("turns", F.lit(0).cast("bigint"), lambda n, t: n + as_other(t))
    keys = ["conv_id", "part", "piece"]
    narrow = scratch.materialise(parts.select(*keys, total.alias("total"), F.transform("turns", lambda t: t.role).alias("roles")), "piece_sizes")
    own = narrow.select(*keys, F.explode("roles").alias("speaker")).groupBy(*keys, "speaker").agg(F.count("*").alias("own"))
    both = narrow.select(*keys, "total").join(speakers, "conv_id").join(own, [*keys, "speaker"], "left")
    # a speaker's own turns are headed by assistant instead of the name
    less = F.coalesce("own", F.lit(0)) * (F.length(F.concat(F.lit("user name="), "speaker")) - len("assistant"))
    earlier = W.partitionBy("conv_id", "speaker").orderBy("part", "piece").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("total") - less).over(earlier), F.lit(0)).cast("bigint")
    return both.select("conv_id", "speaker", "part", "piece", start.alias("start"))


def rotate_perspectives(turns: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each conversation, participant, part and piece: conv_id, speaker, part, piece, start, n_turns, text, mask.

    ``turns`` has conv_id, turn, role and text. A turn reads ``<head>assistant\\n<text><tail>`` where the
    speaker is its author, ``<head>user name=<role>\\n<text><tail>`` elsewhere, and ``<head>system\\n...`` for
    system turns. ``mask`` holds (start, end) code points within the piece, over the speaker's words with the
    tail's marker; ``start`` is the piece's offset in the whole rendering. A part's row number r, from 0, is in piece
    ``r / piece_rows``, rounded down. There are as many renderings of a conversation as it has participants.

    Turns are ordered by number, ties by role and text, equal rows stay repeated; a null number sorts first.
    A null role is the participant ``unknown``, a null text is empty. Rows with a null conv_id are left out.
    A conversation of system turns only has no participant and no row. Other columns are ignored.
    """
    s = settings
    rows = turns.filter("conv_id is not null").select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.withColumn("part", F.floor(F.coalesce("turn", F.lit(-1)) / s.part_turns).cast("bigint"))
    speakers = rows.filter(F.col("role") != s.system).select("conv_id", F.col("role").alias("speaker")).distinct()
    parts = scratch.materialise(_pieces(rows, s), "pieces")
    starts = _starts(parts, speakers, s)

    def lead(t: Column, speaker: Column) -> Column:
        name = F.when(t.role == s.system, F.lit(s.system)).when(t.role == speaker, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), t.role))
        return F.concat(F.lit(s.head), name, F.lit("\n"))

    def render(turns_: Column, speaker: Column) -> Column:
        said = F.transform(turns_, lambda t: F.struct(lead(t, speaker).alias("lead"), t.text.alias("text"), ((t.role == speaker) & (t.role != s.system)).alias("own")))

        def marks(pieces: Column) -> Column:
            none = F.array().cast("array<struct<start:bigint,end:bigint>>")
            end_mark = F.lit(len(s.tail.rstrip("\n")))
            zero = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("mask"))

            def add(st: Column, x: Column) -> Column:
                begin = st.at + F.length(x.lead)
                end = begin + F.length(x.text)
                more = F.when(x.own, F.array(F.struct(begin.alias("start"), (end + end_mark).alias("end")))).otherwise(none)
                return F.struct((end + len(s.tail)).alias("at"), F.concat(st.mask, more).alias("mask"))

            text = F.array_join(F.transform(pieces, lambda x: F.concat(x.lead, x.text, F.lit(s.tail))), "")
            return F.struct(text.alias("text"), F.aggregate(pieces, zero, add).alias("done"))

        return let(said, marks)

    both = parts.join(starts, ["conv_id", "part", "piece"]).withColumn("r", render(F.col("turns"), F.col("speaker")))
    n = F.size("turns").cast("bigint").alias("n_turns")
    return both.select("conv_id", "speaker", "part", "piece", "start", n, F.col("r.text").alias("text"), F.col("r.done.mask").alias("mask"))
