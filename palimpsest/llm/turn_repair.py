"""Repair of conversations' turn structure by a native fold over sorted turn structs.

Turns are flagged by windows (blank, duplicate, truncated) and edited at least cost until the roles' initials read
``(s?(ua)+)?``. A conversation is a walk through four states (nothing said yet, after a system turn, after a user
turn, after an assistant turn); the fold carries one (cost, audit) struct a state and takes native ``least`` over
the edits that lead there.

A conversation may hold a large part of all rows, so it is folded in pieces: rows are range-partitioned in reading
order and numbered, a piece is what a conversation has of 1,024 numbers, and its fold gives the cheapest edits
from each of the four states to each. Pieces are joined by the same ``least`` over the state between them, 64 to
one until each conversation is one. A joined audit keeps marks where pieces begin, so that every piece's edits are
applied apart. Only narrow rows are folded; texts stay in the written table.

Rows of one turn number are read by role, then by the SHA-256 of their text. Of equal rows (conversation, turn,
role, text) all after the first are blank or duplicates; they are counted before anything is shuffled by
conversation. An empty role counts as a space and so can't be kept. Null roles and texts are one space; a null
conversation id is a conversation, null turn numbers come first. Other columns are ignored. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm import scratch
from palimpsest.llm.columns import let
from palimpsest.llm.memory import trimmed


@dataclass(frozen=True)
class Settings:
    """Costs of the edits and of a truncated turn that stays; bits of the row number inside a piece; pieces
    joined at once."""

    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3
    piece_bits: int = 10
    fan_in: int = 64


@dataclass(frozen=True)
class Repaired:
    """``summary``: a row a conversation (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit);
    ``turns``: the repaired turns (conv_id, piece, pos, edit, role, text), in order of piece and pos."""

    summary: DataFrame
    turns: DataFrame


BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
_NEVER = 1 << 50  # the cost of what can't be reached; a least cost is far below
_MARK = "|"
_LEGAL = ("su", "ua", "au")


def _turns(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies, numbered in reading order of all conversations."""
    space = F.lit(" ")
    rows = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    order = ["conv_id", "turn", "role", "digest"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())


def _flagged(turns: DataFrame, bits: int) -> DataFrame:
    """Narrow rows with their first fault. A turn said twice in a piece is found there; what is first in its piece
    is looked for in earlier pieces, at most one row a piece."""
    piece = F.shiftright("seq", bits)
    rows = turns.select(
        "conv_id", "seq", piece.alias("piece"), "turn", "role", "digest", "copies",
        F.when(F.col("role") == "", " ").otherwise(F.left("role", F.lit(1))).alias("initial"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"),
    )
    inside = W.partitionBy("conv_id", "piece", "role", "digest").orderBy("seq")
    rows = rows.withColumn("again", F.row_number().over(inside) > 1)
    across = W.partitionBy("conv_id", "role", "digest", F.when(F.col("again"), F.col("piece")).otherwise(-1)).orderBy("seq")
    rows = rows.withColumn("again", F.col("again") | (F.row_number().over(across) > 1))
    fault = F.when(F.col("blank"), BLANK).when(F.col("again"), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(0)
    return rows.select("conv_id", "piece", "seq", "turn", "initial", "copies", fault.alias("fault"))


def _path(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("bigint").alias("cost"), audit.alias("audit"))


def _then(path: Column, cost: Column | int, letters: Column | str) -> Column:
    return _path(path.cost + cost, F.concat(path.audit, letters if isinstance(letters, Column) else F.lit(letters)))


def _with_inserts(at: Column, s: Settings) -> Column:
    """Paths of the four states after empty turns were put in where that is cheaper; two in a row at most can pay."""

    def onward(user: Column) -> Column:
        return F.struct(at.start.alias("start"), at.system.alias("system"), user.alias("user"), F.least(at.assistant, _then(user, s.insert, "I")).alias("assistant"))

    return let(F.least(at.user, *(_then(x, s.insert, "I") for x in (at.start, at.system, at.assistant))), onward)


def _step(at: Column, t: Column, s: Settings) -> Column:
    gone = F.concat(F.lit("D"), F.repeat(F.lit("D"), (t.copies - 1).cast("int")))
    late = F.repeat(F.lit("D"), (t.copies - 1).cast("int"))
    rest = s.delete * (t.copies - 1)

    def said(initial: str, *before: Column) -> list[Column]:
        kept = t.initial == initial
        cost = F.when(kept, 0).otherwise(s.rerole) + F.when(t.fault == TRUNCATED, s.truncated).otherwise(0)
        letter = F.concat(F.when(kept, "K").otherwise("R"), late)
        # least passes over nulls: blank and duplicate turns can only go
        return [F.when(~t.fault.isin(BLANK, DUPLICATE), _then(x, cost + rest, letter)) for x in before]

    drop = lambda x: _then(x, s.delete * t.copies, gone)
    system = F.when((t.initial == "s") & ~t.fault.isin(BLANK, DUPLICATE), _then(at.start, F.when(t.fault == TRUNCATED, s.truncated).otherwise(0) + rest, F.concat(F.lit("K"), late)))
    moved = F.struct(
        drop(at.start).alias("start"),
        F.least(drop(at.system), system).alias("system"),
        F.least(drop(at.user), *said("u", at.start, at.system, at.assistant)).alias("user"),
        F.least(drop(at.assistant), *said("a", at.user)).alias("assistant"),
    )
    return let(moved, lambda m: _with_inserts(m, s))


_STATES = ("start", "system", "user", "assistant")


def _moves(turns: Column, s: Settings) -> Column:
    """For each state before the turns: the cheapest (cost, audit, marked) to each state after them."""

    def of(state: int) -> Column:
        first = F.struct(*(_path(F.lit(0 if i == state else _NEVER), F.lit("")).alias(n) for i, n in enumerate(_STATES)))
        folded = F.aggregate(turns, let(first, lambda x: _with_inserts(x, s)), lambda at, t: _step(at, t, s))
        return let(folded, lambda x: F.array(*(F.struct(x[n].cost.alias("cost"), x[n].audit.alias("audit"), x[n].audit.alias("marked")) for n in _STATES)))

    return F.array(*(of(i) for i in range(4)))


def _compose(left: Column, right: Column) -> Column:
    """Cheapest moves through two stretches one after the other; a mark and the state between stand where the second begins."""

    def through(row: Column, end: int) -> Column:
        ways = []
        for between in range(4):
            a, b = row[between], right[between][end]
            ways.append(F.struct((a.cost + b.cost).alias("cost"), F.concat(a.audit, b.audit).alias("audit"), F.concat(a.marked, F.lit(f"{_MARK}{between}"), b.marked).alias("marked")))
        return F.least(*ways)

    return F.transform(left, lambda row: F.array(*(through(row, end) for end in range(4))))


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "n_turns")


def _folded(flagged: DataFrame, s: Settings) -> DataFrame:
    """A row a piece: counts, what stands at its edges, and its moves."""
    lists = flagged.groupBy("conv_id", "piece").agg(F.array_sort(F.collect_list(F.struct("seq", "turn", "initial", "copies", "fault"))).alias("t"))
    pairs = F.zip_with(F.slice("t", 1, F.size("t") - 1), F.slice("t", 2, F.size("t")), lambda a, b: F.struct(F.concat(a.initial, b.initial).alias("roles"), (b.turn.isNotNull() & (a.turn.isNull() | (a.turn != b.turn))).alias("new")))
    total = lambda each: F.aggregate("t", F.lit(0).cast("bigint"), lambda n, t: n + each(t))
    later = lambda t: t.copies - 1
    return lists.select(
        "conv_id",
        "piece",
        F.get("t", F.lit(0)).initial.alias("first_initial"),
        F.element_at("t", -1).initial.alias("last_initial"),
        F.get("t", F.lit(0)).turn.alias("first_turn"),
        F.element_at("t", -1).turn.alias("last_turn"),
        F.array_min(F.transform("t", lambda t: t.turn)).alias("min_turn"),
        F.array_max(F.transform("t", lambda t: t.turn)).alias("max_turn"),
        total(lambda t: F.when(t.fault == BLANK, t.copies).otherwise(0)).alias("blank"),
        total(lambda t: F.when(t.fault == BLANK, 0).when(t.fault == DUPLICATE, t.copies).otherwise(later(t))).alias("duplicate"),
        total(lambda t: F.when(t.fault == TRUNCATED, 1).otherwise(0)).alias("truncated"),
        (F.size(F.filter(pairs, lambda p: ~p.roles.isin(*_LEGAL))) + total(later)).cast("bigint").alias("illegal"),
        (F.size(F.filter(pairs, lambda p: p.new)) + F.get("t", F.lit(0)).turn.isNotNull().cast("int")).cast("bigint").alias("n_turns"),
        _moves(F.col("t"), s).alias("moves"),
    )


def _joined(pieces: DataFrame, fan_in: int) -> DataFrame:
    """Pieces of a conversation joined, ``fan_in`` neighbours to one."""
    facts = [c for c in pieces.columns if c not in ("conv_id", "place")]
    lists = pieces.groupBy("conv_id", F.floor(F.col("place") / fan_in).alias("place")).agg(F.array_sort(F.collect_list(F.struct("place", *facts))).alias("p"))
    pick = lambda a, b, name: (F.least if name == "min_turn" else F.greatest)(a[name], b[name])

    def merge(a: Column, b: Column) -> Column:
        seam = {
            "illegal": F.when(F.concat(a.last_initial, b.first_initial).isin(*_LEGAL), 0).otherwise(1),
            "n_turns": F.when(a.last_turn == b.first_turn, -1).otherwise(0),
        }
        by_name = {"first_initial": a.first_initial, "last_initial": b.last_initial, "first_turn": a.first_turn, "last_turn": b.last_turn, "moves": _compose(a.moves, b.moves)}
        by_name |= {n: pick(a, b, n) for n in ("min_turn", "max_turn")} | {n: a[n] + b[n] + seam.get(n, F.lit(0)) for n in _COUNTS}
        return F.struct(a.place.alias("place"), *(by_name[n].alias(n) for n in facts))

    whole = F.aggregate(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), F.get("p", F.lit(0)), merge)
    return lists.withColumn("w", whole).select("conv_id", "place", *(F.col("w")[n].alias(n) for n in facts))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream sorted by (conversation, piece, row): a piece's edits (no role; the state before it, then the letters), then its rows."""
    out: list[tuple] = []
    key, edits, at, state, pos = (None, None), "", 0, 0, 0

    def emit(edit: str, role: str, text: str) -> None:
        nonlocal state, pos
        state = "sua".index(role[0]) + 1
        out.append((*key, pos, edit, role, text))
        pos += 1

    def inserts() -> None:
        nonlocal at
        while edits[at : at + 1] == "I":
            at += 1
            emit("I", "assistant" if state == 2 else "user", "")

    names = ["conv_id", "piece", "pos", "edit", "role", "text"]

    def flush(kind: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 6
        kinds = [kind, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, piece, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "role", "text", "copies")), strict=True):
            if role is None:
                inserts()
                key, edits, at, state, pos = (conv, piece), text, 1, int(text[0]), 0
                continue
            inserts()
            if edits[at] == "K":
                emit("K", role, text)
            elif edits[at] == "R":
                emit("R", "assistant" if state == 2 else "user", text)
            at += copies
        yield flush(kind)
    inserts()
    yield flush(kind)


def repair_conversations(turns: DataFrame, settings: Settings = Settings()) -> Repaired:
    """Cheapest repair of every conversation of ``turns`` (conv_id, turn, role, text; see the module's notes).

    A row's first fault counts: blank, duplicate of an earlier row's role and text, truncated (its last character
    that is no white space is not one of ``.!?``). Edits are Keep, Rerole to user or assistant, Delete (blank
    and duplicate rows must go) and Insert of an empty turn. Of equally cheap edits those whose letters come
    first win. gaps are missing turn numbers between the least and the greatest; illegal are neighbours in role order
    other than su, ua and au.
    """
    s = settings
    rows = scratch.materialise(_turns(turns), "turns")
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("piece")) - 1
    pieces = scratch.materialise(_folded(_flagged(rows, s.piece_bits), s).withColumn("place", place.cast("bigint")), "pieces")
    most = (pieces.agg(F.max("place")).first()[0] or 0) + 1
    whole = pieces.drop("piece")
    while most > 1:
        whole, most = scratch.materialise(_joined(whole, s.fan_in), "joined"), -(-most // s.fan_in)
    best = whole.withColumn("best", F.least(F.col("moves")[0][0], F.col("moves")[0][3]))
    gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("n_turns"), F.lit(0)).cast("bigint")
    summary = best.select("conv_id", gaps.alias("gaps"), *_COUNTS[:4], F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"))
    parts = best.select("conv_id", F.posexplode(F.split(F.concat(F.lit("0"), "best.marked"), r"\|")).alias("place", "edits"))
    edits = parts.join(pieces.select(F.col("conv_id").alias("c"), F.col("place").alias("p"), "piece"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("place") == F.col("p")))
    stream = edits.select("conv_id", "piece", F.lit(-1).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("role"), F.col("edits").alias("text"), F.lit(0).cast("bigint").alias("copies"))
    stream = stream.unionByName(rows.select("conv_id", F.shiftright("seq", s.piece_bits).alias("piece"), "seq", "role", "text", "copies"))
    stream = stream.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "seq")
    kind = rows.schema["conv_id"].dataType.simpleString()
    repaired = stream.mapInArrow(trimmed(_apply), f"conv_id {kind}, piece bigint, pos bigint, edit string, role string, text string")
    return Repaired(summary, repaired)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = object()
    now, digest, kind = nothing, None, pa.int64()

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if conv != now:
                if now is not nothing:
                    yield row()
                now, digest = conv, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
    if now is not nothing:
        yield row()


def conversation_hashes(repaired: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's lines ``role:text``. A hash is made in reading order, so a conversation
    passes one task, as a stream of batches of which none is kept."""
    stream = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "piece", "pos").select("conv_id", "role", "text")
    kind = repaired.schema["conv_id"].dataType.simpleString()
    return stream.mapInArrow(trimmed(_hash), f"conv_id {kind}, repaired_sha256 string")


def damage_turns(conversations: DataFrame) -> DataFrame:
    """Turns damaged by the CRC-32 of ``conv_id:turn`` (a null is one space), modulo 20: 0 drops the row, 1 empties its
    text, 2 takes ``.!?`` out of it, 3 repeats the row, 4 makes the user its speaker."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), (F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20).alias("d"))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("d") == 4, "user").otherwise(F.col("role"))
    rows = rows.filter("d != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("d") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")
