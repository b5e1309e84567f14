import hashlib
import heapq
import random
import re
import zlib

from palimpsest.llm.turn_repair import Settings, conversation_hashes, damage_turns, repair_conversations

SCHEMA = "conv_id bigint, turn bigint, role string, text string, v int, piece string"
WORD = re.compile("[^\x20\x09-\x0d]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        word = lambda x: " " if x is None else str(x)
        d = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = word(role), word(text)
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def repaired(rows):
    """Cheapest edits by a search over (rows read, roles said) that knows nothing of the operator's states."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        last = WORD.findall(text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[2][:1] or " " for r in rows]
    short = lambda said: said if len(said) < 3 else ("s" if said[0] == "s" else "") + "ua" + ("u" if said[-1] == "u" else "")
    ok = re.compile("(s?(ua)*u?)?$")
    todo, done = [(0, "", 0, "", ())], set()
    while todo:
        cost, audit, i, said, lines = heapq.heappop(todo)
        if (i, said) in done:
            continue
        done.add((i, said))
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", said):
            break
        moves = [(3, "I", i, x, f"{name}:") for x, name in (("u", "user"), ("a", "assistant"))]
        if i < len(rows):
            _, _, role, text = rows[i]
            late = 3 if faults[i] == "truncated" else 0
            moves.append((4, "D", i + 1, "", None))
            if faults[i] not in ("blank", "duplicate"):
                moves += [(late, "K", i + 1, initials[i], f"{role}:{text}")] + [(3 + late, "R", i + 1, x, f"{name}:{text}") for x, name in (("u", "user"), ("a", "assistant"))]
        for more, letter, j, x, line in moves:
            if ok.match(said + x):
                heapq.heappush(todo, (cost + more, audit + letter, j, short(said + x), lines + (() if line is None else (line,))))
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def by_operator(spark, rows, settings=Settings()):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    out = repair_conversations(df, settings)
    digests = {r.conv_id: r.repaired_sha256 for r in conversation_hashes(out.turns).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (*r[1:], digests.get(r.conv_id, empty)) for r in out.summary.collect()}


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((*r[:2], " " if r[2] is None else r[2], " " if r[3] is None else r[3]))
    return {k: repaired(v) for k, v in by.items()}


def conversations(rng, n, longest):
    roles = ["user", "assistant", "system", "tool", "upset", "", None]
    texts = ["Yes.", "No!", "what?", "cut", "", " \t", None, "a. ", "b.\n", "ok.", "é…", "fine."]
    rows = []
    for conv in [*range(n), None]:
        for _ in range(rng.randint(1, longest)):
            turn = rng.choice([None, *range(longest)])
            rows += [(conv, turn, rng.choices(roles, [9, 9, 3, 1, 1, 1, 1])[0], rng.choice(texts))] * rng.choice([1, 1, 1, 2, 3])
    rng.shuffle(rows)
    return rows


def test_damage(spark):
    rows = [(c, t, r, x) for c in (0, 7, None) for t in (*range(60), None) for r, x in (("user", "a. b? c!"), (None, None))]
    out = damage_turns(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)).collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, damaged(rows)))


def test_random_conversations_against_a_search(spark):
    rows = conversations(random.Random(1), 60, 12)
    assert by_operator(spark, rows) == expected(rows)


def test_conversations_in_many_pieces(spark):
    """Pieces of two rows, joined two by two: marks, seams of turn numbers and roles, repeats in other pieces."""
    rows = conversations(random.Random(2), 12, 40)
    assert by_operator(spark, rows, Settings(piece_bits=1, fan_in=2)) == expected(rows)


def test_long_conversation_and_long_text(spark):
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant"]), f"{t} " + rng.choice(["x.", "y", "z?"])) for t in range(3000)] + [(2, 0, "user", "w " * 200_000 + "."), (2, 1, "assistant", "v " * 200_000)]
    got = by_operator(spark, rows, Settings(piece_bits=6))
    assert got == expected(rows)


def test_empty(spark):
    assert by_operator(spark, []) == {}
