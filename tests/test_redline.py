import random
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import align
from palimpsest.functions.blocks import reading_blocks, reading_lines
from palimpsest.functions.markup import cut_provision
from palimpsest.operators import redline


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b):
            corner, row[j + 1] = row[j + 1], corner + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def holds(script, a, b):
    """A script covers both sides without a gap and its equal stretches are equal; how much they hold."""
    i = k = same = 0
    for op, i0, i1, k0, k1 in script:
        assert (i0, k0) == (i, k)
        if op == "equal":
            assert a[i0:i1] == b[k0:k1]
            same += i1 - i0
        i, k = i1, k1
    assert (i, k) == (len(a), len(b))
    return same


@pytest.mark.parametrize("kept", [1, 3, 1024])
def test_scripts_are_shortest(monkeypatch, kept):
    monkeypatch.setattr(align, "_KEPT", kept)
    rng = random.Random(kept)
    for _ in range(400):
        letters = "abcd"[: rng.randint(1, 4)]
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(2))
        script = align.edit_script(*align.numbered(a, b))
        assert holds(script, a, b) == longest_common(a, b)
        for other in (align.tidy(script), align.at_boundaries(script, a, b), align.at_boundaries(align.tidy(script), a, b)):
            holds(other, a, b)


def test_long_pair_in_seconds():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(500)]
    a = [rng.choice(words) for _ in range(25_000)]
    b = list(a)
    for _ in range(200):
        b[rng.randrange(len(b))] = rng.choice(words)
    a, b = " ".join(a), " ".join(b)
    began = time.time()
    ops = redline.character_ops(a, b)
    assert len(a) > 100_000 and time.time() - began < 20
    assert "".join(o["text"] for o in ops if o["op"] != "insert") == a and "".join(o["text"] for o in ops if o["op"] != "delete") == b


def test_short_remains_join_the_change_and_changes_fall_on_words():
    ops = redline.character_ops("the cat sat", "the dot sat")
    assert [o["op"] for o in ops] == ["equal", "delete", "insert", "equal"] and ops[-1]["text"].endswith(" sat")
    assert redline.character_ops("The c cat.", "The c came cat.")[1] == {"op": "insert", "text": "came "}
    assert redline.character_ops("", "") == [] and redline.character_ops("x", "x") == [{"op": "equal", "text": "x"}]
    assert redline.word_ops("pay $5,000 now", "pay $7,500 now")[1:3] == [{"op": "delete", "text": "$5,000"}, {"op": "insert", "text": "$7,500"}]


def test_lines_align_by_kind_depth_and_text():
    line = lambda text, depth=1, kind="text": (kind, depth, text)
    moved = redline.line_ops([line("one two")], [line("one two", 2)])
    assert [(o["op"], o["depth"]) for o in moved] == [("changed", 2)]
    assert [o["op"] for o in redline.line_ops([line("abc def")], [line("xyz uvw")])] == ["delete", "insert"]
    assert [o["op"] for o in redline.line_ops([line("a b c"), line("q")], [line("a b d")])] == ["changed", "delete"]
    assert [o["op"] for o in redline.line_ops([line("a b c")], [line("a b d"), line("q"), line("r", kind="note")])] == ["changed", "insert", "insert"]
    assert redline.line_ops([], []) == []
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([line(rng.choice("abc"), rng.randint(1, 2)) for _ in range(rng.randint(0, 12))] for _ in range(2))
        ops = redline.line_ops(a, b)
        assert sum(o["op"] == "equal" for o in ops) == longest_common(a, b)
        assert len(ops) == len(b) + sum(o["op"] == "delete" for o in ops)


def lines(markup):
    return [(x["depth"], x["kind"], x["text"]) for x in reading_lines(markup)]


def test_reading_lines():
    s = "<section><num>§ 1.</num><heading>Short  title</heading><subsection><num>(a)</num><chapeau>Whoever<b>ever</b></chapeau><paragraph><content>x</content></paragraph><continuation>shall pay.</continuation></subsection></section>"
    assert lines(s) == [(1, "text", "§ 1. Short title"), (2, "text", "(a) Whoeverever"), (3, "text", "x"), (2, "text", "shall pay.")]
    # a note beside text belongs to the sentence; between elements or behind a comment it is a block
    assert lines("<s>of 1872, <note>See note.</note> for parks</s>") == [(1, "text", "of 1872, See note. for parks")]
    assert lines("<s><note>See <p>one</p></note>tail</s>") == [(1, "text", "See onetail")]
    assert lines("<s><num>1</num><note>See <p>one</p>two</note> <i>x</i></s>") == [(1, "text", "1"), (1, "note", "See"), (1, "note", "one"), (1, "note", "two"), (1, "text", "x")]
    assert lines("<s>a<!-- c --><quotedContent>q</quotedContent><!-- c -->b</s>") == [(1, "text", "a"), (1, "text", "q"), (1, "text", "b")]
    # 2.x tables with a prefix, and what is skipped at any depth
    assert lines('<s xmlns:h="u"><h:table><h:tr><h:td>1</h:td><h:td>2</h:td></h:tr></h:table><meta>m</meta><content>a<property>p</property>b</content><toc>t</toc></s>') == [(1, "text", "1 2"), (1, "text", "ab")]
    assert lines("<note>plain</note>") == [(1, "text", "plain")]
    assert lines(None) == lines("") == lines("<a>") == lines("<a/>") == []
    deep = "<level>" * 3000 + "x" + "</level>" * 3000
    assert lines(deep) == [(3000, "text", "x")]


def test_empty_provisions():
    for piece in ('<p identifier="/d"/>', '<p identifier="/d" a="x>y" />', '<p identifier="/d"></p>', '<p identifier="/d">x<b/></p>', "<p identifier='/d' a='/'>/></p>"):
        for whole in (piece, f"<s>{piece}</s>", f"<s>{piece} tail <q>k</q></s>", f"<s><r/>é{piece}</s>"):
            assert cut_provision(whole, "/d") == (True, piece)


def test_differences_of_sections(spark):
    rows = [("<s><num>1</num><p>five words stand right here</p></s>", "<s><num>1</num><p>five words stood right here</p><note>new</note></s>"), (None, "<s>x</s>"), ("<s>x</s>", "<s> x </s>"), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    out = df.select(redline.block_diff(reading_blocks("a"), reading_blocks("b")).alias("d"), redline.source_redline(F.col("a"), F.col("b")).alias("r")).select("d", redline.diff_summary(F.col("d")).alias("s"), "r.*").collect()
    assert [r.s for r in out] == ["1 line changed, 1 line added", "1 line added", "No changes", "No changes"]
    assert [(x.op, x.kind, x.depth) for x in out[0].d] == [("equal", "text", 1), ("changed", "text", 1), ("insert", "note", 1)]
    assert [(r.inserted, r.deleted) for r in out] == [(18, 2), (8, 0), (3, 1), (0, 0)] and out[3].ops == []  # the x between two blanks joins them
