import random

import duckdb

from palimpsest.llm.chat_format import Settings, rotate_perspectives
from palimpsest.llm.queries import OP3_SQL, op3_perspective_rotation
from palimpsest.llm.site_style import extract_main_text, main_text, parse

CHAT = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi \U0001f600"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, None, "x"), (2, 5, "system", "alone"), (None, 1, "ann", "lost"), (3, 300, "ann", "later")]


def test_perspectives(spark):
    df = spark.createDataFrame(CHAT, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS speaker", "2 AS part")
    rows = rotate_perspectives(df, Settings(part_turns=2)).collect()
    whole = {}
    for r in sorted(rows, key=lambda r: r.part):
        text = whole.setdefault((r.conv_id, r.speaker), "")
        assert r.start == len(text)
        for m in r.mask:
            assert r.text[m.start : m.end].endswith("<|im_end|>") and r.text[: m.start].endswith("<|im_start|>assistant\n")
        whole[r.conv_id, r.speaker] = text + r.text
    assert set(whole) == {(1, "ann"), (1, "bob"), (1, "unknown"), (3, "ann")}
    assert whole[1, "ann"] == (
        "<|im_start|>user name=unknown\nx<|im_end|>\n<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi \U0001f600<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n"
    )
    assert rotate_perspectives(df.limit(0)).count() == 0


def test_very_many_rows_of_one_turn_are_dealt_over_pieces(spark):
    rows = [(1, None, "ann", f"t{k % 40}") for k in range(300)] + [(1, 7, "bob", "same")] * 150 + [(1, 8, "ann", "end" * 5000), (2, 1, "ann", "Hi")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = rotate_perspectives(df, Settings(piece_rows=20)).collect()
    # null numbers are part -1 with 300 rows, the others part 0 with 151
    want = {(-1, k): 20 for k in range(15)} | {(0, k): 20 for k in range(7)} | {(0, 7): 11}
    assert {(r.part, r.piece): r.n_turns for r in got if r.conv_id == 1} == want
    whole, plain = {}, {}
    for r in sorted(got, key=lambda r: (r.part, r.piece)):
        text = whole.setdefault((r.conv_id, r.speaker), "")
        assert r.start == len(text)
        whole[r.conv_id, r.speaker] = text + r.text
    for r in sorted(rotate_perspectives(df).collect(), key=lambda r: (r.part, r.piece)):
        assert r.piece == 0
        plain[r.conv_id, r.speaker] = plain.get((r.conv_id, r.speaker), "") + r.text
    assert whole == plain  # however large the pieces are, the rendering is one


def test_large_part_equals_its_sql(spark, tmp_path):
    """2,100 rows of one turn number, more of others, hot copies, and nulls, against the query's SQL."""
    rng = random.Random(3)
    rows = [(1, 5, rng.choice(["ann", "bob", "system", None]), f"t{rng.randrange(900)}") for _ in range(2100)] + [(1, None, "ann", None)] * 2500
    rows += [(2, k // 3, rng.choice(["ann", "cy"]), f"u{k}") for k in range(700)] + [(1, 200, "bob", "late"), (None, 1, "ann", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(OP3_SQL).df()
    got = op3_perspective_rotation(spark, str(tmp_path)).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.astype(str).values)) == sorted(map(tuple, want.astype(str).values))
    assert got.piece.max() == 1


def test_main_text_of_messy_markup():
    html = (
        "<html><body><nav>Menu</nav><div class='ad'>Buy</div><article><header>By X</header><h1>A &amp; B</h1><p><b>One\n two<br><p>three</b></p><ul><li>x<li>y</ul>"
        "<div class='comments'><p>nice</p></div><form>mail</form><script>v='</p>'</script><style>p{}</style></article><aside>side</aside><footer>&copy;</footer>"
    )
    assert main_text(parse(html)) == "A & B\nOne two\nthree\nx\ny"
    assert main_text(parse("just text <b>here</b>")) == "just text here"


def test_site_style_tree_cuts_templates(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div><p>All rights are ours</p></div><div class='t'><p>Story {i} of many</p><p>more {i * 7}</p></div></body>") for i in range(30)]
    rows += [(100, "http://other.example/", "<body><p>All rights are ours</p></body>"), (101, None, None), (102, "::bad[", ""), (103, "http://h.example/5", rows[5][2])]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS host", "2 AS text")
    got = {r.page_id: r.text for r in extract_main_text(df).collect()}
    assert got[5] == got[103] and got[5].endswith("Story 5 of many\nmore 35")
    assert got[100] == "All rights are ours" and got[101] == got[102] == ""
    assert extract_main_text(df.limit(0)).count() == 0


def test_site_style_tree_cuts_inside_articles(spark):
    body = "<article><h1>Title {i}</h1><p>Story {i} of many<br>goes on</p><hr><div class='zq'><p>Read our other stories</p></div><p>more {j}</p><p>Tell all your friends</p></article>"
    page = lambda host, i: (i, f"http://{host}.example/{i}", body.format(i=i, j=i * 7))
    want = lambda i: [f"Title {i}", f"Story {i} of many goes on", f"more {i * 7}"]
    rows = [page("large", i) for i in range(20)] + [page("small", i) for i in range(100, 103)] + [page("one", 200)]
    # copies of one article in other frames, and near copies, are no template
    rows += [(300 + i, f"http://copy.example/{i}", f"<body><div>frame {i}</div><article><p>the same article</p><p>in both</p></article>") for i in range(2)]
    rows += [(400 + i, f"http://near.example/{i}", f"<article>{''.join(f'<p>part {k}</p>' for k in range(60))}<p>end {i}</p></article>") for i in range(2)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text.split("\n") for r in extract_main_text(df).collect()}
    assert all(got[i] == want(i) for i in range(20))
    # few pages judge branches, not lines; one page judges nothing
    assert all(got[i] == [*want(i), "Tell all your friends"] for i in range(100, 103))
    assert got[200] == [*want(200)[:2], "Read our other stories", want(200)[2], "Tell all your friends"]
    assert got[300] == got[301] == ["the same article", "in both"]
    assert got[401] == [*(f"part {k}" for k in range(60)), "end 1"]
