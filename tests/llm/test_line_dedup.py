import random

import duckdb

from palimpsest.llm.line_dedup import Settings, dedup_lines


def corpus(seed):
    rng = random.Random(seed)
    common = [f"common line number {i} of many" for i in range(12)]
    rows = []
    for i in range(160):
        lines = [rng.choice(common) if rng.random() < 0.4 else f"own line {rng.random()}" for _ in range(rng.randint(1, 6))]
        rows.append((i, "\n".join(lines), f"site{rng.randrange(14)}"))
    return rows + [(900, None, "site1"), (901, "", "site2"), (902, "\n\n", None), (903, common[0], None), (903, common[0], None)]


def brute_force(rows, s):
    sites, first = {}, {}
    for i, text, site in rows:
        for line in (text or "").split("\n") if text is not None else []:
            key = line.strip(" ")
            if len(key) >= s.min_chars:
                if site is not None:
                    sites.setdefault(key, set()).add(site)
                first[key] = min(i, first.get(key, i))
    bad = {k for k, v in sites.items() if len(v) >= s.min_sites}
    keep = lambda i, x: x.strip(" ") not in bad or (s.keep_first and first[x.strip(" ")] == i)
    return sorted((i, "\n".join(x for x in t.split("\n") if keep(i, x)) if t is not None else None) for i, t, _ in rows if True) if all(t is not None for _, t, _ in rows) else sorted(
        ((i, None if t is None else "\n".join(x for x in t.split("\n") if keep(i, x))) for i, t, _ in rows), key=repr
    )


def test_equals_brute_force(spark):
    for keep_first in (False, True):
        s = Settings(min_sites=7, keep_first=keep_first)
        rows = corpus(3)
        df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 AS line", "2 AS n_lines", "3 AS site")
        out = dedup_lines(df, settings=s)
        assert out.columns == ["doc_id", "text", "source", "line", "site", "n_lines", "n_removed"]
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(brute_force(rows, s), key=repr)


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id bigint, text string, source string")).count() == 0


def test_registered_sql(spark, tmp_path):
    from palimpsest.llm.queries import QUERIES, SQL

    rows = [(i, t or "", s or "none") for i, t, s in corpus(5)[:-1]]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = QUERIES["op5_line_dedup"](spark, str(tmp_path))
    want = con.sql(SQL["op5_line_dedup"])
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())


def test_few_sites_in_unlike_texts_equal_brute_force(spark):
    rng = random.Random(4)
    common = [f"common {i} " + "x" * (60 * (i % 2)) for i in range(100, 300)]
    rows = [(i, "\n".join([*rng.sample(common, rng.randint(1, 3)), *(f"own line {rng.random()}" for _ in range(rng.randint(0, 4)))]), f"site{rng.randrange(14)}") for i in range(300)]
    rows += [(1000 + i, "the only line of a copied text of some length, which is left for the join", f"site{i}") for i in range(5)]
    s = Settings(min_chars=8, far_sites=(2, 3))
    seen = {}
    for _, text, site in rows:
        for line in text.split("\n"):
            seen.setdefault(line.strip(), []).append((site, len(text)))
    bad = set()
    for line, at in seen.items():
        sites, sizes = len({a for a, _ in at}), [n for _, n in at]
        if sites >= 10 or (min(sizes) < 0.75 * max(sizes) and sites >= (2 if len(line) >= 60 else 3)):
            bad.add(line)
    assert 20 < len(bad) < 200
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    want = sorted((i, "\n".join(x for x in t.split("\n") if x.strip() not in bad)) for i, t, _ in rows)
    assert sorted((r.doc_id, r.text) for r in dedup_lines(df, settings=s).collect()) == want
