import json
import zipfile

from pyspark.sql import functions as F

from palimpsest.sources import documents as S
from palimpsest.streaming import flows

XML = b"""<?xml version="1.0"?>
<uscDoc xmlns="http://xml.house.gov/schemas/uslm/1.0" identifier="/us/usc/t1"><main><title identifier="/us/usc/t1" id="g0"><num value="1">Title 1</num><heading>GENERAL</heading>
<chapter identifier="/us/usc/t1/ch1" id="g1" status="live"><num value="1">CHAPTER 1</num><heading>Rules</heading>
<section identifier="/us/usc/t1/s1" id="g2"><num value="1">1.</num><heading> Words </heading><p id="g3" identifier="/us/usc/t1/s1/a">text &amp; more</p><quotedContent><section identifier="/us/usc/t9/s9" id="g4"/></quotedContent></section>
<section identifier="/us/usc/t1/s1" id="g5"><num value="1">1.</num></section><section id="g6"/></chapter></title></main></uscDoc>"""


def test_sections_structure_and_pins(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes(XML)
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("b.xml", XML.replace(b'id="g2"', b'id="h2"'))
    rows = S.read_snapshots(spark, str(tmp_path))
    found = rows.filter("path like '%a.xml'").orderBy("kind", "seq").collect()
    assert [(r.kind, r.seq, r.identifier, r.depth) for r in found] == [("node", 0, "/us/usc/t1", 0), ("node", 0, "/us/usc/t1/ch1", 1), ("section", 0, "/us/usc/t1/s1", 2), ("section", 1, "/us/usc/t1/s1", 2)]
    first = found[2]
    assert first.heading == "Words" and first.parent_identifier == "/us/usc/t1/ch1" and first.n_raw == 4
    assert first.markup.startswith('<section identifier="/us/usc/t1/s1"') and first.markup.endswith("</section>") and "t9/s9" in first.markup
    # only ids differ between the two files, so the contents are one version
    assert rows.filter("kind = 'section' and seq = 0").select("content_hash").distinct().count() == 1
    pins = {r.guid: r.identifier for r in S.guid_pins(rows.filter("path like '%a.xml'")).collect()}
    assert pins["g3"] == "/us/usc/t1/s1/a" and pins["g4"] == "/us/usc/t9/s9"


def test_release_page(spark, tmp_path):
    entry = '<li class="releasepoint"><a class="releasepoint" href="x/usc-rp@%s.htm">%s</a></li>'
    page = "".join([entry % ("119-2", "Law 119-2 (2/1/2025) affecting titles 5, 16."), "<!--" + entry % ("9-9", "1/1/2020") + "-->", entry % ("119-1", "Law (1/4/2025), affecting title 47."), entry % ("119-1", "again (1/5/2025), affecting title 7."), entry % ("118-9", "no date")])
    (tmp_path / "p.htm").write_text(f"<ul>{page}</ul>")
    rows = {r.label: (r.seq, str(r.date), r.titles) for r in S.read_release_page(spark, str(tmp_path / "p.htm")).collect()}
    assert rows == {"119-1": (0, "2025-01-04", ["07", "47"]), "119-2": (1, "2025-02-01", ["05", "16"])}


def test_ledger_and_manifest(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"entries": [{"release_label": "1-1", "path": "/x/y/a/b.zip", "status": "ok"}]}))
    assert S.read_ledger(spark, str(tmp_path / "l.json")).first().path == "a/b.zip"
    (tmp_path / "m.json").write_text(json.dumps({"release": "1-1", "titles": {"05": {"sections_ingested": 3, "status_counts": {"repealed": 1}}}}))
    r = S.read_manifests(spark, str(tmp_path / "m.json")).first()
    assert (r.release, r.title, r.sections_ingested, r.status_counts) == ("1-1", "05", 3, {"repealed": 1})


def test_token_bucket():
    allowed, level, last = [], 2.0, 0.0
    for now in (0, 0, 0, 1.5, 1.6):
        ok, level, _ = flows.take_token(level, last, now, 2, 1)
        last = now
        allowed.append(ok)
    assert allowed == [True, True, False, True, False]


def test_streams_over_files(spark, tmp_path):
    events = spark.range(40).select((F.col("id") % 3).alias("ip"), (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=F.col("id").cast("int"))).alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("windows", flows.failures_per_window(stream, "ip"), "update"), ("limits", flows.rate_limited(stream, "ip", capacity=2, rate=1 / 600), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    assert spark.table("windows").agg(F.max("failures")).first()[0] == 5
    limits = spark.table("limits")
    assert limits.count() == 40 and 0 < limits.filter("allowed").count() < 40


def test_upsert_generations(spark, tmp_path):
    write = flows.upsert_batches(str(tmp_path / "t"), ["k"], ["o"])
    write(spark.createDataFrame([(1, 1, "a")], "k int, o int, v string"), 0)
    for _ in range(2):  # a batch that is run again changes nothing
        write(spark.createDataFrame([(1, 2, "b"), (2, 1, "c")], "k int, o int, v string"), 1)
    assert flows.generations(spark, str(tmp_path / "t")) == [0, 1]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t/generation=1")).collect())) == [(1, 2, "b"), (2, 1, "c")]
