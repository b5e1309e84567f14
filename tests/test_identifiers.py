import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import citations as C
from palimpsest.functions import identifiers as I

def citations():
    """Every form over titles, appendices, sections and subdivisions, spelled in several ways, with what it names."""
    out = []
    for k, (title, app, section, below) in enumerate(itertools.product(("7", "38"), ("", "a"), ("91", "1701b-3", "77–4"), ((), ("d",), ("b", "12", "Q", "iv")))):
        name = f"/us/usc/t{title}{app}"
        parens, slashes = "".join(f"({x})" for x in below), "".join(f"/{x}" for x in below)
        code = ("U.S.C.", "usc", "U. S. C.", "USC")[k % 4]
        word = ("", " App.", " Appendix", ", app")[1 + k % 3 if app else 0]
        sign = ("", "§ ", "§§", "sec. ", "section ")[k % 5]
        want = f"{name}/s{section}{slashes}"
        out += [
            (f"{title} {code}{word} {sign}{section}{parens}", want),
            (f"({title}{app}  {code} {section}{parens})", want),
            (f"Section {section}{parens} of title {title}{word}", want),
            (f"section {section}{parens} of title {title}{app.upper()} note", want),
            (f"§{section}{parens}, {title} {code}{word} et seq.", want),
            (f"{title}{app}/{section}{slashes}", want),
            (f"t{title}{app}/s{section}{slashes}", want),
            (f"{want}/", want),
            (f"Title {title}{word}", name),
            (f"{title}{app} {code}", name),
            (f"title {title}{word}, subchapter {section}", f"{name}/sch{section}"),
            (f"{title}{app} {code} pt. IX", f"{name}/ptIX"),
            (f"us/usc/t{title}{app}/ch4/schII", f"{name}/ch4/schII"),
        ]
    return out


def unread():
    """Texts that name nothing of the code: written forms with a token left out, doubled or swapped, and plain words."""
    rng = random.Random(12)
    out = ["", "   ", None, "lorem ipsum", "title", "//"]
    for _ in range(6):
        title, section = str(rng.randint(2, 54)), str(rng.randint(60, 9000))
        code = rng.choice(["USC", "U.S.C."])
        out += [section, f"§ {section}", f"{section} of title {title}", f"{code} {title}", f"{code} {section} {title}"]  # left out or swapped
        out += [f"{title} {code} {section} {section}", f"{title} {code} {code} {section}", f"{title} {title} {code} {section}"]  # doubled
        out += [f"{title} {code} ({section[0]})", f"{title} {code} {section}(b"]
    return out


def test_citation_forms(spark):
    rows = citations() + [(x, None) for x in unread()]
    df = spark.createDataFrame(rows, "text string, want string").withColumn("got", C.parse_citation(F.col("text")).identifier)
    wrong = [tuple(r) for r in df.filter("NOT (got <=> want)").collect()]
    assert not wrong


def test_citation_flags_and_back(spark):
    rows = spark.createDataFrame([("38 USC 91 note",), ("38 USC 91 et seq.",)], "t string").select(C.parse_citation(F.col("t")).alias("c")).select("c.note", "c.et_seq", C.format_citation(F.col("c.identifier"))).collect()
    assert [tuple(r) for r in rows] == [(True, False, "38 U.S.C. § 91"), (False, True, "38 U.S.C. § 91")]


@pytest.mark.parametrize(
    ("column", "value", "want"),
    [
        (lambda x: I.format_label(I.parse_label(x)), "113-100not89not7u1", "113-100not89not7u1"),
        (lambda x: I.parse_label(x).law, "not a label", None),
        (I.file_title, "5A", "05a"),
        (I.file_title, "111", None),
        (I.normal_identifier, " us/usc/t1/ ", "/us/usc/t1"),
        (I.squeeze, "  a   b ", "a b"),
        (I.squeeze, "  ", None),
        (I.provision_label, "/c/5", "(c)(5)"),
        (I.content_key, "<a id=\"1\" xml:id='2' temporalId=\"3\" id='4'>", "<a xml:id='2' temporalId=\"3\">"),
        (I.fuzzify, "wild horse* \"x\"", "wild~1 horse* \"x\""),
        (I.cites_argument, "Cites  16 USC 1", "16 USC 1"),
        (I.highlight_markup, "<em>a</em> & <b>", "<em>a</em> &amp; &lt;b&gt;"),
        (I.parse_date, "7/12/2026", datetime.date(2026, 7, 12)),
        (I.parse_date, "July 12", None),
        (I.date_in_prose, "on July 1, 2017, then", datetime.date(2017, 7, 1)),
        (I.date_in_prose, "July 1, 2017 (1/4/2025) 1/5/2025", datetime.date(2025, 1, 4)),
        (lambda x: F.array_join(I.titles_in_prose(x), ","), "affecting titles 5, 16 and 11A, bad. 7", "05,16,11a"),
        (lambda x: F.array_join(I.dash_variants(x), " "), "45a–1", "45a–1 45a-1 45a—1"),
        (lambda x: F.array_join(I.prefixes(x), " "), "/us/usc/t1/s2/a", "/us/usc/t1/s2/a /us/usc/t1/s2 /us/usc/t1"),
    ],
)
def test_scalars(spark, column, value, want):
    assert spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0] == want
