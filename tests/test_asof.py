import datetime
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import asof


@pytest.mark.parametrize("ranges", [1, 4, 64])
def test_one_key_with_all_rows(spark, ranges):
    rng = random.Random(ranges)
    facts = [("hot" if rng.random() < 0.9 else rng.choice(["a", None]), rng.randint(0, 60), rng.randint(0, 9)) for _ in range(80)] + [("hot", None, 99)]
    requests = [(i, rng.choice(["hot", "hot", "hot", "a", None, "none"]), rng.choice([7, 7, rng.randint(-5, 70), None])) for i in range(300)]
    f, r = spark.createDataFrame(facts, "k string, since int, v int"), spark.createDataFrame(requests, "i int, k string, at int")
    got = {x.i: (x.found_since, x.v) for x in asof.as_of_join(r, f, ["k"], "at", "since", ["v"], ranges).collect()}
    want = {i: max(((s, v) for k2, s, v in facts if k2 == k and s is not None and at is not None and s <= at), default=(None, None)) for i, k, at in requests}
    assert got == want and len(got) == 300


def test_no_key_at_all(spark):
    day = lambda n: datetime.date(2020, 1, 1) + datetime.timedelta(n)
    rng = random.Random(2)
    releases = [(day(rng.randint(0, 300)), s) for s in range(200)]
    asked = [day(n) for n in range(-3, 310, 7)] * 2 + [None]
    got = asof.resolve_dates(spark.createDataFrame([(d,) for d in asked], "date date"), spark.createDataFrame(releases, "currency_date date, seq int")).collect()
    assert len(got) == len(asked) and all(x.resolved_seq == max((s for d, s in releases if x.date and d <= x.date), default=None) for x in got)
    numbered = asof.ranks(spark.range(5, 505).withColumn("id", F.col("id") * 3), "id").collect()
    assert sorted((x.id, x.n) for x in numbered) == [(3 * (i + 5), i + 1) for i in range(500)]
    seqs = list(range(0, 400, 3))
    checks = [(rng.randint(-2, 400), rng.choice([None, rng.randint(-2, 410)])) for _ in range(100)]
    got = asof.behind_by(spark.createDataFrame(checks, "loaded_seq int, published_seq int"), spark.createDataFrame([(s,) for s in seqs], "seq int")).collect()
    assert all(x.behind_by == (None if x.published_seq is None else sum(x.loaded_seq < s <= x.published_seq for s in seqs)) for x in got)


def test_no_facts_or_requests(spark):
    f, r = spark.createDataFrame([], "k int, since int"), spark.createDataFrame([(1, 5)], "k int, at int")
    assert [tuple(x) for x in asof.as_of_join(r, f, ["k"], "at", "since", []).collect()] == [(1, 5, None)]
    assert asof.as_of_join(r.limit(0), f, ["k"], "at", "since", []).count() == 0
