"""Scans in stretches against scans of whole keys, and the queries over one session against their SQL."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_queries import DIR, duck, plain  # noqa: F401
from trialspark.operators import scan, segment
from trialspark.operators.scan import STRETCH, Scan
from trialspark.plans import session_queries


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(4)
    rows, t = [], 0
    for k in ("a", "b", None):
        t = rng.randrange(50)
        for _ in range(rng.randint(150, 200)):
            t += rng.choice([1, 1, 1, 7, 60])
            rows.append((k, t, rng.choice([None, float(rng.randrange(9))]), rng.random() < 0.8))
    rows.append(("one", 3, 1.0, True))
    return spark.createDataFrame(rows, "k string, i int, v double, f boolean").repartition(5).cache()


def same(a, b):
    columns = sorted(a.columns)
    text = lambda df: sorted(str([round(x, 9) if isinstance(x, float) else x for x in (r[c] for c in columns)]) for r in df.collect())
    return columns == sorted(b.columns) and text(a) == text(b)


@pytest.mark.parametrize("span", [1.0, 13.0, 400.0, 1e9])
def test_steps_do_not_depend_on_stretches(samples, span):
    step = lambda s: s.previous(p=F.col("v"), q=F.col("i")).following(n=F.col("v")).running(c=F.col("v")).running(F.max, m=F.col("v")).held(h=F.col("v")).awaited(a=F.when(F.col("f"), F.col("i"))).rows()
    assert same(step(Scan(samples, ["k"], "i", span)), step(Scan(samples, ["k"], "i")))


@pytest.mark.parametrize("span", [5.0, 90.0])
def test_segments_do_not_depend_on_stretches(samples, span):
    k = ["k"]
    for f in (
        lambda s: segment.edges(samples, k, "i", F.col("f"), s),
        lambda s: segment.islands(samples, k, "i", F.col("f"), {"top": F.max("v")}, s),
        lambda s: segment.states(samples, k, "i", F.col("v"), s),
        lambda s: segment.flag_runs(samples, k, "i", F.col("f"), "long", 4.0, 1.0, s),
        lambda s: segment.acceleration(samples, k, "i", "v", 10.0, span=s),
        lambda s: segment.position(samples, k, "i", "v", 10.0, blank=~F.col("f"), span=s),
        lambda s: segment.motion(samples, k, "i", "v", 1.0, span=s),
        lambda s: segment.bouts(samples, k, "i", F.col("f"), 1.0, F.col("i") > 20, span=s),
        lambda s: segment.session_bounds(samples, k, "i", 5.0, s),
        lambda s: segment.change_points(samples, k, "i", "f", 2.0, s),
        lambda s: segment.merged(samples.select("k", F.col("i").alias("w0"), (F.col("i") + F.coalesce("v", F.lit(0.0))).alias("w1")), k, span=s),
    ):
        assert same(f(span), f(None))


def test_a_run_may_cover_many_stretches(spark):
    rows = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("i"), (F.col("id") != 700).alias("f"))
    assert sorted((r.start, r.end, r.n) for r in segment.islands(rows, ["k"], "i", F.col("f"), span=10.0).collect()) == [(0, 699, 700), (701, 999, 299)]
    assert segment.flag_runs(rows, ["k"], "i", F.col("f"), "long", 500, 1.0, 10.0).filter("long").count() == 700


def test_stretches_of_an_even_span_are_even(spark):
    rows = spark.range(10_000).select(F.lit(1).alias("k"), (F.col("id") * 3 + 5).alias("i"))
    span = scan.even_span(rows, "i")
    sizes = sorted(r["count"] for r in Scan(rows, ["k"], "i", span).df.groupBy(STRETCH).count().collect())
    assert 90 <= len(sizes) <= 110 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    assert scan.even_span(rows.limit(0), "i") == 1.0 and scan.even_span(rows.limit(1), "i") > 0
    with pytest.raises(ValueError):
        Scan(rows, ["k"], "i", 0.0)


@pytest.mark.parametrize("name", sorted(session_queries.QUERIES))
def test_one_session_against_sql(spark, duck, name):  # noqa: F811
    df = session_queries.QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    told = duck.execute(f"SELECT {', '.join(f'\"{c}\"' for c in names)} FROM ({session_queries.ORACLES[name]})").fetchall()
    assert mine == sorted(tuple(plain(v) for v in r) for r in told)
