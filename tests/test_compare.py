"""Comparison queries against DuckDB, and operators in the order of a whole table against plain Python."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_queries import DIR, QUERIES, plain
from trialspark.operators import compare, intervals, ordered, segment, select, stats
from trialspark.plans import compare_queries, tail_sql


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(compare_queries.QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    df = compare_queries.QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    told = duck.execute(f"SELECT {', '.join(f'\"{c}\"' for c in names)} FROM ({compare_queries.ORACLES[name]})").fetchall()
    assert mine and mine == sorted(tuple(plain(v) for v in r) for r in told)


@pytest.mark.parametrize("name", sorted(tail_sql.ORACLES))
def test_tails_kernels_and_spectra_as_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    told = duck.execute(f"SELECT {', '.join(f'\"{c}\"' for c in names)} FROM ({tail_sql.ORACLES[name]})").fetchall()
    assert mine and mine == sorted(tuple(plain(v) for v in r) for r in told)


def test_places_of_values_and_ranks(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randrange(40)) for _ in range(500)] + [(None, 3), (None, 5), ("a", None)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(5)
    for r in ordered.value_places(df, ["k"], "v").collect():
        mine = [v for k, v in rows if k == r.k]
        less = sum(v is None or (r.v is not None and v < r.v) for v in mine if v != r.v)
        above = [v for v in mine if v is not None and (r.v is None or v > r.v)]
        assert (r.n, r.before, r.total, r.next) == (mine.count(r.v), less, len(mine), min(above, default=None))
    ranks = stats.mid_ranks(df.filter("v IS NOT NULL"), ["k"], "v").collect()
    assert len(ranks) == 502
    for r in ranks:
        mine = [v for k, v in rows if k == r.k and v is not None]
        assert r.rank == sum(v < r.v for v in mine) + (mine.count(r.v) + 1) / 2


def test_numbers_and_neighbours(spark):
    rng = random.Random(2)
    values = [rng.random() for _ in range(300)]
    out = ordered.row_numbers(spark.createDataFrame([(v,) for v in values], "v double").repartition(4), ["v"], "nth").collect()
    assert [r.v for r in sorted(out, key=lambda r: r.nth)] == sorted(values)
    rows = [(k % 3, rng.random(), rng.random() if k % 4 == 0 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "k int, t double, m double").repartition(6)
    for r in ordered.neighbours(df, ["k"], ["t"], F.col("m"), "b", "a").collect():
        marks = sorted((t, m) for k, t, m in rows if k == r.k and m is not None)
        assert r.b == next((m for t, m in reversed(marks) if t <= r.t), None) and r.a == next((m for t, m in marks if t >= r.t), None)


@pytest.mark.parametrize("extrapolate", [False, True])
def test_interpolation_of_one_long_key(spark, extrapolate):
    rng = np.random.default_rng(3)
    t = np.sort(rng.choice(10_000, 800, replace=False)) / 10 + 5
    v, at = rng.random(800), rng.random(500) * 1100
    samples = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(t, v, strict=True)], "k int, t double, v double").repartition(7)
    events = spark.createDataFrame([(1, float(a)) for a in at], "k int, t double")
    for r in intervals.interpolated(events, samples, ["k"], "t", "v", extrapolate=extrapolate).collect():
        if t[0] <= r.t <= t[-1]:
            assert r.value_at == pytest.approx(np.interp(r.t, t, v))
        elif not extrapolate:
            assert r.value_at is None
        else:
            i, j = (0, 1) if r.t < t[0] else (-2, -1)
            assert r.value_at == pytest.approx(v[i] + (v[j] - v[i]) / (t[j] - t[i]) * (r.t - t[i]))


def test_nearest_of_one_key_by_plain_search(spark):
    rng = random.Random(5)
    targets, points = [(k, rng.random()) for k in range(200)], [(k, rng.random() * 1.2 - 0.1) for k in range(300)]
    a, b = spark.createDataFrame(points, "p int, x double"), spark.createDataFrame(targets, "q int, y double")
    for r in intervals.nearest(a, b, [], "x", "y").collect():
        assert r.near_q == min(targets, key=lambda t: (abs(t[1] - r.x), t[1]))[0]


def test_windows_and_states(spark):
    w = spark.createDataFrame([(1, 0.0, 5.0), (1, 1.0, 2.0), (1, 5.0, 6.0), (1, 7.0, 8.0), (2, 0.0, 1.0)], "k int, w0 double, w1 double")
    assert sorted(map(tuple, segment.merged(w, ["k"]).collect())) == [(1, 0.0, 6.0), (1, 7.0, 8.0), (2, 0.0, 1.0)]
    s = spark.createDataFrame([(1, i, v) for i, v in enumerate(["a", "a", None, "a", "b", "b", "a"])], "k int, t int, v string")
    assert sorted((r.start, r.end, r.state) for r in segment.states(s, ["k"], "t", F.col("v")).collect()) == [(0, 1, "a"), (3, 3, "a"), (4, 5, "b"), (6, 6, "a")]


def test_trip_without_running_takes_the_mean(spark):
    rows = [(1, float(t), 1.0) for t in range(5)] + [(2, 0.0, 5.0)]
    out = {(r.k, r.t): r.progress for r in compare.trip_progress(spark.createDataFrame(rows, "k int, t double, v double"), ["k"], "t", "v").collect()}
    assert out[(1, 0.0)] == 25 and out[(1, 3.0)] == out[(1, 4.0)] == 100 and out[(2, 0.0)] == 100


def test_selections(spark):
    sessions = spark.createDataFrame([("a", "Coupled", 1), ("a", "Gratings", 2), ("b", "Replay", 3)], "probe_type string, protocol string, session int")
    rules = spark.createDataFrame([("a", "Coupled"), ("b", "Replay")], "probe_type string, protocol string")
    assert sorted(r.session for r in select.motion_session(sessions, rules).collect()) == [1, 3]
