"""Mismatch windows and their ANOVA, planned speeds: against plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.operators import compare, stats


def test_windows_of_a_mismatch_fill_the_time_around_it(spark):
    onsets = spark.createDataFrame([(1, 7, 10.0)], "k int, trial int, onset double")
    out = sorted((r.w0, r.w1, r.part, r.window) for r in compare.mismatch_windows(onsets, ["k"], "trial", "onset", 2, 0.5).collect())
    assert out == [(8.0, 8.5, "control", 0), (8.5, 9.0, "control", 1), (9.0, 9.5, "baseline", 0), (9.5, 10.0, "baseline", 1), (10.0, 10.5, "response", 0), (10.5, 11.0, "response", 1)]


def additive_f(cells):
    """F of the first factor in an additive model of {(a, b): values}, by least squares on indicators."""
    rows = [(a, b, v) for (a, b), vs in cells.items() for v in vs]
    levels = [sorted({r[i] for r in rows}) for i in (0, 1)]
    design = lambda factors: np.array([[1.0, *(float(r[i] == x) for i in factors for x in levels[i][1:])] for r in rows])
    y = np.array([r[2] for r in rows])
    rest = [((y - d @ np.linalg.lstsq(d, y, rcond=None)[0]) ** 2).sum() for d in (design([0, 1]), design([1]))]
    df = len(rows) - 1 - sum(len(x) - 1 for x in levels)
    return ((rest[1] - rest[0]) / (len(levels[0]) - 1)) / (rest[0] / df)


def test_two_way_anova_without_interaction(spark):
    rng = np.random.default_rng(1)
    cells = {(a, b): list(rng.normal(size=5) + (a == "y")) for a, b in itertools.product("xy", range(4))}
    df = spark.createDataFrame([(1, a, b, float(v)) for (a, b), vs in cells.items() for v in vs], "k int, a string, b int, v double")
    out = stats.two_way_anova(df, ["k"], "a", "b", "v", interaction=False).first()
    assert out.f_a == pytest.approx(additive_f(cells)) and "f_ab" not in out and 0 < out.p_a < 1


def test_a_response_counts_only_where_control_and_baseline_agree(spark):
    rng = np.random.default_rng(2)
    spikes, onsets = [], []
    for unit, rates in (("up", (5, 5, 40)), ("down", (40, 40, 5)), ("none", (20, 20, 20)), ("drift", (5, 40, 80))):
        for trial in range(12):
            onset = 100.0 * trial + 50
            onsets.append((unit, trial, onset))
            for part, rate in zip((-0.8, -0.4, 0.0), rates, strict=True):
                spikes += [(unit, onset + part + float(u)) for u in rng.uniform(0, 0.4, round(rate * 0.4) + trial % 3 - 1)]
    twice = lambda rows, schema: spark.createDataFrame(rows, schema).withColumn("session", F.col("unit"))
    out = compare.mismatch_anova(twice(spikes, "unit string, t double"), twice(onsets, "unit string, trial int, onset double"), ["session"], ["unit"], "trial", "onset")
    told = {r.unit: (r.significant, r.direction, r.p_response is None) for r in out.collect()}
    assert told == {"up": (True, 1, False), "down": (True, -1, False), "none": (False, 0, False), "drift": (False, 0, True)}


def test_a_spline_goes_through_its_points_and_keeps_cubics():
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.uniform(0.1, 1, 30))
    at = np.linspace(x[0] - 0.5, x[-1] + 0.5, 200)
    cubic = lambda t: 0.3 * t**3 - 2 * t**2 + t - 4
    assert compare.spline_values(x, cubic(x), at) == pytest.approx(cubic(at), rel=1e-8)
    for n in (2, 3, 4, 5, 30):
        y = rng.normal(size=n)
        assert compare.spline_values(x[:n], y, x[:n]) == pytest.approx(y, abs=1e-9)
    y = np.sin(x)
    step = 1e-5
    values = lambda t: compare.spline_values(x, y, np.array([t]))[0]
    for knot in x[2:-2]:  # the second derivative doesn't jump
        second = [(values(t + step) - 2 * values(t) + values(t - step)) / step**2 for t in (knot - 3 * step, knot + 3 * step)]
        assert second[0] == pytest.approx(second[1], abs=1e-2)


def test_a_gaussian_plan_is_found():
    x = np.linspace(0, 1, 60)
    y = 30 * np.exp(-(((x - 0.6) / 0.25) ** 2))
    assert compare.gaussian_values(x, y, x) == pytest.approx(y, abs=1e-4)


@pytest.mark.parametrize("plan", ["gaussian", "spline"])
def test_progress_along_a_planned_trip(spark, plan):
    t = np.linspace(0.0, 10.0, 101)
    v = 30 * np.exp(-(((t / 10 - 0.5) / 0.3) ** 2))
    rows = [(1, float(a), float(b)) for a, b in zip(t, v, strict=True)] + [(2, 0.0, 1.0), (2, 1.0, 1.0), (2, 3.0, None)]
    out = compare.trip_progress(spark.createDataFrame(rows, "k int, t double, v double"), ["k"], "t", "v", plan=plan).orderBy("k", "t").collect()
    dt = np.append(np.diff(t), 0.0)
    way = 100 * np.cumsum(v * dt) / (np.maximum(v, 0.1) * dt).sum()
    assert [r.progress for r in out[:101]] == pytest.approx(list(np.clip(way, 0, 100)), abs=0.05)
    assert [r.progress for r in out[101:]] == pytest.approx([100 / 3, 100.0, 100.0])
    with pytest.raises(ValueError):
        compare.trip_progress(spark.createDataFrame(rows, "k int, t double, v double"), ["k"], "t", "v", plan="line")
    assert math.isfinite(out[0].progress)
