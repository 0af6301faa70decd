"""Percentiles by selection, counts of gaps, lags by Fourier transforms, regressions in steps: against plain versions."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.operators import compare, glm, rates, segment, stats


def plain_hazen(values, prc):
    v = np.sort(values)
    return float(np.interp(prc, 100 * (np.arange(1, len(v) + 1) - 0.5) / len(v), v))


@pytest.mark.parametrize("accuracy", [50, 300, 20_000])
def test_percentiles_by_selection(spark, accuracy):
    rng = np.random.default_rng(accuracy)
    data = {"even": rng.normal(size=4000), "ties": rng.integers(0, 7, 3001).astype(float), None: rng.exponential(size=2500), "few": np.array([3.0, 1.0]), "one": np.array([5.0]), "same": np.full(1000, 2.0)}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("even", None), ("none", None)]
    percents = [0, 1, 5, 25, 50, 75, 99.9, 100]
    out = stats.hazen(spark.createDataFrame(rows, "k string, v double").repartition(6), ["k"], "v", percents, accuracy=accuracy).collect()
    assert {(r.k, r.prc) for r in out} == {(k, float(p)) for k in data for p in percents} and len(out) == len(data) * len(percents)
    for r in out:
        assert r.value == pytest.approx(plain_hazen(data[r.k], r.prc), abs=1e-9), (r.k, r.prc)


def test_a_selection_keeps_few_values(spark):
    rows = spark.range(100_000).select(F.lit(1).alias("k"), F.hash("id").cast("double").alias("v"))
    assert stats.near_ranks(rows, ["k"], "v", [25, 50, 75], accuracy=2000).count() < 3 * 100_000 * 10 / 2000


def test_medians_of_several_columns(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (1, 2.0, None), (1, 4.0, 7.0), (None, None, 1.0), (2, None, None)], "k int, a double, b double")
    assert {r.k: (r.x, r.y) for r in stats.medians(df, ["k"], x="a", y="b").collect()} == {1: (2.0, 6.0), None: (None, 1.0)}
    told = {r.k: (r.n, r.median) for r in stats.described(df, ["k"], "a").collect()}
    assert told == {1: (3, 2.0), None: (0, None), 2: (0, None)}


def test_means_are_joined_back_for_null_keys_too(spark):
    df = spark.createDataFrame([(None, 2.0, True), (None, 4.0, False), (1, 3.0, True), (1, None, True), (2, 1.0, False)], "k int, v double, r boolean")
    key = lambda r: str((r[0], r[1]))
    assert sorted(((r.k, r.v, r.normalised) for r in stats.normalised(df, ["k"], "v", F.col("r")).collect()), key=key) == sorted([(None, 2.0, 1.0), (None, 4.0, 2.0), (1, 3.0, 1.0), (1, None, None), (2, 1.0, None)], key=key)
    around = df.withColumn("lag", F.col("v") - 3)
    assert sorted(((r.k, r.v, r.subtracted) for r in rates.baseline_subtracted(around, ["k"], "lag", "v", (-2.0, 0.0)).collect()), key=key) == sorted([(None, 2.0, 0.0), (None, 4.0, 2.0), (1, 3.0, None), (1, None, None), (2, 1.0, 0.0)], key=key)


@pytest.mark.parametrize("span", [None, 3.0, 50.0])
def test_gaps_of_all_pairs_without_pairs(spark, span):
    rng = random.Random(2)
    spikes = {k: sorted(rng.randrange(300) / 2 for _ in range(n)) for k, n in (("a", 150), ("b", 60), ("one", 1))}
    df = spark.createDataFrame([(k, t) for k, ts in spikes.items() for t in ts], "k string, t double").repartition(3)
    told = {}
    for k, ts in spikes.items():
        for i, a in enumerate(ts):
            for b in ts[i + 1 :]:
                if 0 < b - a < 10:
                    told[k, int((b - a) // 1.5)] = told.get((k, int((b - a) // 1.5)), 0) + 1
    assert {(r.k, r.bin): r.n for r in compare.isi_pairs(df, ["k"], "t", 10.0, 1.5, span).collect()} == told


def test_lags_by_transforms_are_those_of_all_pairs():
    rng = np.random.default_rng(7)
    o, r = rng.normal(size=150), rng.normal(size=90)
    r[20:80] += 3 * o[60:120]
    o[[3, 70]], r[40] = np.nan, np.nan
    found = segment._lag_correlations(o, r, -200, 200)
    for lag, mine in zip(range(-200, 201), found, strict=True):
        at = [i for i in range(len(o)) if 0 <= i + lag < len(r) and np.isfinite(o[i]) and np.isfinite(r[i + lag])]
        told = np.corrcoef(o[at], r[np.array(at) + lag])[0, 1] if len(at) > 1 else np.nan
        assert (np.isnan(mine) and np.isnan(told)) or mine == pytest.approx(told, abs=1e-9), lag
    assert np.isnan(segment._lag_correlations(np.ones(9), rng.normal(size=9), 0, 3)).all()


def test_a_replay_is_matched_in_two_steps(spark):
    rng = np.random.default_rng(3)
    trace = np.convolve(rng.normal(size=6000), np.ones(200) / 200, "same")
    rows, late = [], {}
    for k, offset in ((1, 0), (2, 37), (3, 1490)):
        late[k] = offset
        rows += [(k, "o", i, float(v)) for i, v in enumerate(trace[:3000])]
        rows += [(k, "r", 500 + i, float(v)) for i, v in enumerate(np.r_[rng.normal(size=offset) * 0.01, trace[:3000]])]
    df = spark.createDataFrame(rows, "k int, side string, i int, v double")
    side = lambda s: df.filter(F.col("side") == s).drop("side")
    out = {r.k: (r.lag, r.r) for r in segment.matched_offset(side("o"), side("r"), ["k"], "i", "v", 100).collect()}
    assert {k: v[0] for k, v in out.items()} == late and all(v[1] > 0.999 for v in out.values())
    assert segment.matched_offset(side("o"), side("none"), ["k"], "i", "v").count() == 0


def test_regressions_in_steps_are_those_of_one_group(spark):
    rng = np.random.default_rng(5)
    rows = []
    for u, n in ((1, 300), (2, 80), (None, 60)):
        for i in range(n):
            a, b = rng.normal(), rng.normal()
            rows.append((u, i, float(a), [float(b), float(a * b)], int(rng.poisson(np.exp(0.3 * a - 0.5 * b) * 0.8)), 0.8, i % 5))
    df = spark.createDataFrame(rows, "u int, i int, a double, b array<double>, spike_count int, dt double, fold int").repartition(5)
    models = {"null": [], "one": ["a"], "both": ["a", "b"]}
    mine = {(r.u, r.model): r for r in glm.fitted_in_steps(df, ["u"], models).collect()}
    told = {(r.u, r.model): r for r in glm.fitted(df.filter("u IS NOT NULL"), ["u"], ["i"], models).collect()}
    assert set(mine) == {(u, m) for u in (1, 2, None) for m in models}
    for key, r in told.items():
        assert list(mine[key].beta) == pytest.approx(list(r.beta), abs=1e-6) and list(mine[key].se) == pytest.approx(list(r.se), abs=1e-6)
        for c in ("log_likelihood", "aic", "bic", "deviance", "dispersion", "cv_bits"):
            assert mine[key][c] == pytest.approx(r[c], abs=1e-6), c


def test_a_unit_of_one_fold_has_no_held_out_fit(spark):
    df = spark.createDataFrame([(1, i, float(i % 3), i % 2, 1.0, 0) for i in range(20)], "u int, i int, a double, spike_count int, dt double, fold int")
    mine, told = (f(df, ["u"], *x, {"m": ["a"]}).first() for f, x in ((glm.fitted_in_steps, ()), (glm.fitted, (["i"],))))
    assert mine.cv_bits == pytest.approx(told.cv_bits) and list(mine.beta) == pytest.approx(list(told.beta), abs=1e-6)


def test_stored_tables_can_be_deleted(spark, monkeypatch):
    from trialspark.operators import ordered

    mine = []
    monkeypatch.setattr(ordered, "_PATHS", mine)
    df = ordered.row_numbers(spark.range(50).withColumn("v", F.col("id") % 7), ["v", "id"], "place")
    assert df.count() == 50 and len(mine) == 1
    path = Path(mine[0].removeprefix("file://"))
    assert path.exists()
    ordered.discard_stored(spark)
    assert not path.exists() and mine == []


def test_spikes_are_exported_with_all_lags_at_once(spark):
    from trialspark.operators.intervals import interpolated

    spikes = spark.createDataFrame([("a", 1.0, 7), ("a", 1.0, 7), ("a", 2.5, 8), ("b", 9.0, 9)], "k string, t double, u int")
    samples = spark.createDataFrame([("a", 0.0, 0.0), ("a", 3.0, 30.0)], "k string, t double, p double")
    out = sorted((r.k, r.t, r.u, r.position, r.image_500ms, r.image_2000ms) for r in compare.exported_spikes(spikes, samples, ["k"], "t", "p", [0.5, 2.0], 2.0, interpolated).collect())
    assert out == [("a", 1.0, 7, 10.0, 10, None), ("a", 1.0, 7, 10.0, 10, None), ("a", 2.5, 8, 25.0, 40, 10), ("b", 9.0, 9, None, None, None)]
