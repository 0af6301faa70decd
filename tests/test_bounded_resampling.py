"""Nulls, redrawn fits and rates around triggers whose work doesn't grow with all pairs or all draws at once."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.functions.digests import md5_of_numbers
from trialspark.functions.gauss import Spikes
from trialspark.operators import rates, rf, tuning


def test_md5_of_numbers_is_hashlibs():
    for prefix, low, high in (("1:0:", 0, 1200), ("1:99:", 99_990, 100_020), ("7:123456:", 9_999_999_990, 10_000_000_010), ("", 5, 6), ("1:", 5, 5)):
        assert md5_of_numbers(prefix, low, high).tolist() == [int(hashlib.md5(f"{prefix}{k}".encode()).hexdigest()[:8], 16) for k in range(low, high)]
    with pytest.raises(ValueError):
        md5_of_numbers("x" * 60, 0, 1)


def test_a_null_hashes_each_number_once_for_all_units(spark, monkeypatch):
    sizes = {"a": [5, 9, 30], "b": [17], None: [3], "c": [1, 70, 2, 8, 4]}
    counts = spark.createDataFrame([(u, 10 * k, n) for u, ns in sizes.items() for k, n in enumerate(ns)], "u string, frame int, n long")
    frames = spark.createDataFrame([(10 * k, [float(k * k), -1.5 * k]) for k in range(5)], "frame int, pixels array<double>")
    monkeypatch.setattr(rf, "BLOCK", 13)
    out = {(r.u, r.pixel): (r.null_mean, r.null_std) for r in rf.resampled_null(counts, frames, ["u"], 7, 3).collect()}
    told = {}
    for u, ns in sizes.items():
        if u is not None:
            means = []
            for rep in range(7):
                at = np.array([int(int(hashlib.md5(f"3:{rep}:{s}".encode()).hexdigest()[:8], 16) / 2**32 * len(ns)) for s in range(sum(ns))])
                means.append([np.mean(at**2), np.mean(-1.5 * at)])
            told |= {(u, p): (pytest.approx(np.mean(m)), pytest.approx(np.std(m, ddof=1), abs=1e-12)) for p, m in enumerate(zip(*means, strict=True))}
    assert out == told


def test_a_null_makes_no_row_for_a_draw(spark):
    counts = spark.range(20).select((F.col("id") % 2).alias("u"), F.col("id").alias("frame"), F.lit(1000).cast("long").alias("n"))
    frames = spark.range(20).select(F.col("id").alias("frame"), F.array(F.lit(1.0)).alias("pixels"))
    plan = rf.resampled_null(counts, frames, ["u"], 30)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "md5" not in plan and "strategy=merge" in plan


def test_sums_by_nodes_are_those_of_pairs():
    rng = np.random.default_rng(4)
    for start, sigma, reach in ((0.0, 7200.0, 28_800.0), (1.7e9, 0.25, 1.0), (-50.0, 0.02, 0.5)):
        t = np.round(start + rng.uniform(0, 12 * reach, 3000), 6)
        at = np.concatenate([t[:40] + reach, t[:40] - reach, start + rng.uniform(-2 * reach, 14 * reach, 400)])
        spikes = Spikes(t, sigma, reach)
        told = np.array([np.exp(-((x - p) ** 2) / (2 * sigma**2)).sum() for p in at for x in [t[(t >= p - reach) & (t <= p + reach)]]])
        low, high = (np.searchsorted(spikes.t, at + r, side) for r, side in ((-reach, "left"), (reach, "right")))
        np.testing.assert_allclose(spikes._by_nodes(at, low, high), told, atol=1e-10)
        np.testing.assert_allclose(spikes._direct(at, low, high - low), told, atol=1e-10)
        np.testing.assert_allclose(spikes.sums(at), told, atol=1e-10)
    assert Spikes(np.empty(0), 1.0, 2.0).sums(np.array([1.0, 2.0])).tolist() == [0.0, 0.0]


def test_responses_around_triggers_make_no_pairs(spark):
    rng = np.random.default_rng(5)
    fired = [("a", round(float(t), 6)) for t in rng.uniform(-5, 25, 4000)] + [("b", 3.0), ("b", None), (None, 1.0)]
    shown = [("a", round(float(t), 6)) for t in rng.uniform(0, 20, 50)] + [("a", fired[0][1] - 1.5), ("a", fired[0][1] - 1.5), ("b", 2.0), ("b", 400.0), ("c", 1.0), ("c", None), (None, 1.0)]
    sigma, reach = 0.5, 2.0
    out = rates.mean_response(spark.createDataFrame(fired, "u string, t double"), spark.createDataFrame(shown, "u string, t0 double"), ["u"], 1.0, 1.5, 2.0, sigma, reach)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "_bucket" not in plan
    mine = {(r.u, r.step): (r.rate, r.n_triggers) for r in out.collect()}
    scale = 1 / (sigma * math.sqrt(2 * math.pi) * math.erf(reach / (sigma * math.sqrt(2))))
    told = {}
    for u in "abc":
        t, t0 = (np.array([x for k, x in rows if k == u and x is not None]) for rows in (fired, shown))
        for k in range(-2, 4):
            d = t[None, :] - (t0 + k / 2)[:, None]
            told[u, k] = (pytest.approx((np.exp(-(d**2) / (2 * sigma**2)) * (np.abs(d) <= reach)).sum() / len(t0) * scale, abs=1e-9), len(t0))
    assert mine == told


def test_redrawn_fits_stay_in_their_task(spark):
    rng = np.random.default_rng(6)
    cells = [(k, i, round(float(v), 6)) for k, n in (("a", 11), ("b", 11), ("c", 4), ("d", 25)) for i, v in enumerate(rng.normal(size=n) + np.arange(n) * (k == "d"))]
    cells += [("e", 1, 2.0), ("f", 3, 1.0), ("f", 3, 2.0), ("g", 1, 5.0), ("g", 2, 5.0), ("g", 3, 5.0), (None, 1, 1.0), (None, 2, 3.0), ("a", None, 9.0)]
    cells += [("h", x, y) for x, y in ((1, 1.37), (2, None), (5, 2.51), (11, 0.53), (23, 7.91), (40, 3.3))]
    df = spark.createDataFrame(cells, "u string, x int, y double")
    for strict in (True, False):
        out = tuning.shuffled_fits(df, ["u"], "x", "y", 40, 2, strict)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Join" not in plan and "Generate" not in plan
        mine = {r.u: (r.r2, r.slope, r.n, r.p) for r in out.collect()}
        told = {}
        for u in "abcdefgh":
            own = sorted(((x, y) for k, x, y in cells if k == u and x is not None), key=lambda c: (c[0], c[1] is not None, c[1]))
            n = len(own)
            drawn = tuning.draw_indices(np.arange(40)[:, None], np.arange(n)[None, :], n, 2)
            fits = [_r2([(own[i][0], own[j][1]) for i, j in enumerate(row)]) for row in drawn.tolist()]
            real = _r2(own)
            # Fits that are equal but for their last bits, as of the same values backwards, fall to either side.
            shares = [sum(f is not None and f > real + by for f in fits) / 40 for by in (1e-12, -1e-12)] if real is not None else None
            told[u] = (None if real is None else pytest.approx(real), n, shares)
        assert {u: (r2, n) for u, (r2, _, n, _) in mine.items()} == {u: t[:2] for u, t in told.items()}
        for u, (*_, p) in mine.items():
            assert p is None if told[u][2] is None else told[u][2][0] <= p <= told[u][2][1]
        assert all(told[u][2][0] == told[u][2][1] for u in "abdh") and mine["g"][3] == (0.0 if strict else 1.0)
    assert mine["d"][1] == pytest.approx(np.polyfit(range(25), [y for k, _, y in cells if k == "d"], 1)[0])


def _r2(pairs):
    x, y = np.array([c for c in pairs if c[1] is not None], float).reshape(-1, 2).T
    if len(x) == 0 or np.ptp(x) == 0:
        return None
    return 1.0 if np.ptp(y) == 0 else float(np.corrcoef(x, y)[0, 1] ** 2)


def test_draws_of_arrays_are_those_of_columns(spark):
    df = spark.range(60).select((F.col("id") % 10).alias("rep"), F.floor(F.col("id") / 10).alias("i"))
    out = {(r.rep, r.i): r.j for r in df.withColumn("j", tuning.draw_index(F.col("rep"), F.col("i"), F.lit(6), 3)).collect()}
    told = tuning.draw_indices(np.arange(10)[:, None], np.arange(6)[None, :], 6, 3)
    assert out == {(rep, i): int(told[rep, i]) for rep in range(10) for i in range(6)}
