"""Values worked out by hand from the definitions: widths of bases, fits to cells, patches, signal to noise, intervals."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.functions import basis
from trialspark.operators import rates, rf, stats, tuning


def test_bumps_are_one_and_a_half_spacings_wide(spark):
    u = F.lit(0.4)
    out = spark.range(1).select(basis.onset_kernel(u, 3, 1.0).alias("a"), basis.onset_kernel(u, 1, 2.0).alias("b"), basis.onset_kernel(F.lit(0.0), 3, 1.0).alias("c")).first()
    bump = lambda d, w: 0.5 * (1 + math.cos(math.pi * d / w))
    assert out.a == pytest.approx([bump(0.4, 0.75), bump(0.1, 0.75), bump(0.6, 0.75)])
    assert out.b == pytest.approx([bump(0.4, 3.0)]) and out.c == pytest.approx([1.0, bump(0.5, 0.75), 0.0])
    one = spark.range(1).select(basis.raised_cosine(F.lit(1.5), 1, 0.5, 7.5).alias("a")).first().a
    assert one == pytest.approx([bump(math.log(2.0), 1.5 * math.log(8.0))])


def test_models_are_fitted_to_cells_and_chosen_by_means(spark):
    cells = [(1, x, y) for x, ys in ((0.0, (0.0, 2.0)), (1.0, (2.0, 2.0)), (2.0, (1.0, 5.0)), (3.0, (4.0,))) for y in ys]
    df = spark.createDataFrame(cells, "k int, x double, y double")
    r = tuning.selected_models(df, ["k"], "x", "y", ("linear",)).first()
    x, y = np.array([c[1] for c in cells]), np.array([c[2] for c in cells])
    a, b = np.polyfit(x, y, 1)
    sse, n = ((y - a * x - b) ** 2).sum(), len(y)
    means, at = np.array([1.0, 2.0, 3.0, 4.0]), np.arange(4.0)
    assert r.parameters == pytest.approx([a, b]) and r.r2 == pytest.approx(1 - sse / ((y - y.mean()) ** 2).sum())
    assert r.mean_r2 == pytest.approx(1 - ((means - a * at - b) ** 2).sum() / ((means - means.mean()) ** 2).sum())
    assert r.log_likelihood == pytest.approx(-n / 2 * (math.log(2 * math.pi * sse / n) + 1)) and r.bic == pytest.approx(2 * math.log(n) - 2 * r.log_likelihood)


@pytest.mark.parametrize("model", tuning.MODELS)
def test_rows_fitted_together_are_fitted_as_well_as_one_by_one(model):
    rng = np.random.default_rng(4)
    x = np.repeat(np.linspace(0, 5, 8), 3)
    ys = np.stack([rng.normal(size=24) + k * np.exp(-((x - 2) ** 2)) for k in range(12)])
    alone = np.array([((y - tuning._shape(model, tuning._fit(model, x, y), x)) ** 2).sum() for y in ys])
    assert tuning._fit_rows(model, x, ys) == pytest.approx(alone, rel=1e-4)


def test_p_counts_redrawn_cells_fitted_as_well(spark):
    rows = [(k, b, float(b), (3.0 * b if k == 1 else ((b * 7 + t * 5) % 4)) + 0.01 * t) for k in (1, 2) for b in range(8) for t in range(3)]
    df = spark.createDataFrame(rows, "k int, bin int, x double, y double")
    best = tuning.selected_models(df, ["k"], "x", "y", ("linear",))
    p = {r.k: r.p for r in tuning.model_p(df, best, ["k"], "bin", "x", "y", 200, 4).collect()}
    assert p[1] == 0 and p[2] > 0.05


def test_patches_touch_at_corners(spark):
    diagonal = [0, 5, 10, 15]  # of four columns
    cells = spark.createDataFrame([(1, c, 1, 9.0 if c in diagonal or c == 3 else 0.0) for c in range(16)], "k int, cell int, polarity int, sta double")
    null = spark.createDataFrame([(1, c, 1, 0.0, 1.0) for c in range(16)], "k int, cell int, polarity int, null_mean double, null_std double")
    assert sorted(r.cell for r in rf.field_masks(cells, null, ["k"], 4).collect()) == diagonal


def test_the_best_lag_is_by_the_greatest_value_over_the_nulls_deviation(spark):
    sta = spark.createDataFrame([(1, lag, p, v) for lag, vs in ((0, (5.0, 5.5)), (50, (-8.0, 1.0))) for p, v in enumerate(vs)], "u int, lag int, pixel int, sta double")
    r = rf.best_lags(sta, ["u"]).first()
    assert (r.lag, r.snr) == (0, pytest.approx(5.5 / (0.5 / math.sqrt(2))))
    null = spark.createDataFrame([(1, 0, 0, 2.0), (1, 0, 1, 4.0), (1, 50, 0, 1.0), (1, 50, 1, 1.0)], "u int, lag int, pixel int, null_std double")
    r = rf.best_lags(sta, ["u"], null=null).first()
    assert (r.lag, r.snr) == (50, pytest.approx(8.0))


def test_short_gaps_are_counted_with_all_others(spark):
    df = spark.createDataFrame([(1, t) for t in (0.0, 0.001, 0.1, 0.5, 1.0)], "k int, t double")
    r = stats.isi_violations(df, ["k"], "t", 0.0015, 0.0005).first()
    rate = (1 / (2 * 5 * 0.001)) / (5 / 1.0)
    assert (r.n, r.violations, r.fp_rate) == (5, 1, pytest.approx(rate))
    assert stats.isi_violations(df, ["k"], "t", 0.0015, 0.0005, corrected=True).first().fp_rate == 1.0
    slow = spark.createDataFrame([(1, float(t)) for t in range(200)] + [(1, 0.001)], "k int, t double")
    rate = (1 / (2 * 201 * 0.001)) / (201 / 199)
    told = stats.isi_violations(slow, ["k"], "t", 0.0015, 0.0005, corrected=True).first().fp_rate
    assert told == (pytest.approx((1 - math.sqrt(1 - 4 * rate)) / 2) if rate < 0.25 else 1.0)


def test_mean_speed_in_a_place_is_weighted_by_time(spark):
    samples = spark.createDataFrame([(1, 0.5, 1.0, 10.0), (1, 1.5, 3.0, 2.0), (1, 1.0, 4.0, None)], "k int, place double, dt double, speed double")
    spikes = spark.createDataFrame([(1, 7, 0.2)], "k int, unit int, place double")
    r = rates.spatial_map(spikes, samples, ["k"], "unit", 2.0, "dt", "speed").first()
    assert (r.occupancy, r.mean_speed, r.rate) == (8.0, pytest.approx(4.0), pytest.approx(1 / 8))


def test_a_null_deals_each_spike_to_one_frame(spark):
    counts = spark.createDataFrame([(1, f, n) for f, n in ((10, 3), (11, 1), (12, 4))], "u int, frame int, n long")
    frames = spark.createDataFrame([(f, [1.0 if f == g else 0.0 for g in (10, 11, 12)] + [1.0]) for f in (10, 11, 12)], "frame int, pixels array<double>")
    out = {r.pixel: (r.null_mean, r.null_std) for r in rf.resampled_null(counts, frames, ["u"], 300).collect()}
    assert out[3] == (1.0, 0.0)  # each repetition deals all spikes
    assert all(out[p][0] == pytest.approx(1 / 3, abs=0.05) and out[p][1] == pytest.approx(math.sqrt(2 / 9 / 8), abs=0.03) for p in range(3))
