"""Hand-made cases of operators, and comparisons with plain Python and numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.functions import basis, tails
from trialspark.operators import anatomy, glm, intervals, rates, rf, segment, select, signals, stats, tuning
from trialspark.sources import readers, writers


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_islands_touching_both_ends_and_none(spark):
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate([True, True, False, True])] + [(2, 0, False)] + [(3, i, None) for i in range(2)], "k int, i long, f boolean")
    assert rows(segment.islands(df, ["k"], "i", F.col("f")), "k", "start") == [(1, 1, 0, 1, 2), (1, 2, 3, 3, 1)]
    assert [r[-1] for r in rows(segment.edges(df, ["k"], "i", F.col("f")).select("k", "i", "edge"), "k", "i")] == [-1, 1]


def test_run_of_exactly_the_least_duration_stays(spark):
    df = spark.createDataFrame([(1, i, i in (1, 2, 3, 6, 7)) for i in range(9)], "k int, i long, f boolean")
    out = segment.flag_runs(df, ["k"], "i", F.col("f"), "still", 0.2, 10.0)
    assert [r.i for r in out.filter("still").orderBy("i").collect()] == [1, 2, 3]


def test_motion_bouts_true_start(spark):
    df = spark.createDataFrame([(1, i, i >= 2, i >= 2) for i in range(5)] + [(2, i, i >= 2, i >= 1) for i in range(5)], "k int, i long, moving boolean, inside boolean")
    out = segment.bouts(df, ["k"], "i", F.col("moving"), 10.0, F.col("inside"))
    assert [(r.k, r.start, r.end, r.duration) for r in out.collect()] == [(2, 2, 4, 0.2)]


@pytest.mark.parametrize(("closed", "n"), [("left", 2), ("both", 3), ("neither", 1)])
def test_spikes_on_window_edges(spark, closed, n):
    spikes = spark.createDataFrame([(1, t) for t in (0.0, 1.0, 2.0)], "k int, t double")
    windows = spark.createDataFrame([(1, 7, 0.0, 2.0)], "k int, w int, w0 double, w1 double")
    out = intervals.window_rates(spikes, windows, ["k"], ["w"], 0.5, closed).collect()[0]
    assert (out.n_spikes, out.dt) == (n, 2.0)


def test_unit_without_spikes_has_rate_zero(spark):
    spikes = spark.createDataFrame([], "k int, t double")
    windows = spark.createDataFrame([(1, 7, 0.0, 2.0)], "k int, w int, w0 double, w1 double")
    assert intervals.window_rates(spikes, windows, ["k"], ["w"], 1.0).collect()[0].rate == 0


def test_smoothed_mean_integrates_to_the_count(spark):
    spikes = spark.createDataFrame([(1, t) for t in (3.0, 5.0, 5.5)], "k int, t double")
    windows = spark.createDataFrame([(1, 0.0, 10.0)], "k int, w0 double, w1 double")
    assert rates.smoothed_means(spikes, windows, ["k"], [], 1.0).collect()[0].rate == pytest.approx(0.3, abs=1e-9)


def test_smoothed_mean_near_a_dense_trace(spark):
    rng = np.random.default_rng(1)
    t = np.sort(rng.uniform(0, 10, 200))
    spikes = spark.createDataFrame([(1, float(x)) for x in t], "k int, t double")
    windows = spark.createDataFrame([(1, 2.0, 3.0), (1, 6.0, 6.5)], "k int, w0 double, w1 double")
    grid = np.arange(0, 10, 1e-4)
    dense = np.exp(-((grid[:, None] - t) ** 2) / (2 * 0.02**2)).sum(1) / (0.02 * math.sqrt(2 * math.pi))
    mask = (grid >= 2) & (grid < 3) | (grid >= 6) & (grid < 6.5)
    assert rates.smoothed_means(spikes, windows, ["k"], [], 1.0).collect()[0].rate == pytest.approx(dense[mask].mean(), rel=2e-3)


def test_hazen_percentile(spark):
    df = spark.createDataFrame([(1, v) for v in (1.0, 2.0, 3.0, 10.0)], "k int, v double")
    assert [r.value for r in stats.hazen(df, ["k"], "v", [0, 25, 50, 100]).orderBy("prc").collect()] == [1.0, 1.5, 2.5, 10.0]


def test_signed_rank_exact_zero_and_null_pairs(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0), (1, 2.0, 0.0), (1, 3.0, 0.0), (1, 4.0, 4.0), (1, None, 1.0), (2, 1.0, 1.0)], "k int, x double, y double")
    out = {r.k: r for r in stats.signed_rank(df, ["k"], "x", "y").collect()}
    assert (out[1].n, out[1].n_used, out[1].w_plus, out[1].p) == (4, 3, 6.0, 0.25)
    assert (out[2].n_used, out[2].p, out[2].direction) == (0, 1.0, 0)


def test_signed_rank_with_ties_against_all_signs(spark):
    d = [1.0, 1.0, -2.0, 3.0, 3.0, -3.0, 4.0]
    df = spark.createDataFrame([(1, v, 0.0) for v in d], "k int, x double, y double")
    out = stats.signed_rank(df, ["k"], "x", "y").collect()[0]
    ranks = [1.5, 1.5, 3, 5, 5, 5, 7]
    sums = [sum(r for j, r in enumerate(ranks) if i >> j & 1) for i in range(128)]
    w = sum(r for r, v in zip(ranks, d, strict=True) if v > 0)
    assert out.w_plus == w
    assert out.p == pytest.approx(min(1, 2 * min(sum(s <= w for s in sums), sum(s >= w for s in sums)) / 128))


def test_tail_probabilities():
    assert tails.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert tails.chi2_upper(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert tails.chi2_upper(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.f_upper(4.256495, 2, 9) == pytest.approx(0.05, abs=1e-6)
    assert tails.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.studentized_range_upper(3.314, 3, math.inf) == pytest.approx(0.05, abs=2e-3)
    assert tails.studentized_range_upper(3.877, 3, 10) == pytest.approx(0.05, abs=3e-3)


def test_nearest_takes_the_lower_of_equals(spark):
    points = spark.createDataFrame([(1, 5, 2.0), (1, 6, -9.0), (2, 7, 0.0)], "k int, id int, at double")
    targets = spark.createDataFrame([(1, 1.0, "a"), (1, 3.0, "b")], "k int, place double, name string")
    assert rows(intervals.nearest(points, targets, ["k"], "at", "place").select("id", "near_name"), "id") == [(5, "a"), (6, "a"), (7, None)]


def test_interpolation_inside_on_and_outside(spark):
    samples = spark.createDataFrame([(1, 0.0, 0.0), (1, 2.0, 4.0)], "k int, t double, v double")
    events = spark.createDataFrame([(1, x) for x in (-1.0, 0.0, 1.0, 2.0, 3.0)], "k int, t double")
    inner = [r.value_at for r in intervals.interpolated(events, samples, ["k"], "t", "v").orderBy("t").collect()]
    outer = [r.value_at for r in intervals.interpolated(events, samples, ["k"], "t", "v", extrapolate=True).orderBy("t").collect()]
    assert inner == [None, 0.0, 2.0, 4.0, None]
    assert outer == [-2.0, 0.0, 2.0, 4.0, 6.0]


def test_replay_with_none_one_and_two_originals(spark):
    df = spark.createDataFrame([(1, 1, "a", False), (1, 2, "a", True), (1, 3, "b", True), (1, 4, "c", False), (1, 5, "c", False), (1, 6, "c", True)], "s int, trial int, name string, replay boolean")
    assert rows(intervals.replayed_originals(df, ["s"], "name", "replay", "trial").select("trial", "original"), "trial") == [(1, None), (2, 1), (3, None), (4, None), (5, None), (6, None)]


def test_lag_of_a_shifted_replay(spark):
    v = np.random.default_rng(3).normal(size=200)
    original = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "k int, i int, v double")
    replay = spark.createDataFrame([(1, i + 7, float(x)) for i, x in enumerate(v)], "k int, i int, v double")
    assert segment.best_lag(original, replay, ["k"], "i", "v", list(range(-10, 11))).collect()[0].lag == 7


def test_maximum_is_in_no_bin(spark):
    df = spark.createDataFrame([(1, float(v)) for v in range(10)], "k int, v double")
    bins = tuning.equal_population_bins(df, ["k"], "v", 5)
    assert bins.count() == 5
    assert tuning.binned(df, bins, ["k"], "v").agg(F.max("v")).collect()[0][0] == 8.0


def test_selected_model_is_the_one_that_made_the_data(spark):
    x = np.linspace(0, 10, 20)
    data = {1: 3 + 2 * np.exp(-((x - 4) ** 2) / (2 * 1.2**2)), 2: 1 + 4 / (1 + np.exp(-(x - 5) / 0.7))}
    df = spark.createDataFrame([(k, float(a), float(b)) for k, y in data.items() for a, b in zip(x, y, strict=True)], "k int, x double, y double")
    best = {r.k: r for r in tuning.selected_models(df, ["k"], "x", "y").filter("best").collect()}
    assert best[1].model in ("gaussian", "asymmetric") and best[1].r2 > 0.999
    assert best[2].model == "sigmoid" and best[2].r2 > 0.999
    assert tuning.selected_models(df.filter("x < 1"), ["k"], "x", "y").count() == 0


def test_poisson_fit_finds_its_coefficients():
    rng = np.random.default_rng(5)
    x = np.c_[np.ones(4000), rng.normal(size=4000)]
    y = rng.poisson(np.exp(x @ [0.5, 0.8]) * 0.5).astype(float)
    fit = glm.Fit(x, y, np.full(4000, math.log(0.5)))
    assert fit.beta == pytest.approx([0.5, 0.8], abs=0.06)


def test_forward_selection_takes_the_term_that_matters(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=600), rng.normal(size=600)
    y = rng.poisson(np.exp(0.5 + 0.9 * a))
    df = spark.createDataFrame([(1, i, float(p), float(q), int(n), 1.0, i % 5) for i, (p, q, n) in enumerate(zip(a, b, y, strict=True))], "k int, i int, a double, b double, spike_count int, dt double, fold int")
    assert [r.term for r in glm.forward_selected(df, ["k"], ["i"], ["a", "b"], {}).orderBy("step").collect()] == [None, "a"]


def test_raised_cosines(spark):
    out = spark.range(1).select(basis.raised_cosine(F.lit(0.5), 3, 0.5, 7.5).alias("a"), basis.onset_kernel(F.lit(-0.1), 3, 1.0).alias("b"), basis.products(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(5.0))).alias("c"), basis.dummies(F.lit("y"), ["x", "y", "z"]).alias("d")).collect()[0]
    assert out.a == pytest.approx([1.0, 0.25, 0.0]) and out.b == [0, 0, 0] and out.c == [3, 5, 6, 10] and out.d == [1, 0]


def test_receptive_field_of_a_planted_patch(spark):
    cells = spark.createDataFrame([(s, c, 1) for s in range(64) for c in range(16) if (s * 7 + c * 5) % 4 == 0], "stim int, cell int, polarity int")
    shown = {(r.stim, r.cell) for r in cells.collect()}
    counts = spark.createDataFrame([(1, s, int(10 * sum((s, c) in shown for c in (0, 1, 4, 5)))) for s in range(64)], "k int, stim int, n int")
    sta = rf.sparse_average(counts, cells, ["k"])
    null = rf.permutation_null(counts, cells, ["k"], 30)
    assert null.count() == 16
    masks = rf.field_masks(sta.withColumn("sta", F.when(F.col("cell").isin(0, 1, 4, 5), 100.0).otherwise(0.0)), null, ["k"], 4)
    assert {r.cell for r in masks.collect()} == {0, 1, 4, 5}
    size = rf.field_sizes(masks, ["k"], 4).collect()[0]
    assert (size.width, size.height) == (10.0, 10.0)


def test_zero_phase_filter_keeps_slow_and_removes_fast(spark):
    n, rate = 400, 1000.0
    t = np.arange(n) / rate
    slow, fast = np.sin(2 * math.pi * 5 * t), np.sin(2 * math.pi * 300 * t)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(slow + fast)], "k int, i int, v double")
    out = np.array([r.filtered for r in signals.low_pass(df, ["k"], "i", "v", rate).orderBy("i").collect()])
    assert np.abs(out - slow)[50:-50].max() < 0.02


def test_band_power_of_a_sine(spark):
    rate = 10_000.0
    df = spark.createDataFrame([(1, i, float(2 * math.sin(2 * math.pi * 1000 * i / rate))) for i in range(2000)], "k int, i int, v double")
    assert signals.band_power(df, ["k"], "i", "v", rate).collect()[0].power == pytest.approx(2.0, rel=1e-2)


def test_stimulus_onsets_alternate_with_dead_time(spark):
    v = [0, 5, 0, 5, 5, 0, 0, 5]
    df = spark.createDataFrame([(1, float(i), float(x)) for i, x in enumerate(v)], "k int, t double, v double")
    out = signals.stimulus_onsets(df, ["k"], "t", "v", 1.0, 4.0, 2.0).orderBy("onset").collect()
    assert [(r.onset, r.edge) for r in out] == [(1.0, 1), (5.0, -1), (7.0, 1)]


def test_batches_that_fit(spark):
    out = spark.createDataFrame([(70.0,), (69.0,), (700.0,)], "d double").select(signals.batch_starts(F.col("d")).alias("s")).collect()
    assert [r.s for r in out] == [[60.0], [], [60.0, 360.0, 660.0]]


def test_labels_and_selection(spark):
    trials = spark.createDataFrame([("passive", "StageOnly", True, None, None, None), ("head_tilt_mice", "ReplayOnly", None, None, None, None), ("sparse_noise", "x", None, None, None, None)], "session_protocol string, protocol string, visual boolean, replay_of string, gain_direction string, trial_sequence int")
    assert [r.label for r in trials.select(select.label_column().alias("label")).collect()] == ["VT", "V", None]
    votes = spark.createDataFrame([(1, "b", "b"), (2, "b", None), (3, "g", "g")], "id int, a string, b string")
    assert rows(select.curated(votes, ["a", "b"]).select("id"), "id") == [(2,), (3,)]
    assert rows(select.curated(votes, ["a", "b"], "any").select("id"), "id") == [(3,)]
    names = spark.createDataFrame([("theta0p785_SF0p08_VX1p4",), ("none",)], "n string").select(*(c.alias(k) for k, c in select.parsed_name(F.col("n")).items())).collect()
    assert tuple(names[0]) == (0.08, 1.4, 0.785) and tuple(names[1]) == (None, None, None)


def test_region_that_occurs_twice_has_no_relative_depth(spark):
    bands = spark.createDataFrame([(1, "L2", 0.0, 10.0), (1, "L4", 10.0, 20.0), (1, "L2", 20.0, 30.0)], "k int, region string, lower double, upper double")
    units = spark.createDataFrame([(1, 1, 15.0), (1, 2, 5.0), (1, 3, 30.0)], "k int, id int, from_tip double")
    assert rows(anatomy.relative_depths(units, bands, ["k"]).select("id", "region", "relative"), "id") == [(1, "L4", 0.5), (2, "L2", None), (3, None, None)]


def test_average_anatomy_fills_missing_layers(spark):
    layers = spark.createDataFrame([("p", "L1", 100.0), ("q", "L1", 200.0), ("p", "L2", 50.0)], "probe_id string, layer string, thickness double")
    defaults = spark.createDataFrame([("L1", 80.0, 1), ("L2", 70.0, 2)], "layer string, thickness double, place int")
    assert rows(anatomy.average_anatomy(layers, defaults).select("layer", "thickness", "upper", "lower"), "layer") == [("L1", 150.0, 0.0, 150.0), ("L2", 60.0, 150.0, 210.0)]


def test_recording_config_and_array_readers(spark, tmp_path):
    raw = np.arange(-6, 6, dtype="<i2").reshape(-1, 3)
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin/a.bin").write_bytes(raw.tobytes())
    out = readers.recording(spark, str(tmp_path / "bin"), 3, 2).orderBy("sample_idx").collect()
    assert [r["values"] for r in out] == raw.tolist()
    assert spark.range(1).select(readers.volts(F.lit(0)).alias("v")).collect()[0].v == 0.0
    (tmp_path / "cfg").mkdir()
    (tmp_path / "cfg/a.cfg").write_text("a = 1\nb = x = y\n\n\n\nc = 3\n")
    assert [r.config for r in readers.config_blocks(spark, str(tmp_path / "cfg")).orderBy("block").collect()] == [{"a": "1", "b": "x = y"}, {"c": "3"}]
    (tmp_path / "npy").mkdir()
    np.save(tmp_path / "npy/t.npy", np.array([3, 1, 2]))
    assert [r.value for r in readers.arrays(spark, str(tmp_path / "npy")).orderBy("idx").collect()] == [3.0, 1.0, 2.0]
    meta = spark.createDataFrame([("f", {"~imroTbl": "(21,384)(0 1 0 0 7)(1 0 0 0 9)"})], "file string, config map<string,string>")
    assert rows(readers.channel_map(meta).select("channel", "shank", "electrode"), "channel") == [(0, 1, 7), (1, 0, 9)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "p", [1.0, 2.0]), (2, "q", [])], "id int, probe string, a array<double>")
    writers.save(df, str(tmp_path / "t"), by="probe")
    with pytest.raises(Exception, match="exists"):
        writers.save(df, str(tmp_path / "t"))
    writers.replace_parts(df.filter("id = 1").withColumn("id", F.lit(9)), str(tmp_path / "t"), "probe")
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [2, 9]
    writers.save_csv(df, str(tmp_path / "c"), {"id": "number"})
    assert sorted(r.number for r in readers.table(spark, str(tmp_path / "c"), "number int, probe string, a string").collect()) == [1, 2]
    writers.save_ids(df, str(tmp_path / "i"), "id")
    assert sorted(r.value for r in readers.single_values(spark, str(tmp_path / "i")).collect()) == [1.0, 2.0]


def test_analysis_windows(spark):
    facts = spark.createDataFrame([(1, "closed", 10.0, 20.0, None, None), (2, "mismatch", 10.0, 20.0, 14.0, None), (3, "replay", None, 5.0, None, 30.0), (4, "replay", None, 5.0, None, 6.0)], "id int, kind string, gate_low double, gate_high double, mismatch_on double, travel_end_t double")
    out = segment.analysis_windows(facts).select("id", F.round("w0", 6), F.round("w1", 6))
    assert sorted(map(tuple, out.collect())) == [(1, 7.0, 10.0), (1, 10.2, 19.45), (2, 7.0, 14.0), (2, 17.0, 19.45), (3, 5.2, 30.0), (4, 5.2, 6.0), (4, 7.0, 9.0)]


def test_animal_ids(spark):
    out = spark.createDataFrame([("A1_rec1",), ("B_7_1_rec1",)], "n string").select(select.animal_id(F.col("n"), ("B_7_1_rec1",)).alias("a")).collect()
    assert [r.a for r in out] == ["A1", "B_7_1"]
