"""Operators that no query runs, each on a few hand-made rows."""

import pytest
from pyspark.sql import functions as F

from trialspark.operators import anatomy, glm, rates, rf, segment, select, signals, stats, tuning
from trialspark.sources import readers


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_good_units_pass_every_limit_and_have_the_group(spark):
    units = spark.createDataFrame([(k,) for k in range(5)], "cluster_id int")
    metrics = spark.createDataFrame([(0, 0.05, 30.0, 0.05, 0.1), (1, 0.5, 30.0, 0.05, 0.1), (2, 0.05, 10.0, 0.05, 0.1), (3, 0.05, 30.0, 0.05, 0.1)], "cluster_id int, isi_viol double, isolation_distance double, amplitude_cutoff double, max_drift double")
    groups = spark.createDataFrame([(0, "good"), (1, "good"), (2, "good"), (3, "mua")], "cluster_id int, group string")
    limits = {c: x for c, x in select.QUALITY.items() if c in metrics.columns}
    assert rows(select.good_units(units, metrics, groups, ["cluster_id"], limits), "cluster_id") == [(0,)]
    assert rows(select.good_units(units, metrics, groups, ["cluster_id"], limits, "mua"), "cluster_id") == [(3,)]


def test_cleansing_rules_drop_renumber_and_relabel(spark):
    trials = spark.createDataFrame([("a", 1, "V"), ("a", 2, "V"), ("b", 1, "T")], "session_id string, trial_id int, label string")
    rules = spark.createDataFrame([("a", 1, True, None, None), ("a", 2, False, None, "VT"), ("b", None, False, 10, None)], "session_id string, trial_id int, drop boolean, id_offset int, new_label string")
    assert rows(select.cleansed(trials, rules), "session_id", "trial_id", "label") == [("a", 2, "VT"), ("b", 11, "T")]


def test_rescaled_channel_of_named_sessions_only(spark):
    samples = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "session_id string, stage double")
    rules = spark.createDataFrame([("b", 3.0, 0.5)], "session_id string, scale double, shift double")
    assert rows(select.rescaled(samples, rules, "stage"), "session_id", "stage") == [("a", 1.0), ("b", 6.5)]


def test_region_mapping_velocity_and_names(spark):
    units = spark.createDataFrame([("VISp5",), ("CA1",)], "region string")
    mapping = spark.createDataFrame([("VISp5", "VISp"), ("CA1", "NaN")], "subregion string, parent_region string")
    assert rows(select.subregions(units, mapping, "VISp"), "region") == [("VISp5",)]
    v = spark.createDataFrame([("EncoderOnly", 1.0, 2.0, 3.0), ("Coupled", 1.0, 2.0, 3.0), ("ReplayOnly", 1.0, 2.0, None), ("ReplayOnly", 1.0, 2.0, 3.0)], "p string, t double, s double, v double")
    assert [r[0] for r in v.select(select.chosen_velocity(F.col("p"), F.col("t"), F.col("s"), F.col("v"))).collect()] == [1.0, 2.0, 2.0, 3.0]
    assert [r[0] for r in v.select(select.spiking_class(F.col("t") / 4), select.in_region(F.lit("VISp5"))).collect()][0] == "narrow"


def test_motion_flags_everything_but_long_calm_runs(spark):
    speed = [0.0] * 30 + [5.0] * 10 + [0.0] * 3 + [5.0] * 5
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(speed)], "k int, i int, v double")
    moving = {r.i: r.moving for r in segment.motion(df, ["k"], "i", "v", 100.0).collect()}
    assert not any(moving[k] for k in range(28)) and all(moving[k] for k in range(30, 48))


def test_trials_between_falling_edges(spark):
    gate = [5.0] * 10 + [0.0] * 10 + [5.0] * 5 + [0.0] * 10
    rows_ = [(p, k, g) for p in ("Coupled", "ReplayOnly", "Whole") for k, g in enumerate(gate)]
    df = spark.createDataFrame([(p, p, k, g) for p, k, g in rows_], "session string, protocol string, sample_idx int, solenoid double")
    out = rows(segment.trials(df, ["session"], "solenoid", 1.0, ["Coupled"], ["Whole"]), "session", "trial_id", "start_idx", "end_idx")
    assert out == [("Coupled", 1, 6, 20), ("Coupled", 2, 21, 34), ("ReplayOnly", 1, 10, 24), ("ReplayOnly", 2, 25, 34), ("Whole", 1, 0, 34)]


def test_aligned_replay_has_the_shifted_partner(spark):
    replay = spark.createDataFrame([(1, k, float(k)) for k in range(6)], "t int, offset int, v double")
    original = spark.createDataFrame([(1, k, 10.0 * k) for k in range(3)], "t int, offset int, v double")
    out = segment.aligned(replay, original, spark.createDataFrame([(1, 2)], "t int, sample_offset int"), ["t"])
    assert rows(out, "offset", "v", "original_v") == [(0, 2.0, 0.0), (1, 3.0, 10.0), (2, 4.0, 20.0)]


def test_central_table_of_smoothed_rates(spark):
    spikes = spark.createDataFrame([(1, 7, 0.5 + k) for k in range(10)] + [(1, 8, 15.5)], "p int, unit int, t double")
    rest = spark.createDataFrame([(1, 1, 0.0, 10.0)], "p int, trial int, w0 double, w1 double")
    move = spark.createDataFrame([(1, 1, 10.0, 20.0)], "p int, trial int, w0 double, w1 double")
    out = {r.unit: r for r in rates.stationary_motion(spikes, rest, move, ["p"], "unit", ["trial"], 10.0).collect()}
    assert out[7].stationary_fr == pytest.approx(1.0) and out[7].motion_fr == pytest.approx(0.0) and out[7].stationary_time == 10
    assert out[8].stationary_fr == pytest.approx(0.0) and out[8].motion_fr == pytest.approx(0.1)


def test_merged_units_and_smoothed_bins(spark):
    spikes = spark.createDataFrame([(1, 7, 0.5), (1, 8, 0.6), (1, 9, 0.7)], "p int, unit int, t double")
    good = spark.createDataFrame([(1, 7), (1, 9)], "p int, unit int")
    assert rows(rates.merged_units(spikes, good, ["p"], "unit", -1), "unit", "t") == [(-1, 0.5), (-1, 0.7)]
    flat = spark.createDataFrame([(1, k, 2.0) for k in range(10)], "p int, bin int, rate double")
    assert all(r.smoothed == pytest.approx(2.0) for r in rates.smoothed_over_bins(flat, ["p"], "rate", 2.0, 8.0, 10).collect())
    peak = spark.createDataFrame([(1, k, float(k == 5)) for k in range(10)], "p int, bin int, rate double")
    out = {r.bin: r.smoothed for r in rates.smoothed_over_bins(peak, ["p"], "rate", 2.0, 2.0, 10).collect()}
    assert max(out, key=out.get) == 5 and out[4] == pytest.approx(out[6]) and sum(out.values()) == pytest.approx(1.0)


def test_subtracted_baseline(spark):
    df = spark.createDataFrame([(1, -1.0, 2.0), (1, -0.5, 4.0), (1, 0.5, 10.0)], "u int, lag double, v double")
    assert rows(rates.baseline_subtracted(df, ["u"], "lag", "v", (-1.0, 0.0)), "lag", "subtracted") == sorted([(-1.0, -1.0), (-0.5, 1.0), (0.5, 7.0)], key=str)


def test_tuning_curve_and_records(spark):
    samples = spark.createDataFrame([(1, 1, k, k * 0.1, 1.0 if k < 50 else 3.0) for k in range(100)], "p int, trial int, i int, t double, speed double")
    spikes = spark.createDataFrame([(1, 5.0 + 0.25 * k) for k in range(20)], "p int, t double")
    bins = spark.createDataFrame([(1, 1, 0.0, 2.0, 1.0), (1, 2, 2.0, 4.0, 3.0)], "p int, bin int, lo double, hi double, center double")
    curve = tuning.tuning_curve(spikes, samples, bins, ["p"], "trial", "speed", "i", "t", 0.1, 5.0, F.lit(True))
    out = {r.bin: (r.rate, r.dt) for r in curve.collect()}
    assert out[1] == (pytest.approx(0.1, abs=0.1), pytest.approx(5.0)) and out[2] == (pytest.approx(4.0, abs=0.2), pytest.approx(5.0))
    record = tuning.records(curve, bins, ["p"], "trial").collect()[0]
    assert [c.bin for c in record.tuning] == [1, 2] and [b.center for b in record.bins] == [1.0, 3.0]


def test_shuffle_envelope_of_a_constant(spark):
    cells = spark.createDataFrame([(1, b, 3.0) for b in (1, 2) for _ in range(5)], "u int, bin int, y double")
    assert rows(tuning.shuffle_envelope(cells, ["u"], "bin", "y", 20), "bin", "mean", "sd", "n") == [(1, 3.0, 0.0, 5.0), (2, 3.0, 0.0, 5.0)]


def test_classes_of_tuning_and_of_conditions(spark):
    fits = spark.createDataFrame([(0.01, 1.0, 5.0, 2.0), (0.01, -1.0, 1.0, 2.0), (0.2, 1.0, 5.0, 2.0)], "p double, slope double, rate double, rest double")
    assert [r["class"] for r in tuning.tuned_classes(fits, "rate", "rest").collect()] == ["excited_up", "suppressed_down", "untuned"]
    f = [(1, "V", "a", 0.5, 0.9, [1.0]), (1, "VT", "a", 0.5, 0.9, [1.0]), (2, "V", "a", 0.01, 0.9, [1.0]), (2, "VT", "a", 0.01, 0.5, [1.0]), (3, "V", "a", 0.01, 0.9, [1.0]), (3, "VT", "a", 0.01, 0.9, [1.1]), (4, "V", "a", 0.01, 0.9, [1.0]), (4, "VT", "a", 0.01, 0.9, [9.0]), (5, "V", "a", 0.01, 0.9, [1.0]), (5, "VT", "b", 0.01, 0.9, [1.0]), (6, "VT", "b", 0.01, 0.9, [1.0])]
    out = tuning.compared_conditions(spark.createDataFrame(f, "u int, condition string, model string, p double, r2 double, parameters array<double>"), ["u"])
    assert rows(out, "u", "comparison") == [(1, "neither"), (2, "V_only"), (3, "both_similar"), (4, "both_different_params"), (5, "both_different_model"), (6, "VT_only")]


def test_prefilter_profiles_curves_and_counts(spark):
    tests = spark.createDataFrame([(1, "T", 0.01), (1, "V", 0.01), (2, "T", 0.01), (3, "V", 0.01), (4, "VT", 0.01), (5, "V", 0.5)], "u int, condition string, p double")
    assert rows(glm.category(tests, ["u"]), "u", "category", "fit") == [(1, "T_and_V", True), (2, "T_only", True), (3, "V_only", True), (4, "VT_only", True), (5, "none", False)]
    bins = spark.createDataFrame([(1, t) for t in range(1, 7)], "u int, trial int")
    assert rows(glm.profile_generalisation(bins, ["u"], "trial"), "trial", "fold") == [(t, int(t > 3)) for t in range(1, 7)]
    fits = spark.createDataFrame([(1, "m", [0.0, 1.0])], "u int, model string, beta array<double>")
    out = rows(glm.model_curve(fits, ["u"], F.array("x"), [0.0, 1.0, 10.0]), "x", "rate")
    assert out == [(0.0, 1.0), (1.0, pytest.approx(2.718281828)), (10.0, 400.0)]
    chosen = spark.createDataFrame([(1, "speed"), (2, "speed"), (2, "tf"), (3, None)], "u int, term string")
    assert [tuple(r) for r in glm.encoded_counts(chosen, ["u"]).collect()] == [("speed", 2), ("tf", 1)]


def test_corrections(spark):
    df = spark.createDataFrame([(0.01,), (0.4,)], "p double")
    assert [r[0] for r in df.select(stats.bonferroni(F.col("p"), 5)).collect()] == [pytest.approx(0.05), 1.0]


def test_probe_geometry_templates_and_depths(spark):
    geometry = anatomy.electrode_geometry(spark, 8, 2, 20.0, [0.0, 16.0], 2)
    out = {r.electrode: (r.shank, r.row, r.column, r.x, r.from_tip) for r in geometry.collect()}
    assert out[0] == (0, 0, 0, 0.0, 0.0) and out[3] == (0, 1, 1, 16.0, 20.0) and out[4] == (1, 0, 0, 250.0, 0.0)
    along = anatomy.channels_along(geometry, spark.createDataFrame([(10, 3), (11, 0), (12, 1)], "channel int, electrode int"))
    assert rows(along, "channel", "place", "column_rank") == [(10, 3, 2), (11, 1, 1), (12, 2, 2)]
    templates = spark.createDataFrame([(1, 0, [0.0, 1.0]), (1, 1, [-2.0, 1.0]), (1, 2, [-2.0, 1.0])], "template_id int, channel_idx int, waveform array<double>")
    assert rows(anatomy.template_facts(templates), "template_id", "best_channel", "peak_to_peak") == [(1, 1, 3.0)]
    spikes = spark.createDataFrame([(1, 5), (1, 5), (1, 4), (2, 9), (2, 8)], "cluster_id int, template_id int")
    assert rows(anatomy.main_template(spikes, ["cluster_id"]), "cluster_id", "template_id") == [(1, 5), (2, 8)]
    average = spark.createDataFrame([("5", 100.0, 300.0)], "layer string, upper double, lower double")
    assert rows(anatomy.place_on_average(spark.createDataFrame([("5", 0.25)], "layer string, relative double"), average), "depth") == [(150.0,)]


def test_readers_of_metadata_ranges_and_sequences(spark, tmp_path):
    (tmp_path / "a.meta").write_text("fileName=x.bin\nnSavedChans=385\n~imroTbl=(0,384)(0 0 0 500 250)\n")
    meta = readers.probe_metadata(spark, str(tmp_path / "a.meta")).collect()[0]
    assert meta.config["nSavedChans"] == "385" and meta.config["fileName"] == "x.bin"
    samples = spark.range(100).withColumnRenamed("id", "sample_idx")
    assert [r.sample_idx for r in readers.time_range(samples, 10.0, 1.0, 1.5).orderBy("sample_idx").collect()] == [10, 11, 12, 13, 14]
    seq = spark.createDataFrame([("s", [3, 1])], "session_id string, sequence array<int>")
    assert rows(readers.sequence_of_stimuli(seq), "trial_id", "stim") == [(1, 3), (2, 1)]
    assert select.empty(spark, "a int, b string").columns == ["a", "b"]


def test_models_side_by_side(spark):
    fits = spark.createDataFrame([(1, "Null", 0.1), (1, "Additive", 0.4), (1, "Selected", 0.3), (2, "Null", 0.0), (2, "Selected", 0.2)], "u int, model string, cv_bits double")
    assert rows(glm.model_deltas(fits, ["u"]), "u", "delta_Additive", "delta_Selected") == [(1, pytest.approx(0.3), pytest.approx(0.2)), (2, None, pytest.approx(0.2))]
    p = spark.createDataFrame([(1, m, b, float(b), float(b) * s) for m, s in (("Selected", 1), ("Additive", -1)) for b in range(4)], "u int, model string, bin int, observed double, predicted double")
    assert rows(glm.compared_predictions(p, ["u"], "bin"), "Selected_r", "Additive_r") == [(pytest.approx(1.0), pytest.approx(-1.0))]
    c = spark.createDataFrame([("g", "V_only"), ("g", "V_only"), ("g", "none"), ("h", "none")], "g string, category string")
    assert rows(glm.categories(c, ["g"]), "g", "category", "n", "share") == [("g", "V_only", 2, pytest.approx(2 / 3)), ("g", "none", 1, pytest.approx(1 / 3)), ("h", "none", 1, 1.0)]
    t = glm.trial_rates(p.withColumn("trial", F.col("bin") % 2), ["u", "model"], "trial").filter("model = 'Selected'")
    assert rows(t, "trial", "observed", "predicted", "n_bins") == [(0, 1.0, 1.0, 2), (1, 2.0, 2.0, 2)]
    scores = spark.createDataFrame([(k, float(k)) for k in range(6)], "u int, cv_bits double").withColumn("one", F.lit(1))
    selection = spark.createDataFrame([(k, t) for k in range(5) for t in ("speed", "tf")] + [(5, "speed")], "u int, term string")
    assert rows(glm.best_units(scores, selection, ["u"], ["one"], most=2), "u", "place") == [(3, 2), (4, 1)]
    facts = glm.tuning_facts(spark.createDataFrame([(1, 2.0)], "trial int, center double"), spark.createDataFrame([(1, 0.08, 3.0)], "trial int, sf double, gain double"), ["trial"])
    assert rows(facts, "sf", "tf") == [(0.08, 6.0)]


def test_result_tables_are_written(spark, tmp_path):
    glm.save_results({"coefficients": spark.createDataFrame([(1, [0.5])], "u int, beta array<double>")}, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out/coefficients"), header=True).collect()[0].beta == "[0.5]"


def test_column_profiles_are_linear_between_electrodes(spark):
    df = spark.createDataFrame([("p", 0, 0.0, 1.0), ("p", 0, 10.0, 11.0), ("p", 1, 5.0, 3.0), ("p", 1, 8.0, 3.0)], "probe string, col int, depth double, power double")
    out = {(r.col, r.depth): (r.power, r.smooth) for r in signals.column_profiles(df, ["probe"], "col", "depth", "power", smooth=2).collect()}
    assert len(out) == 11 + 4 and all(out[(0, float(k))] == (pytest.approx(1 + k), pytest.approx(1 + k)) for k in range(11)) and out[(1, 6.0)][0] == 3.0


def test_displays_and_frames(spark):
    frames = spark.createDataFrame([(1, [0, 1, -1]), (2, [0, 0, 1])], "stim int, grid array<int>")
    assert rows(rf.sparse_frames(frames), "stim", "cell", "polarity") == [(1, 1, 1), (1, 2, -1), (2, 2, 1)]
    sta = spark.createDataFrame([(1, c, 1, d, float(c * s)) for c in range(4) for d, s in (("monitor", 2), ("goggles", 3))], "unit int, cell int, polarity int, display string, sta double")
    assert rows(rf.compared_displays(sta, ["unit"], "display", "monitor", "goggles"), "r", "monitor_peak", "goggles_peak", "n_cells") == [(pytest.approx(1.0), 6.0, 9.0, 4)]
    counts = rf.pooled(spark.createDataFrame([("a", 1, 2), ("b", 1, 3)], "session string, stim int, n int"), "session")
    assert counts.select("stim").distinct().count() == 2


def test_asymmetric_fit_of_its_own_shape(spark):
    import numpy as np

    x = np.linspace(0, 20, 20)
    y = tuning._shape("asymmetric", np.array([5.0, 8.0, 6.0, 20.0, 1.0]), x)
    out = tuning.asymmetric_fits(spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y, strict=True)], "u int, x double, y double"), ["u"], "x", "y").collect()[0]
    assert out.r2 > 0.99 and out.rmse < 0.2


def test_export_rows_and_ratios(spark):
    clusters = spark.createDataFrame([("p", 0, 1, 150.0), ("p", 1, 2, 150.0), ("p", 0, 3, 900.0)], "probe string, shank_id int, cluster_id int, from_tip double")
    layers = spark.createDataFrame([("p", 0, "5", 100.0, 300.0), ("p", 1, "4", 0.0, 200.0)], "probe string, shank_id int, region string, lower double, upper double")
    keys = ["probe", "shank_id"]
    assert rows(anatomy.cluster_rows(clusters, layers, keys), "cluster_id", "region", "relative", "from_upper") == [(1, "5", 0.75, 150.0), (2, "4", 0.25, 50.0), (3, None, None, None)]
    assert rows(anatomy.anatomy_rows(layers, keys, ["4", "5"]), "shank_id", "4", "5") == [(0, None, 200.0), (1, 200.0, None)]
    good = spark.createDataFrame([("p", 1), ("p", 2)], "probe string, cluster_id int")
    assert rows(anatomy.depths_of_good(clusters, good, ["probe", "cluster_id"], 0), "cluster_id", "from_tip") == [(1, 150.0)]
    spikes = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, 9.0)], "cluster_id int, amplitude double")
    assert rows(anatomy.amplitude_ratio(spikes, ["cluster_id"]), "ratio") == [(2.0,)]


def test_camera_table_prefers_the_fast_copy(spark, tmp_path):
    for name in ("fast", "slow"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "energy.csv").write_text(f"frame,energy\n0,{len(name)}.5\n" if name == "slow" else "frame,energy\n")
    schema = "frame int, energy double"
    paths = [str(tmp_path / "none"), str(tmp_path / "fast"), str(tmp_path / "slow")]
    assert rows(readers.camera_table(spark, paths, schema), "frame", "energy") == [(0, 4.5)]
    assert readers.camera_table(spark, paths[:1], schema).count() == 0
