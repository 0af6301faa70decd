"""Queries that call operators directly, against their SQL; tests corrected by category."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_queries import DIR, duck, plain  # noqa: F401
from trialspark.operators import anatomy, glm, rates, rf, stats, tuning
from trialspark.plans import compare_queries, operator_queries


@pytest.mark.parametrize("name", sorted(operator_queries.QUERIES))
def test_operators_against_sql(spark, duck, name):  # noqa: F811
    df = operator_queries.QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    told = duck.execute(f"SELECT {', '.join(f'\"{c}\"' for c in names)} FROM ({operator_queries.ORACLES[name]})").fetchall()
    assert mine and mine == sorted(tuple(plain(v) for v in r) for r in told)


def test_tests_by_category_are_corrected(spark):
    rows = [(1, c, 5.0 + i * 0.1 + (i + 1) * g, 5.0 + i * 0.1) for c, g in (("a", 1.0), ("b", -0.5), ("c", 0.0)) for i in range(8)]
    rows += [(1, "c", 1.0, 2.0), (1, "c", 2.0, 1.0)]
    df = spark.createDataFrame(rows, "u int, c string, v double, rest double")
    alone = {r.c: (r.p, r.direction) for r in stats.signed_rank(df, ["u", "c"], "rest", "v").collect()}
    out = {r.c: (r.p, r.direction) for r in stats.category_tests(df, ["u"], "c", "v", "rest").collect()}
    assert out == {c: (pytest.approx(min(1.0, 3 * p)), d) for c, (p, d) in alone.items()}
    assert out["a"][1] == 1 and out["b"][1] == -1 and out["c"] == (1.0, 0)


def test_one_tailed_tests(spark):
    rows = [(k, float(v), 0.0) for k, vs in (("up", range(1, 9)), ("down", range(-8, 0)), ("even", (-2, -1, 1, 2))) for v in vs]
    out = {r.k: (r.p, r.p_greater) for r in stats.one_tailed(stats.signed_rank(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y")).collect()}
    assert out["up"] == (pytest.approx(2 / 256), pytest.approx(1 / 256)) and out["down"][1] == pytest.approx(1 - 1 / 256) and out["even"][1] == 0.5


def test_gains_across_profiles(spark):
    rows = [("a", 0.2, 0.1), ("a", 0.4, 0.3), ("a", -0.1, 0.2), ("a", None, None)]
    r = glm.generalised(spark.createDataFrame(rows, "g string, s double, p double"), ["g"], "s", "p").first()
    assert (r.standard, r.profile, r.retained, r.n) == (pytest.approx(0.2), pytest.approx(0.2), pytest.approx(0.625), 3)
    assert r.p_greater == pytest.approx(1 / 8)


def test_four_models_are_compared(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        a, b = rng.normal(size=2)
        rows.append((1, i, float(a), float(b), float(a * b), int(rng.poisson(np.exp(0.8 * a))), 1.0, i % 5))
    df = spark.createDataFrame(rows, "u int, i int, a double, b double, ab double, spike_count int, dt double, fold int")
    out = {r.model: r.cv_bits for r in glm.compared_models(df, ["u"], ["i"], ["a", "b"], {"ab": ("a", "b")}).collect()}
    assert set(out) == {"Null", "Selected", "Additive", "FullInteraction"}
    assert out["Selected"] > out["Null"] + 0.1 and out["Selected"] >= out["FullInteraction"] - 0.01 and out["Additive"] > out["Null"]


def test_an_asymmetric_curve_and_its_p(spark):
    x = np.repeat(np.linspace(0, 20, 12), 3)
    rng = np.random.default_rng(2)
    curve = tuning._shape("asymmetric", np.array([5.0, 8.0, 6.0, 20.0, 1.0]), x)
    rows = [(k, int(i // 3), float(a), float(b)) for k, y in ((1, curve + rng.normal(size=36) * 0.1), (2, rng.normal(size=36))) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    out = {r.u: r for r in tuning.asymmetric_p(spark.createDataFrame(rows, "u int, bin int, x double, y double"), ["u"], "bin", "x", "y", 200, 4).collect()}
    assert out[1].p == 0 and out[1].rmse < 0.2 and out[1].r2 > 0.98 and out[2].p > 0.05


def test_layers_are_those_of_a_clusters_own_shank(spark):
    clusters = spark.createDataFrame([("p", 0, 1, 150.0), ("p", 1, 2, 150.0), ("p", 0, 3, 900.0)], "probe string, shank_id int, cluster_id int, from_tip double")
    layers = spark.createDataFrame([("p", 0, "VISp5", 100.0, 300.0), ("p", 1, "CA1", 0.0, 200.0)], "probe string, shank_id int, region string, lower double, upper double")
    out = {r.cluster_id: (r.layer, r.relative) for r in anatomy.layer_positions(clusters, layers, ["probe"]).collect()}
    assert out == {1: ("VISp5", 0.75), 2: ("", -1.0), 3: ("", -1.0)}


def test_traces_on_a_coarse_grid(spark):
    rows = [(1, 0.0, 0.0, 5.0), (1, 1.0, 10.0, 5.0), (1, 2.0, 0.0, 7.0), (2, 3.0, 1.0, 1.0)]
    out = [(r.channel, r.step, r.at, r.value) for r in rates.coarse_traces(spark.createDataFrame(rows, "k int, t double, a double, b double"), ["k"], "t", ["a", "b"], 2.5).orderBy("channel", "step").collect()]
    assert out == [("a", 0, 0.0, 0.0), ("a", 1, 0.5, 5.0), ("a", 2, 1.0, 10.0), ("a", 3, 1.5, 5.0), ("a", 4, 2.0, 0.0), ("b", 0, 0.0, 5.0), ("b", 1, 0.5, 5.0), ("b", 2, 1.0, 5.0), ("b", 3, 1.5, 6.0), ("b", 4, 2.0, 7.0)]


def test_functions_without_a_query(spark):
    around = spark.createDataFrame([(u, lag, v) for u, vs in ((1, (1.0, 5.0)), (2, (4.0, 2.0))) for lag, v in zip((-0.5, 0.5), vs, strict=True)], "u int, lag double, v double")
    out = {r.u: (r.baseline, r.response, r.delta, r.place) for r in rates.heatmap(around, ["u"], "lag", "v", (-1.0, 0.0), (0.0, 1.0)).collect()}
    assert out == {1: (1.0, 5.0, 4.0, 2), 2: (4.0, 2.0, -2.0, 1)}
    depths = spark.createDataFrame([(1500.0,), (700.0,), (-5.0,)], "d double").select(anatomy.depth_code(F.col("d"), 1200.0, 0.0).alias("c"))
    assert [r.c for r in depths.collect()] == [anatomy.ABOVE, None, anatomy.BEYOND]
    bins = spark.createDataFrame([(1, i, float(i % 4), int(i % 4 > 1), 0.5, i % 5) for i in range(40)], "u int, i int, a double, spike_count int, dt double, fold int")
    told = glm.held_out_predictions(bins, ["u"], ["i"], ["a"]).orderBy("i").collect()
    assert [r.observed for r in told] == [2.0 * (i % 4 > 1) for i in range(40)]
    x = np.array([i % 4 for i in range(40)], float)
    rest = np.array([i % 5 != 0 for i in range(40)])
    fit = glm.Fit(np.stack([np.ones(40), x], 1)[rest], np.array([float(i % 4 > 1) for i in range(40)])[rest], np.full(rest.sum(), np.log(0.5)))
    assert told[0].predicted == pytest.approx(np.exp(fit.beta[0])) and told[5].predicted == pytest.approx(np.exp(fit.beta[0] + fit.beta[1]))


def test_stimuli_of_any_length_are_counted_with_any_bucket(spark):
    spikes = spark.createDataFrame([(1, 7, t) for t in (0.1, 5.0, 99.0, 100.1)], "k int, unit int, t double")
    onsets = spark.createDataFrame([(1, 0, 0.0), (1, 1, 50.0), (1, 2, 100.0)], "k int, stim int, onset double")
    for bucket in (None, 0.5, 1000.0):
        assert {r.stim: r.n for r in rf.stimulus_counts(spikes, onsets, ["k"], "unit", bucket=bucket).collect()} == {0: 2, 1: 1, 2: 1}


def test_all_queries_have_names_of_their_own():
    import __spark_entry__ as entry

    told = entry.queries()
    assert set(entry.oracle_sql()) <= set(told)
    assert not set(operator_queries.QUERIES) & set(compare_queries.QUERIES)
