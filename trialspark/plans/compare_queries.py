"""Queries over the driver's tables that compare conditions, recordings and populations, and follow trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspark.operators import compare, intervals, rates, segment, select, stats, tuning
from trialspark.plans.event_queries import _KERNEL, DAY, E, HOUR, events, rounded
from trialspark.plans.flagship import _BOTH, rates_by_state
from trialspark.plans.table_queries import _hazen_sql, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _signed_sql(source: str, keys: str, digits: int = 9) -> str:
    """Sums of a signed-rank test of (keys, x, y) in a table: n_used, w_plus and w_minus by keys."""
    return f"""sd AS (SELECT {keys}, round(x - y, {digits}) AS d FROM {source} WHERE x IS NOT NULL AND y IS NOT NULL),
su AS (SELECT {keys}, d, rank() OVER (PARTITION BY {keys} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {keys}, abs(d)) - 1) / 2.0::DOUBLE AS r FROM sd WHERE d <> 0),
sw AS (SELECT {keys}, count(*) AS n_used, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus FROM su GROUP BY ALL),
sn AS (SELECT {keys}, count(*) AS n, median(x) AS x_median, median(y) AS y_median FROM {source} WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
st AS (SELECT sn.*, coalesce(n_used, 0) AS n_used, coalesce(w_plus, 0) AS w_plus, coalesce(w_minus, 0) AS w_minus FROM sn LEFT JOIN sw USING ({keys}))"""


def _ranks(df, keys):
    out = df.select(*keys, "n", "x_median", "y_median", "n_used", "w_plus", "w_minus")
    return rounded(rounded(out, "x_median", "y_median", digits=8), "w_plus", "w_minus", digits=2)


_RANKS = "n, round(x_median, 8) AS x_median, round(y_median, 8) AS y_median, n_used, round(w_plus, 2) AS w_plus, round(w_minus, 2) AS w_minus FROM st"


@query(f"""{E}, m AS (SELECT user_id, t BETWEEN 172800 AND 2160000 AS w, value > 100 AS tread, event_type = 'error' AS stage, value > 200 AS vis FROM e)
SELECT user_id, round(count(*) FILTER (WHERE w AND NOT tread AND NOT stage) / 10.0, 6) AS stationary_time,
round(count(*) FILTER (WHERE w AND CASE user_id % 3 WHEN 0 THEN tread WHEN 1 THEN stage ELSE vis END) / 10.0, 6) AS motion_time, round(count(*) FILTER (WHERE w) / 10.0, 6) AS window_time FROM m GROUP BY 1""")
def g7_mask_times(spark, d):
    window, tread, stage, vis = F.col("t").between(2 * DAY, 25 * DAY), F.col("value") > 100, F.col("event_type") == "error", F.col("value") > 200
    protocol = F.when(F.col("user_id") % 3 == 0, "Coupled").when(F.col("user_id") % 3 == 1, "StageOnly").otherwise("ReplayOnly")
    moving = compare.moving_by_protocol(protocol, window, {"Coupled": tread, "StageOnly": stage, "ReplayOnly": vis})
    out = compare.mask_times(events(spark, d), ["user_id"], {"stationary": compare.stationary(window, tread, stage), "motion": moving, "window": window}, 10.0)
    return rounded(out, "stationary_time", "motion_time", "window_time")


_BACK = "k AS (SELECT *, (value - 40 < -10)::INT AS f FROM e), b AS (SELECT user_id, event_id, t AS t0 FROM (SELECT *, f - lag(f) OVER (PARTITION BY user_id ORDER BY event_id) AS edge FROM k) WHERE edge = 1)"


def _backward(spark, d):
    return compare.backward_starts(events(spark, d).withColumn("velocity", F.col("value") - 40), ["user_id"], "event_id", "velocity").select("user_id", "event_id", F.col("t").alias("t0"))


@query(f"{E}, {_BACK} SELECT user_id, event_id, round(t0, 6) AS t0 FROM b")
def g22_backward_starts(spark, d):
    return rounded(_backward(spark, d), "t0")


@query(f"{E}, {_BACK} SELECT b.user_id, b.event_id, floor((e.t - t0) / 21600)::INT AS bin, count(*) AS n FROM b JOIN e ON e.user_id = b.user_id AND e.t >= t0 - 86400 AND e.t < t0 + 86400 GROUP BY ALL")
def f23_trains_around(spark, d):
    return compare.trains_around(events(spark, d), _backward(spark, d), ["user_id"], "event_id", DAY, DAY, 6 * HOUR)


_CELLS = "c AS (SELECT user_id % 7 AS unit, floor(t / 86400)::INT AS trial, event_type AS label, avg(value) AS fr FROM e GROUP BY ALL)"


def _cells(spark, d):
    e = events(spark, d).select((F.col("user_id") % 7).alias("unit"), F.floor(F.col("t") / DAY).cast("int").alias("trial"), F.col("event_type").alias("label"), "value")
    return e.groupBy("unit", "trial", "label").agg(F.avg("value").alias("fr"))


@query(f"""{E}, {_CELLS}, p AS (SELECT *, row_number() OVER (PARTITION BY unit, label ORDER BY trial) AS k FROM c),
q AS (SELECT a.unit, a.trial, a.fr AS x, b.fr AS y FROM p a JOIN p b ON a.unit = b.unit AND a.k = b.k AND a.label = 'click' AND b.label = 'purchase' WHERE abs(a.trial - b.trial) <= 6),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY trial) AS nth FROM q) WHERE nth <= 20), {_signed_sql('f', 'unit')} SELECT unit, {_RANKS}""")
def t3_motion_vs_motion(spark, d):
    return _ranks(compare.motion_vs_motion(_cells(spark, d), ["unit"], "trial", "label", "click", "purchase", "fr", most_apart=6, most_pairs=20, p_values=False), ["unit"])


@query(f"""{E}, {_CELLS}, p AS (SELECT *, row_number() OVER (PARTITION BY unit, label ORDER BY trial) AS k FROM c),
q AS (SELECT a.unit, a.label AS x_label, b.label AS y_label, a.fr AS x, b.fr AS y FROM p a JOIN p b ON a.unit = b.unit AND a.k = b.k AND a.label < b.label), {_signed_sql('q', 'unit, x_label, y_label')}
SELECT unit, x_label, y_label, {_RANKS}""")
def t22_all_motion_pairs(spark, d):
    return _ranks(compare.all_motion_pairs(_cells(spark, d), ["unit"], "trial", "label", "fr", p_values=False), ["unit", "x_label", "y_label"])


def _mass(hi: str, lo: str) -> str:
    at = lambda x: f"a[least(floor({x}), 999)::INT + 1] + (a[least(floor({x}), 999)::INT + 2] - a[least(floor({x}), 999)::INT + 1]) * ({x} - least(floor({x}), 999))"
    return f"{at(hi)} - ({at(lo)})"


def _smoothed_sql(name: str, a: float, b: float) -> str:
    """Mean smoothed rate (sigma 1 h, reach 1 day) of each user's events between a and b around each signup."""
    return f"""{name}_w AS (SELECT user_id, event_id AS trial, t + {a} AS w0, t + {b} AS w1 FROM e WHERE event_type = 'signup'),
{name}_c AS (SELECT w.user_id, w.trial, greatest(0, least(1000, (w1 - e.t + 86400) * (1000 / 172800.0::DOUBLE))) AS hi, greatest(0, least(1000, (w0 - e.t + 86400) * (1000 / 172800.0::DOUBLE))) AS lo
FROM {name}_w w JOIN e ON e.user_id = w.user_id AND e.t >= w0 - 86400 AND e.t <= w1 + 86400),
{name} AS (SELECT user_id, trial, sum({_mass('hi', 'lo')}) / {b - a} AS fr FROM {name}_c, kernel GROUP BY 1, 2)"""


_RESPONSES = f"""kernel AS (SELECT {_KERNEL} AS a), {_smoothed_sql('bsl', -43200.0, 0.0)}, {_smoothed_sql('rsp', 0.0, 43200.0)},
resp AS (SELECT user_id, trial, bsl.fr AS baseline, rsp.fr AS response, rsp.fr - bsl.fr AS delta FROM bsl JOIN rsp USING (user_id, trial))"""


def _responses(spark, d):
    e = events(spark, d)
    onsets = e.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("trial"), F.col("t").alias("t0"))
    return compare.mismatch_responses(e.select("user_id", "t"), onsets, ["user_id"], "trial", 12 * HOUR, DAY, sigma=HOUR, reach=DAY)


@query(f"{E}, {_RESPONSES} SELECT user_id, round(median(baseline), 10) AS baseline, round(median(response), 10) AS response, count(*) AS n, round(median(response) - median(baseline), 10) AS delta FROM resp GROUP BY 1")
def t6_mismatch_medians(spark, d):
    return rounded(compare.mismatch_medians(_responses(spark, d), ["user_id"]), "baseline", "response", "delta", digits=10)


@query(f"{E}, {_RESPONSES}, pr AS (SELECT user_id % 5 AS unit, baseline AS x, response AS y FROM resp), {_signed_sql('pr', 'unit', 12)} SELECT unit, n, n_used, round(w_plus, 2) AS w_plus, round(w_minus, 2) AS w_minus FROM st")
def t5_mismatch_ranks(spark, d):
    out = stats.signed_rank(_responses(spark, d).withColumn("unit", F.col("user_id") % 5), ["unit"], "baseline", "response", p_values=False, digits=12)
    return rounded(out.select("unit", "n", "n_used", "w_plus", "w_minus"), "w_plus", "w_minus", digits=2)


@query(f"""{E}, {_RESPONSES}, l AS (SELECT user_id % 5 AS unit, measure, v FROM resp UNPIVOT (v FOR measure IN (baseline, response, delta))),
{_hazen_sql('l', 'unit, measure', 'v', '[25.0::DOUBLE, 50, 75]')} SELECT unit, measure, round(max(CASE WHEN prc = 25 THEN value END), 11) + 0.0 AS q1, round(max(CASE WHEN prc = 50 THEN value END), 11) + 0.0 AS median, round(max(CASE WHEN prc = 75 THEN value END), 11) + 0.0 AS q3 FROM q GROUP BY 1, 2""")
def t21_slip_quartiles(spark, d):
    out = compare.quartile_table(_responses(spark, d).withColumn("unit", F.col("user_id") % 5), ["unit"], ["baseline", "response", "delta"])
    return out.withColumns({c: F.round(c, 11) + F.lit(0.0) for c in ("q1", "median", "q3")})  # no negative zeros


@query(f"""WITH v AS (SELECT l_returnflag AS label, l_suppkey AS unit, s_nationkey, avg(CASE WHEN l_linestatus = 'F' THEN l_discount END) - avg(l_tax) AS delta FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
pr AS (SELECT a.s_nationkey, a.delta AS x, b.delta AS y FROM v a JOIN v b ON a.unit = b.unit AND a.s_nationkey = b.s_nationkey AND a.label = 'A' AND b.label = 'R'), {_signed_sql('pr', 's_nationkey')} SELECT s_nationkey, {_RANKS}""")
def t9_populations(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    deltas = lines.groupBy(F.col("l_returnflag").alias("label"), F.col("l_suppkey").alias("unit"), "s_nationkey").agg((F.avg(F.when(F.col("l_linestatus") == "F", F.col("l_discount"))) - F.avg("l_tax")).alias("delta"))
    return _ranks(compare.populations(deltas, "label", ["unit"], "delta", "A", "R", ["s_nationkey"], p_values=False), ["s_nationkey"])


@query(f"""WITH pr AS (SELECT o_orderpriority AS label, o_custkey % 9 AS unit, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS x, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS y FROM orders GROUP BY ALL), {_signed_sql('pr', 'label')} SELECT label, {_RANKS}""")
def t20_paired_totals(spark, d):
    side = lambda v: F.sum(F.when(F.col("o_orderstatus") == v, F.col("o_totalprice")))
    pairs = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("label"), (F.col("o_custkey") % 9).alias("unit")).agg(side("F").alias("x"), side("O").alias("y"))
    return _ranks(stats.signed_rank(pairs, ["label"], "x", "y", p_values=False), ["label"])


@query(f"{E} SELECT a.user_id, floor((b.t - a.t) / 3600)::INT AS bin, count(*) AS n FROM e a JOIN e b ON a.user_id = b.user_id AND b.t > a.t AND b.t < a.t + 86400 GROUP BY 1, 2")
def t19_isi_pairs(spark, d):
    return compare.isi_pairs(events(spark, d), ["user_id"], "t", DAY, HOUR)


_TUNING = "tu AS (SELECT user_id % 6 AS unit, CASE event_type WHEN 'view' THEN 'V' WHEN 'click' THEN 'T' WHEN 'purchase' THEN 'VT' END AS label, floor(t / 86400)::INT % 3 AS bin, floor(t / 432000)::INT AS trial, avg(value) AS fr FROM e WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL)"
_SUM = f"""{_TUNING}, re AS (SELECT user_id % 6 AS unit, avg(value) AS s FROM e WHERE event_type = 'error' GROUP BY 1), mv AS (SELECT unit, bin, avg(fr) AS m FROM tu WHERE label = 'V' GROUP BY 1, 2),
sy AS (SELECT unit, 'V+T' AS label, bin, trial, fr + m - s AS fr FROM tu JOIN mv USING (unit, bin) JOIN re USING (unit) WHERE label = 'T')"""


def _tuning(spark, d):
    e = events(spark, d).withColumn("unit", F.col("user_id") % 6)
    label = F.when(F.col("event_type") == "view", "V").when(F.col("event_type") == "click", "T").when(F.col("event_type") == "purchase", "VT")
    cells = e.withColumn("label", label).filter("label IS NOT NULL").groupBy("unit", "label", (F.floor(F.col("t") / DAY).cast("int") % 3).alias("bin"), F.floor(F.col("t") / (5 * DAY)).cast("int").alias("trial")).agg(F.avg("value").alias("fr"))
    rest = e.filter("event_type = 'error'").groupBy("unit").agg(F.avg("value").alias("stationary_fr"))
    return cells, compare.synthetic_sum(cells, ["unit"], "label", "bin", "trial", "fr", rest)


@query(f"{E}, {_SUM} SELECT unit, label, bin, trial, round(fr, 7) AS fr FROM sy")
def m16_synthetic_sum(spark, d):
    return rounded(_tuning(spark, d)[1], "fr", digits=7)


@query(f"""{E}, {_SUM}, x AS (SELECT * FROM tu WHERE label = 'VT' UNION ALL SELECT * FROM sy), n AS (SELECT unit, label, trial, count(*) AS k FROM x GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY unit, label ORDER BY trial) AS nth, count(*) OVER (PARTITION BY unit, label) AS c FROM n), l AS (SELECT unit, min(c) AS least FROM w GROUP BY unit HAVING count(DISTINCT label) = 2),
z AS (SELECT x.* FROM x JOIN w USING (unit, label, trial) JOIN l USING (unit) WHERE nth <= least), ce AS (SELECT unit, label, bin, sum(fr) AS s, count(*) AS m, sum(fr * fr) AS q FROM z GROUP BY ALL),
ra AS (SELECT unit, sum(s * s / m) AS v, count(*) AS k FROM (SELECT unit, label, sum(s) AS s, sum(m) AS m FROM ce GROUP BY ALL) GROUP BY 1), rb AS (SELECT unit, sum(s * s / m) AS v, count(*) AS k FROM (SELECT unit, bin, sum(s) AS s, sum(m) AS m FROM ce GROUP BY ALL) GROUP BY 1),
t AS (SELECT unit, sum(s) AS s, sum(m) AS n, sum(q) AS q, sum(s * s / m) AS v, count(*) AS k FROM ce GROUP BY 1)
SELECT t.unit, n::BIGINT AS n, round((ra.v - s * s / n) / (ra.k - 1) / ((q - t.v) / (n - t.k)), 5) AS f_a, round((rb.v - s * s / n) / (rb.k - 1) / ((q - t.v) / (n - t.k)), 5) AS f_b FROM t JOIN ra USING (unit) JOIN rb USING (unit)""")
def m16_against_synthetic(spark, d):
    cells, sums = _tuning(spark, d)
    out = compare.against_synthetic(cells.filter("label = 'VT'"), sums, ["unit"], "label", "bin", "trial", "fr", p_values=False)
    return rounded(out.select("unit", "n", "f_a", "f_b"), "f_a", "f_b", digits=5)


_FITS = """fi AS (SELECT l_suppkey, CASE l_returnflag WHEN 'A' THEN 'V' WHEN 'N' THEN 'VT' ELSE 'T' END AS label, round(1 - regr_r2(l_discount, l_quantity), 8) AS r2, round(regr_r2(l_tax, l_quantity) * 2, 8) AS p,
CASE WHEN regr_slope(l_discount, l_quantity) > 0 THEN 'up' ELSE 'down' END AS model FROM lineitem GROUP BY ALL)"""


def _fits(spark, d):
    label = F.when(F.col("l_returnflag") == "A", "V").when(F.col("l_returnflag") == "N", "VT").otherwise("T")
    r2 = lambda y: F.regr_r2(y, "l_quantity")
    out = table(spark, d, "lineitem").groupBy("l_suppkey", label.alias("label")).agg(F.round(1 - r2("l_discount"), 8).alias("r2"), F.round(r2("l_tax") * 2, 8).alias("p"), F.when(F.regr_slope("l_discount", "l_quantity") > 0, "up").otherwise("down").alias("model"))
    return out


@query(f"""WITH {_FITS}, o AS (SELECT l_suppkey, {', '.join(f'''bool_or(p < 0.05) FILTER (WHERE label = '{c}') AS "{c}_is_tuned", max(p) FILTER (WHERE label = '{c}') AS "{c}_p", coalesce(max(model) FILTER (WHERE label = '{c}'), 'N/A') AS "{c}_model", max(r2) FILTER (WHERE label = '{c}') AS "{c}_r2"''' for c in ('V', 'VT', 'T'))} FROM fi GROUP BY 1)
SELECT *, CASE WHEN "V_model" <> 'N/A' AND "VT_model" <> 'N/A' THEN "V_model" = "VT_model" END AS models_agree FROM o""")
def j13_outcomes(spark, d):
    return compare.outcomes(_fits(spark, d), ["l_suppkey"], "label", ["V", "VT", "T"])


@query(f"""WITH {_FITS}, f AS (SELECT l_suppkey FROM fi WHERE label = 'V' AND p < 0.05 AND r2 > 0.65) SELECT a.l_suppkey, round(a.r2 - b.r2, 7) AS delta FROM fi a JOIN fi b ON a.l_suppkey = b.l_suppkey AND a.label = 'VT' AND b.label = 'T' WHERE a.l_suppkey IN (SELECT * FROM f)""")
def j14_focus_units(spark, d):
    fits = _fits(spark, d)
    side = lambda c, n: fits.filter(F.col("label") == c).select("l_suppkey", F.col("r2").alias(n))
    both = side("VT", "a").join(side("T", "b"), "l_suppkey").join(compare.focus_units(fits, ["l_suppkey"], "label"), "l_suppkey", "left_semi")
    return both.select("l_suppkey", F.round(F.col("a") - F.col("b"), 7).alias("delta"))


@query(f"""{_BOTH}, pr AS (SELECT event_type, user_id % 2 AS recording, stationary_fr AS x, motion_fr AS y FROM b), {_signed_sql('pr', 'event_type, recording', 12)}
SELECT event_type, recording, n, round(x_median, 12) AS x_median, round(y_median, 12) AS y_median, n_used, round(w_plus, 2) AS w_plus, round(w_minus, 2) AS w_minus, round((y_median - x_median) / (y_median + x_median), 6) AS modulation FROM st""")
def f21_unit_medians(spark, d):
    both = rates_by_state(spark, d).withColumn("recording", F.col("user_id") % 2)
    out = compare.unit_medians(both, ["event_type"], "recording", "stationary_fr", "motion_fr", p_values=False, digits=12)
    out = out.select("event_type", "recording", "n", "x_median", "y_median", "n_used", "w_plus", "w_minus", "modulation")
    return rounded(rounded(rounded(out, "x_median", "y_median", digits=12), "w_plus", "w_minus", digits=2), "modulation")


_STARTS = f"""st AS (SELECT user_id, event_id AS stim, t AS t0, lead(t) OVER (PARTITION BY user_id ORDER BY t) - t AS gap, row_number() OVER (PARTITION BY user_id ORDER BY t) = 1 AS first FROM e WHERE event_type = 'signup'),
sm AS (SELECT *, avg(CASE WHEN gap < 172800 THEN gap END) OVER (PARTITION BY user_id) AS mean FROM st), sk AS (SELECT unnest(range(1, 5)) AS k),
gi AS (SELECT user_id, stim, 'stimulus' AS kind, t0 AS w0, t0 + CASE WHEN gap < 172800 THEN gap ELSE mean END AS w1 FROM sm
UNION ALL SELECT user_id, stim, 'blank', t0 - k * 86400.0::DOUBLE, t0 - (k - 1) * 86400.0::DOUBLE FROM sm, sk WHERE first UNION ALL SELECT user_id, stim, 'blank', t0 + k * 86400.0::DOUBLE, t0 + (k + 1) * 86400.0::DOUBLE FROM sm, sk WHERE gap >= 172800)"""


def _gratings(spark, d):
    starts = events(spark, d).filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("stim"), F.col("t").alias("t0"))
    return compare.grating_intervals(starts, ["user_id"], DAY)


@query(f"{E}, {_STARTS} SELECT user_id, stim, kind, round(w0, 4) AS w0, round(w1, 4) AS w1 FROM gi")
def f19_grating_intervals(spark, d):
    return rounded(_gratings(spark, d), "w0", "w1", digits=4)


@query(f"""{E}, {_STARTS}, rr AS (SELECT gi.user_id, gi.stim, w1 - w0 AS dt, count(e.t) AS n FROM gi LEFT JOIN e ON e.user_id = gi.user_id AND e.t >= w0 AND e.t < w1 WHERE kind = 'stimulus' AND w1 > w0 GROUP BY ALL),
md AS (SELECT user_id, stim % 3 AS sf, stim % 2 AS dir, median(n / dt) AS median, count(*) AS n FROM rr GROUP BY ALL), pl AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY median DESC, sf, dir)::INT AS place FROM md)
SELECT user_id, sf, dir, round(median, 12) AS median, n, place FROM pl WHERE place <= 4""")
def f19_preferred_stimuli(spark, d):
    shown = _gratings(spark, d).filter("kind = 'stimulus' AND w1 > w0").select("user_id", "stim", "w0", "w1")
    found = intervals.window_rates(events(spark, d), shown, ["user_id"], ["stim"], DAY)
    rows = found.select("user_id", (F.col("stim") % 3).alias("sf"), (F.col("stim") % 2).alias("dir"), "rate")
    return rounded(compare.preferred_stimuli(rows, ["user_id"], ["sf", "dir"], "rate"), "median", digits=12)


@query(f"""{E}, v AS (SELECT user_id, t, value, lead(t) OVER w AS nt, lead(value) OVER w AS nv FROM e WHERE event_type = 'view' WINDOW w AS (PARTITION BY user_id ORDER BY t)),
g AS (SELECT user_id, step, t + step * 21600.0::DOUBLE AS x FROM e, (SELECT unnest(range(-4, 5)) AS step) WHERE event_type = 'signup'),
i AS (SELECT g.user_id, step, v.value + (v.nv - v.value) / (v.nt - v.t) * (x - v.t) AS v FROM g ASOF JOIN v ON g.user_id = v.user_id AND g.x >= v.t) SELECT user_id, step::INT AS step, round(avg(v), 6) AS trace, count(v) AS n FROM i GROUP BY 1, 2 HAVING count(v) > 0""")
def f11_traces_around(spark, d):
    e = events(spark, d)
    points = rates.grid(e.filter("event_type = 'signup'").select("user_id", F.col("t").alias("t0")), DAY, DAY, 1 / 21_600)
    found = intervals.interpolated(points, e.filter("event_type = 'view'").select("user_id", F.col("t").alias("at"), "value"), ["user_id"], "at", "value")
    return rounded(found.groupBy("user_id", "step").agg(F.avg("value_at").alias("trace"), F.count("value_at").alias("n")).filter("n > 0"), "trace")


@query(f"""{E}, s AS (SELECT user_id % 4 AS g, user_id, t AS t0 FROM e WHERE event_type = 'error'), p AS (SELECT s.*, step, t0 + step * 21600.0::DOUBLE AS at FROM s, (SELECT unnest(range(-4, 5)) AS step)),
r AS (SELECT p.g, p.step, p.t0, p.user_id, sum(exp(-(e.t - p.at) * (e.t - p.at) / (2 * 7200.0::DOUBLE * 7200.0::DOUBLE))) AS w FROM p LEFT JOIN e ON e.user_id % 4 = p.g AND e.event_type = 'view' AND e.t BETWEEN p.at - 28800 AND p.at + 28800 GROUP BY ALL)
SELECT g, step::INT AS step, round(avg(coalesce(w, 0)), 6) AS rate, count(*) AS n_triggers FROM r GROUP BY 1, 2""")
def f12_rates_around(spark, d):
    import math

    e = events(spark, d).withColumn("g", F.col("user_id") % 4)
    found = rates.mean_response(e.filter("event_type = 'view'"), e.filter("event_type = 'error'").select("g", F.col("t").alias("t0")), ["g"], DAY, DAY, 1 / 21_600, 7200.0, 28_800.0)
    scale = 7200 * math.sqrt(2 * math.pi) * (1 - math.erfc(4 / math.sqrt(2)))
    return rounded(found.withColumn("rate", F.col("rate") * scale), "rate")


_DET = lambda m: f"({m[0]} * ({m[4]} * {m[8]} - {m[5]} * {m[7]}) - {m[1]} * ({m[3]} * {m[8]} - {m[5]} * {m[6]}) + {m[2]} * ({m[3]} * {m[7]} - {m[4]} * {m[6]}))"
_TRIP = f"""x AS (SELECT *, (t - min(t) OVER u) / (max(t) OVER u - min(t) OVER u) AS x, coalesce(lead(t) OVER o - t, 0) AS dt FROM e WINDOW u AS (PARTITION BY user_id), o AS (PARTITION BY user_id ORDER BY t)),
s AS (SELECT user_id, sum(x ** 0) AS s0, sum(x) AS s1, sum(x ** 2) AS s2, sum(x ** 3) AS s3, sum(x ** 4) AS s4, sum(value) AS y0, sum(x * value) AS y1, sum(x ** 2 * value) AS y2 FROM x WHERE value > 2 GROUP BY 1),
f AS (SELECT user_id, {_DET(['y0', 's1', 's2', 'y1', 's2', 's3', 'y2', 's3', 's4'])} / det AS a, {_DET(['s0', 'y0', 's2', 's1', 'y1', 's3', 's2', 'y2', 's4'])} / det AS b, {_DET(['s0', 's1', 'y0', 's1', 's2', 'y1', 's2', 's3', 'y2'])} / det AS c
FROM (SELECT *, {_DET(['s0', 's1', 's2', 's1', 's2', 's3', 's2', 's3', 's4'])} AS det FROM s)),
p AS (SELECT x.*, greatest(0, least(100, 100 * sum(value * dt) OVER (PARTITION BY x.user_id ORDER BY t ROWS UNBOUNDED PRECEDING) / sum(greatest(a + b * x + c * x * x, 0.1) * dt) OVER (PARTITION BY x.user_id))) AS progress FROM x JOIN f ON f.user_id = x.user_id)"""


@query(f"{E}, {_TRIP} SELECT event_id, round(progress, 4) AS progress FROM p")
def f17_trip_progress(spark, d):
    return rounded(compare.trip_progress(events(spark, d), ["user_id"], "t", "value").select("event_id", "progress"), "progress", digits=4)


@query(f"""{E}, {_TRIP}, r AS (SELECT user_id % 3 AS unit, floor(round(progress, 4) / 5)::INT AS bin, value FROM p), {_hazen_sql('r', 'unit, bin', 'value', '[25.0::DOUBLE, 50, 75]').replace('r AS', 'rk AS').replace('FROM r CROSS', 'FROM rk CROSS').replace('p AS', 'hp AS').replace('FROM p WHERE', 'FROM hp WHERE')}
SELECT unit, bin, round(max(CASE WHEN prc = 25 THEN value END), 8) AS q1, round(max(CASE WHEN prc = 50 THEN value END), 8) AS median, round(max(CASE WHEN prc = 75 THEN value END), 8) AS q3 FROM q GROUP BY 1, 2""")
def f17_rates_by_progress(spark, d):
    placed = compare.trip_progress(events(spark, d), ["user_id"], "t", "value").withColumns({"unit": F.col("user_id") % 3, "progress": F.round("progress", 4)})
    return rounded(compare.rates_by_progress(placed, ["unit"], "value"), "q1", "median", "q3", digits=8)


_AT = "s.value + (s.nv - s.value) / (s.nt - s.t)"


@query(f"""{E}, s AS (SELECT user_id, t, value, lead(t) OVER w AS nt, lead(value) OVER w AS nv FROM e WHERE event_type = 'view' WINDOW w AS (PARTITION BY user_id ORDER BY t)), k AS (SELECT * FROM e WHERE event_type = 'purchase'),
a AS (SELECT k.user_id, k.event_id, round({_AT} * (k.t - s.t), 6) AS position FROM k ASOF LEFT JOIN s ON k.user_id = s.user_id AND k.t >= s.t),
b AS (SELECT k.event_id, floor(({_AT} * (k.t - 3600 - s.t)) * 10)::INT AS i FROM k ASOF LEFT JOIN s ON k.user_id = s.user_id AND k.t - 3600 >= s.t),
c AS (SELECT k.event_id, floor(({_AT} * (k.t - 7200 - s.t)) * 10)::INT AS i FROM k ASOF LEFT JOIN s ON k.user_id = s.user_id AND k.t - 7200 >= s.t)
SELECT a.user_id, a.event_id, position, b.i AS image_3600000ms, c.i AS image_7200000ms FROM a JOIN b USING (event_id) JOIN c USING (event_id)""")
def f20_exported_spikes(spark, d):
    e = events(spark, d)
    samples = e.filter("event_type = 'view'").select("user_id", "t", "value")
    out = compare.exported_spikes(e.filter("event_type = 'purchase'").select("user_id", "event_id", "t"), samples, ["user_id"], "t", "value", [HOUR, 2 * HOUR], 10.0, intervals.interpolated)
    return rounded(out.drop("t"), "position")


@query(f"""{E}, k AS (SELECT user_id % 11 AS unit, event_type, count(*) AS n, avg(value) AS fr FROM e GROUP BY ALL),
c AS (SELECT unit, max(CASE WHEN event_type = 'view' THEN CASE WHEN n % 3 = 0 THEN 'tuned' WHEN n % 3 = 1 THEN 'responsive' ELSE 'unresponsive' END END) AS "V", max(CASE WHEN event_type = 'purchase' THEN CASE WHEN n % 2 = 0 THEN 'tuned' ELSE 'unresponsive' END END) AS "VT" FROM k GROUP BY 1)
SELECT unit, CASE WHEN "V" = 'tuned' THEN 'V_tuned' WHEN "V" = 'responsive' THEN 'V_responsive' WHEN "VT" = 'tuned' THEN 'V_silent_VT_tuned' ELSE 'none' END AS class FROM c""")
def t23_two_condition_classes(spark, d):
    n = events(spark, d).groupBy((F.col("user_id") % 11).alias("unit"), "event_type").agg(F.count("*").alias("n"))
    three = F.when(F.col("n") % 3 == 0, "tuned").when(F.col("n") % 3 == 1, "responsive").otherwise("unresponsive")
    two = F.when(F.col("n") % 2 == 0, "tuned").otherwise("unresponsive")
    of = lambda name, c: F.max(F.when(F.col("event_type") == name, c))
    return compare.two_condition_classes(n.groupBy("unit").agg(of("view", three).alias("V"), of("purchase", two).alias("VT")), ["unit"])


@query(f"{E}, m AS (SELECT user_id, event_type, round(median(value), 8) AS median FROM e GROUP BY 1, 2) SELECT user_id, event_type, median, row_number() OVER (PARTITION BY user_id ORDER BY median DESC, event_type)::INT AS place FROM m")
def t23_ordered_medians(spark, d):
    medians = events(spark, d).groupBy("user_id", "event_type").agg(F.round(F.median("value"), 8).alias("v"))
    return compare.ordered_medians(medians, ["user_id"], "event_type", "v", F.col("v"))


@query(f"""{E}, s AS (SELECT user_id % 10 AS g, value - 20 AS v FROM e), m AS (SELECT g, 'all' AS mode, v FROM s UNION ALL SELECT g, 'acc', v FROM s WHERE v > 0 UNION ALL SELECT g, 'dec', v FROM s WHERE v < 0),
{_hazen_sql('m', 'g, mode', 'v', 'list_transform(range(0, 6), lambda k: 100.0::DOUBLE * k / 5)')}, b AS (SELECT g, mode, row_number() OVER w AS bin, value AS lo, lead(value) OVER w AS hi FROM q WINDOW w AS (PARTITION BY g, mode ORDER BY prc))
SELECT b.g, b.mode, b.bin::INT AS bin, round(avg(m.v), 7) AS rate, count(*) AS n FROM m JOIN b ON b.g = m.g AND b.mode = m.mode AND lo <= v AND v < hi AND bin <= 5 GROUP BY ALL""")
def m6_acceleration_tuning(spark, d):
    e = events(spark, d).select((F.col("user_id") % 10).alias("g"), (F.col("value") - 20).alias("v"))
    modes = tuning.by_mode(e, "v")
    return rounded(tuning.mean_by_bin(modes, tuning.signed_bins(e, ["g"], "v", 5), ["g", "mode"], [], "v", "v"), "rate", digits=7)


@query(f"""WITH x AS (SELECT CASE WHEN p_type LIKE 'S%' THEN 'a' WHEN p_type LIKE 'M%' OR p_type LIKE 'L%' THEN 'b' END AS batch, p_size * CASE WHEN p_type LIKE 'S%' THEN 1.5::DOUBLE ELSE 2 END AS tf, p_retailprice AS v FROM part), k AS (SELECT * FROM x WHERE batch IS NOT NULL),
{_hazen_sql('k', 'batch', 'tf', 'list_transform(range(0, 6), lambda k: 100.0::DOUBLE * k / 5)')}, b AS (SELECT batch, row_number() OVER w AS bin, value AS lo, lead(value) OVER w AS hi FROM q WINDOW w AS (PARTITION BY batch ORDER BY prc))
SELECT k.batch, bin::INT AS bin, round(avg(v), 7) AS rate, count(*) AS n FROM k JOIN b ON b.batch = k.batch AND lo <= tf AND tf < hi AND bin <= 5 GROUP BY ALL""")
def m19_batch_tuning(spark, d):
    batch, gain = select.stimulus_batch(F.col("p_type"), [("^S", "a", 1.5), ("^(M|L)", "b", 2.0)])
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("trial"), F.col("p_size").alias("speed"), "p_retailprice", batch.alias("batch"), gain.alias("gain"))
    known = parts.filter("batch IS NOT NULL")
    samples = tuning.scaled_by_gain(parts.select("trial", "speed", "p_retailprice", "batch"), known.select("trial", "gain"), ["trial"], "speed")
    return rounded(tuning.mean_by_bin(samples, tuning.equal_population_bins(samples, ["batch"], "tf", 5), ["batch"], [], "tf", "p_retailprice"), "rate", digits=7)


@query(f"""{E}, c AS (SELECT user_id % 8 AS unit, event_type AS label, floor(value / 100)::INT AS bin, count(*) AS n FROM e GROUP BY ALL), s AS (SELECT user_id % 8 AS unit, event_type AS label, sign(avg(value) - 50)::INT AS direction FROM e GROUP BY 1, 2)
SELECT unit, label, bin, n, direction FROM c JOIN s USING (unit, label)""")
def m21_tagged_curves(spark, d):
    e = events(spark, d).select((F.col("user_id") % 8).alias("unit"), F.col("event_type").alias("label"), "value")
    curves = e.groupBy("unit", "label", F.floor(F.col("value") / 100).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    tests = e.groupBy("unit", "label").agg(F.signum(F.avg("value") - 50).cast("int").alias("direction"))
    return tuning.tagged(curves, tests, ["unit", "label"], ["direction"])


@query("""WITH m AS (SELECT avg(o_totalprice) AS m FROM orders WHERE o_orderpriority = '1-URGENT'), r AS (SELECT avg(o_totalprice) AS m FROM orders WHERE o_orderpriority = '5-LOW') SELECT o_orderkey, round(o_totalprice / m.m * r.m, 5) AS v FROM orders, m, r WHERE o_orderpriority = '1-URGENT'""")
def a10_rescaled(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    out = stats.rescaled_to(orders.filter("o_orderpriority = '1-URGENT'"), orders.filter("o_orderpriority = '5-LOW'"), [], "o_totalprice", "v")
    return rounded(out.select("o_orderkey", "v"), "v", digits=5)


@query("""SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' ELSE o_orderpriority END AS label, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1""")
def a11_merged_labels(spark, d):
    merged = select.merged_labels(table(spark, d, "orders"), "o_orderpriority", {"1-URGENT": "high", "2-HIGH": "high"}).withColumnRenamed("o_orderpriority", "label")
    return rounded(merged.groupBy("label").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean")), "mean", digits=4)


@query(f"""WITH k AS (SELECT l_returnflag, l_linestatus, l_quantity::DOUBLE AS v FROM lineitem), {_hazen_sql('k', 'l_returnflag', 'v', 'list_transform(range(0, 21), lambda k: 100.0::DOUBLE * k / 20)')}, b AS (SELECT l_returnflag, prc, value FROM q),
h AS (SELECT l_returnflag, floor(v / 5)::INT AS cell, count(*) AS n FROM k GROUP BY 1, 2) SELECT l_returnflag, cell, round(n / sum(n) OVER (PARTITION BY l_returnflag), 8) AS share, (SELECT count(*) FROM b WHERE b.l_returnflag = h.l_returnflag AND b.value < (cell + 1) * 5.0::DOUBLE)::INT AS edges_below FROM h""")
def a16_distribution(spark, d):
    return rounded(stats.distribution(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", 5.0), "share", digits=8)


@query(f"""{E}, a AS (SELECT user_id, count(*) AS n FROM e WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM e WHERE event_type = 'click' GROUP BY 1)
SELECT user_id, coalesce(a.n, 0) AS n_frames, coalesce(b.n, 0) AS n_triggers, coalesce(a.n, 0) = coalesce(b.n, 0) AS agrees FROM a FULL JOIN b USING (user_id)""")
def a25_lengths_agree(spark, d):
    e = events(spark, d)
    return select.lengths_agree(e.filter("event_type = 'view'"), e.filter("event_type = 'click'"), ["user_id"])


@query("""SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 1000 AND s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 45) AND NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_suppkey = s_suppkey AND x.l_discount > 0.09 AND x.l_tax > 0.075)""")
def p12_chained_selection(spark, d):
    lines, suppliers = table(spark, d, "lineitem"), table(spark, d, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    chosen = select.intersected(suppliers.filter("s_acctbal > 1000"), [lines.filter("l_quantity > 45")], ["l_suppkey"])
    left = select.without(chosen, lines.filter("l_discount > 0.09 AND l_tax > 0.075"), ["l_suppkey"])
    return left.select(F.col("l_suppkey").alias("s_suppkey"), "s_nationkey", "s_acctbal")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def p3_labelled_trials(spark, d):
    orders = select.with_labels(table(spark, d, "orders"), ["1-URGENT", "5-LOW"], "o_orderpriority")
    ids = table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return select.with_ids(orders, ids, ["o_custkey"]).select("o_orderkey", "o_orderpriority")


@query("SELECT p_partkey, CASE WHEN p_size IN (7, 13) OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) THEN NULL ELSE p_retailprice END AS power FROM part WHERE p_size <> 1")
def p18_removed_channels(spark, d):
    parts, bad = table(spark, d, "part"), table(spark, d, "lineitem").filter("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"))
    out = select.blanked_channels(select.without(parts, parts.filter("p_size = 1"), ["p_partkey"]), bad, ["p_partkey"], "p_retailprice", F.col("p_size").isin(7, 13))
    return out.select("p_partkey", F.col("p_retailprice").alias("power"))


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def s14_catalogue(spark, d):
    customers = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), "n_name", F.col("n_regionkey").alias("region"))
    regions = table(spark, d, "region").select(F.col("r_regionkey").alias("region"), "r_name")
    return select.looked_up(select.looked_up(customers, nations, ["nation"]), regions, ["region"]).select("c_custkey", "n_name", "r_name")


_PSTH = f"{E}, g AS (SELECT user_id % 5 AS unit, floor(t / 21600)::INT AS cell, count(*) AS n FROM e GROUP BY 1, 2)"


@query(f"{_PSTH} SELECT cell, round(sum(n) / (SELECT count(DISTINCT unit) FROM g), 8) AS mean_count FROM g GROUP BY 1")
def f22_population_mean(spark, d):
    counts = rates.counts_on_axis(events(spark, d).withColumn("unit", F.col("user_id") % 5), ["unit"], 1 / 21_600)
    return rounded(rates.population_mean(counts, ["unit"], [], "cell", "n"), "mean_count", digits=8)
