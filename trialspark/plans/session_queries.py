"""Queries whose keys may have any number of rows: all events as one session, cut to stretches of even span, and fits in steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspark.operators import compare, glm, scan, segment, signals
from trialspark.plans.event_queries import HOUR, E, events, low_pass_sql, rounded

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _session(spark, d, order: str):
    e = events(spark, d).withColumn("session_id", F.lit(1))
    return e, scan.even_span(e, order)


@query(f"{E}, x AS (SELECT *, (value > 250)::INT AS f FROM e), y AS (SELECT *, f - lag(f) OVER (ORDER BY event_id) AS edge FROM x) SELECT event_id, edge FROM y WHERE edge <> 0")
def g1_edges_one_session(spark, d):
    e, span = _session(spark, d, "event_id")
    return segment.edges(e, ["session_id"], "event_id", F.col("value") > 250, span).select("event_id", "edge")


_ISLANDS = """x AS (SELECT *, value > 20 AS f FROM e), y AS (SELECT *, (f AND NOT coalesce(lag(f) OVER (ORDER BY event_id), false))::INT AS s FROM x),
z AS (SELECT *, sum(s) OVER (ORDER BY event_id)::BIGINT AS island FROM y),
i AS (SELECT island, min(event_id) AS start, max(event_id) AS "end", count(*) AS n, max(value) AS peak FROM z WHERE f GROUP BY 1)"""


@query(f"{E}, {_ISLANDS} SELECT * FROM i")
def g3_islands_one_session(spark, d):
    e, span = _session(spark, d, "event_id")
    return segment.islands(e, ["session_id"], "event_id", F.col("value") > 20, {"peak": F.max("value")}, span).drop("session_id")


@query(f"""{E}, x AS (SELECT *, value < 30 AS s FROM e), y AS (SELECT *, (s <> coalesce(lag(s) OVER (ORDER BY event_id), NOT s))::INT AS c FROM x), z AS (SELECT *, sum(c) OVER (ORDER BY event_id) AS run FROM y)
SELECT event_id, NOT (s AND max(event_id) OVER w - min(event_id) OVER w >= 2) AS moving FROM z WINDOW w AS (PARTITION BY run)""")
def g4_motion_mask_one_session(spark, d):
    e, span = _session(spark, d, "event_id")
    out = segment.flag_runs(e, ["session_id"], "event_id", F.col("value") < 30, "still", 2, 1.0, span)
    return out.select("event_id", (~F.col("still")).alias("moving"))


@query(f"""{E}, {_ISLANDS} SELECT count(*) AS n_bouts, sum("end" - start)::DOUBLE AS time FROM i WHERE "end" - start >= 3""")
def g10_bouts_one_session(spark, d):
    e, span = _session(spark, d, "event_id")
    runs = segment.bouts(e, ["session_id"], "event_id", F.col("value") > 20, 1.0, true_start=False, span=span)
    return runs.filter(F.col("duration") >= 3).agg(F.count("*").alias("n_bouts"), F.sum("duration").alias("time"))


@query(f"""{E}, x AS (SELECT *, CASE WHEN abs(value - 30) < 5 THEN 0 ELSE value - 30 END AS v FROM e)
SELECT event_id, round(sum(v) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) / 10, 3) AS position FROM x""")
def g14_position_one_session(spark, d):
    e, span = _session(spark, d, "event_id")
    out = segment.position(e.withColumn("velocity", F.col("value") - 30), ["session_id"], "event_id", "velocity", 10, 5.0, span=span)
    return rounded(out.select("event_id", "position"), "position", digits=3)


@query(f"""{E}, x AS (SELECT *, value - lag(value) OVER w AS b, lead(value) OVER w - value AS a FROM e WINDOW w AS (ORDER BY event_id))
SELECT event_id, round((coalesce(b, a) + coalesce(a, b)) / 2 * 100, 4) AS acceleration FROM x""")
def g15_acceleration_one_session(spark, d):
    e, span = _session(spark, d, "event_id")
    out = segment.acceleration(e, ["session_id"], "event_id", "value", 10_000, span=span)
    return rounded(out.select("event_id", "acceleration"), "acceleration", digits=4)


@query(f"""{E}, x AS (SELECT *, coalesce((t - lag(t) OVER (ORDER BY t) > 36)::INT, 0) AS n FROM e), y AS (SELECT *, (sum(n) OVER (ORDER BY t) + 1)::BIGINT AS session FROM x)
SELECT session, round(min(t), 6) AS start, round(max(t), 6) AS "end", count(*) AS n FROM y GROUP BY 1""")
def g18_sessions_one_session(spark, d):
    e, span = _session(spark, d, "t")
    return rounded(segment.session_bounds(e, ["session_id"], "t", HOUR / 100, span).drop("session_id"), "start", "end")


@query(f"""{E}, x AS (SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1)::INT AS c FROM e WINDOW w AS (ORDER BY event_id)),
y AS (SELECT *, sum(c) OVER (ORDER BY event_id)::BIGINT AS instance FROM x), z AS (SELECT instance, event_type, min(event_id) AS lower, max(event_id) AS m FROM y GROUP BY ALL)
SELECT instance, event_type, lower, coalesce(lead(lower) OVER (ORDER BY instance), m) AS upper FROM z""")
def g23_change_points_one_session(spark, d):
    e, span = _session(spark, d, "event_id")
    out = segment.change_points(e, ["session_id"], "event_id", "event_type", 0, span).drop("session_id")
    return out.withColumns({c: F.col(c).cast("long") for c in ("lower", "upper")})


@query(f"{E.replace('WITH', 'WITH RECURSIVE', 1)}, {low_pass_sql('1', 10.0, 1.0)}")
def g16_low_pass_one_session(spark, d):
    e, span = _session(spark, d, "event_id")
    out = signals.low_pass(e.select("session_id", "event_id", "value"), ["session_id"], "event_id", "value", 10.0, 1.0, span=span)
    return rounded(out.select("event_id", "filtered"), "filtered")


def _steps_sql(steps: int = 12, ridge: float = 1e-3) -> str:
    """A Poisson regression on an intercept and x by Newton steps, of each unit and of each unit without one fold."""
    eta = "greatest(-20, least(20, b0 + b1 * x + o))"
    out = f"""c AS (SELECT user_id % 4 AS unit, floor(t / 21600)::INT AS bin, count(*) AS y, avg(value) / 100 AS x, ln(6.0::DOUBLE) AS o FROM e GROUP BY 1, 2),
f AS (SELECT *, bin % 5 AS fold FROM c), r AS (SELECT *, -1 AS held FROM f UNION ALL SELECT f.*, h.held FROM f JOIN (SELECT DISTINCT unit, fold AS held FROM f) h ON h.unit = f.unit AND h.held <> f.fold),
s0 AS (SELECT unit, held, ln((sum(y) + 0.1::DOUBLE) / sum(exp(o))) AS b0, 0.0::DOUBLE AS b1 FROM r GROUP BY 1, 2)"""
    for k in range(steps):
        out += f""",
t{k} AS (SELECT unit, held, sum(m) + 1e-9::DOUBLE AS a, sum(m * x) AS b, sum(m * x * x) + {ridge} + 1e-9::DOUBLE AS c, sum(m * (g - o) + y - m) AS u, sum(x * (m * (g - o) + y - m)) AS v
FROM (SELECT r.*, {eta} AS g, exp({eta}) AS m FROM r JOIN s{k} USING (unit, held)) GROUP BY 1, 2),
s{k + 1} AS (SELECT unit, held, (c * u - b * v) / (a * c - b * b) AS b0, (a * v - b * u) / (a * c - b * b) AS b1 FROM t{k})"""
    return f"""{out},
w AS (SELECT unit, count(*) AS n, sum(y) AS spikes, sum(y * g - m - lgamma(y + 1)) AS ll, sum(2 * (y * (ln(y) - g) - (y - m))) AS deviance, sum((y - m) ^ 2 / m) AS pearson FROM (SELECT f.*, {eta} AS g, exp({eta}) AS m FROM f JOIN s{steps} s ON s.unit = f.unit AND held = -1) GROUP BY 1),
p AS (SELECT unit, sum(y * g - exp(g) - lgamma(y + 1)) AS ll FROM (SELECT f.*, {eta} AS g FROM f JOIN s{steps} s ON s.unit = f.unit AND held = fold) GROUP BY 1)
SELECT s.unit, round(b0, 6) AS b0, round(b1, 6) AS b1, round(w.ll, 5) AS log_likelihood, round(4 - 2 * w.ll, 5) AS aic, round(2 * ln(n) - 2 * w.ll, 5) AS bic, round(deviance, 5) AS deviance,
round(pearson / (n - 2), 5) AS dispersion, round(p.ll / spikes / ln(2.0::DOUBLE), 6) AS cv_bits FROM s{steps} s JOIN w USING (unit) JOIN p USING (unit) WHERE held = -1"""


@query(f"{E}, {_steps_sql()}")
def l6_fits_in_steps(spark, d):
    e = events(spark, d)
    cells = e.groupBy((F.col("user_id") % 4).alias("unit"), F.floor(F.col("t") / 21_600).cast("int").alias("bin")).agg(F.count("*").alias("spike_count"), (F.avg("value") / 100).alias("x"))
    out = glm.fitted_in_steps(cells.withColumns({"dt": F.lit(6.0), "fold": F.col("bin") % 5}), ["unit"], {"speed": ["x"]})
    out = out.select("unit", F.round(F.col("beta")[0], 6).alias("b0"), F.round(F.col("beta")[1], 6).alias("b1"), "log_likelihood", "aic", "bic", "deviance", "dispersion", F.round("cv_bits", 6).alias("cv_bits"))
    return rounded(out, "log_likelihood", "aic", "bic", "deviance", "dispersion", digits=5)


@query(f"{E} SELECT floor((b.t - a.t) / 600)::INT AS bin, count(*) AS n FROM e a JOIN e b ON b.t > a.t AND b.t < a.t + 14400 GROUP BY 1")
def t19_isi_pairs_one_unit(spark, d):
    e, span = _session(spark, d, "t")
    return compare.isi_pairs(e, ["session_id"], "t", 4 * HOUR, HOUR / 6, span).drop("session_id")


_GRID = "g AS (SELECT c.cell, coalesce(count(e.t), 0)::DOUBLE AS v FROM (SELECT unnest(range(0, 720)) AS cell) c LEFT JOIN e ON floor(e.t / 3600)::INT = c.cell AND event_type = '{}' GROUP BY 1)"


@query(f"""{E}, {_GRID.format("view")}, h AS ({_GRID.format("click")[6:-1]}),
c AS (SELECT l.lag, round(corr(g.v, h.v), 9) AS r FROM (SELECT unnest(range(0, 720)) AS lag) l JOIN g ON true JOIN h ON h.cell = g.cell + l.lag GROUP BY 1),
a AS (SELECT lag FROM c WHERE lag % 24 = 0 ORDER BY CASE WHEN isnan(r) THEN NULL ELSE r END DESC NULLS LAST, lag LIMIT 1)
SELECT lag::INT AS lag, round(r, 6) AS r FROM c, (SELECT lag AS rough FROM a) WHERE lag >= rough - 12 AND lag < rough + 12 ORDER BY CASE WHEN isnan(r) THEN NULL ELSE r END DESC NULLS LAST, lag LIMIT 1""")
def g19_matched_offset(spark, d):
    cells = events(spark, d).groupBy("event_type", F.floor(F.col("t") / HOUR).cast("int").alias("cell")).agg(F.count("*").cast("double").alias("n"))
    grid = spark.range(720).select(F.lit(1).alias("trial"), F.col("id").cast("int").alias("cell"))
    trace = lambda kind: grid.join(cells.filter(F.col("event_type") == kind), "cell", "left").select("trial", "cell", F.coalesce("n", F.lit(0.0)).alias("v"))
    return rounded(segment.matched_offset(trace("view"), trace("click"), ["trial"], "cell", "v", 24).drop("trial"), "r")


_ADDITIVE = """c{0} AS (SELECT unit, part AS a, k AS b, sum(v) AS s, count(*) AS m, sum(v * v) AS q FROM r WHERE part IN ('baseline', '{0}') GROUP BY ALL),
ra{0} AS (SELECT unit, sum(s * s / m) AS v, count(*) AS k FROM (SELECT unit, a, sum(s) AS s, sum(m) AS m FROM c{0} GROUP BY ALL) GROUP BY 1), rb{0} AS (SELECT unit, sum(s * s / m) AS v, count(*) AS k FROM (SELECT unit, b, sum(s) AS s, sum(m) AS m FROM c{0} GROUP BY ALL) GROUP BY 1),
t{0} AS (SELECT unit, sum(s) AS s, sum(m) AS n, sum(q) AS q FROM c{0} GROUP BY 1),
f{0} AS (SELECT t.unit, (ra.v - s * s / n) / (ra.k - 1) / ((q - ra.v - rb.v + s * s / n) / (n - ra.k - rb.k + 1)) AS f FROM t{0} t JOIN ra{0} ra USING (unit) JOIN rb{0} rb USING (unit))"""


@query(f"""{E}, w AS (SELECT user_id, event_id AS trial, part, k, t + (off * 4 + k) * 21600.0::DOUBLE AS w0, t + (off * 4 + k + 1) * 21600.0::DOUBLE AS w1 FROM e, (VALUES ('control', -2), ('baseline', -1), ('response', 0)) p(part, off), (SELECT unnest(range(0, 4)) AS k) WHERE event_type = 'error'),
r AS (SELECT w.user_id % 5 AS unit, trial, part, k, count(e.t) / any_value(w1 - w0) AS v FROM w LEFT JOIN e ON e.user_id = w.user_id AND e.t >= w0 AND e.t < w1 GROUP BY ALL),
{_ADDITIVE.format("response")}, {_ADDITIVE.format("control")}, m AS (SELECT unit, avg(CASE WHEN part = 'baseline' THEN v END) AS baseline, avg(CASE WHEN part = 'response' THEN v END) AS response FROM r GROUP BY 1)
SELECT unit, round(baseline * 86400, 8) AS baseline, round(response * 86400, 8) AS response, round(x.f, 5) AS f_response, round(y.f, 5) AS f_control FROM m JOIN fresponse x USING (unit) JOIN fcontrol y USING (unit)""")
def t4_mismatch_anova(spark, d):
    e = events(spark, d)
    onsets = e.filter("event_type = 'error'").select("user_id", (F.col("user_id") % 5).alias("unit"), F.col("event_id").alias("trial"), F.col("t").alias("onset"))
    out = compare.mismatch_anova(e.select("user_id", "t"), onsets, ["user_id"], ["unit"], "trial", "onset", 4, 6 * HOUR, p_values=False)
    out = out.withColumns({c: F.col(c) * 86_400 for c in ("baseline", "response")})
    return rounded(rounded(out, "baseline", "response", digits=8), "f_response", "f_control", digits=5)


@query(f"""{E}, u AS (SELECT user_id, event_id, value, t, min(t) OVER u AS a, max(t) OVER u AS b, coalesce(lead(t) OVER o - t, 0) AS dt FROM e WINDOW u AS (PARTITION BY user_id), o AS (PARTITION BY user_id ORDER BY t))
SELECT event_id, round(least(100, 100 * sum(value * dt) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) / sum(greatest(value, 0.1::DOUBLE) * dt) OVER (PARTITION BY user_id)), 4) AS progress FROM u""")
def f17_spline_progress(spark, d):
    """All samples run, so the planned speed goes through all of them."""
    e = events(spark, d).select("user_id", "event_id", "t", "value")
    return rounded(compare.trip_progress(e, ["user_id"], "t", "value", running=-1.0, plan="spline").select("event_id", "progress"), "progress", digits=4)
