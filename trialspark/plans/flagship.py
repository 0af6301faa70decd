"""The flagship question: which units fire differently in motion than at rest?

Event types are units, users trials. A user is in motion during runs of values above 20, at rest during the others. Rates
of each type in both kinds of interval make the central table; a signed-rank test over users tells the types that differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.operators import intervals, segment, stats
from trialspark.plans.event_queries import DAY, E, events, rounded

QUERIES, ORACLES = {}, {}


def rates_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_type, stationary_fr, stationary_time, motion_fr and motion_time."""
    e = events(spark, sf_dir)
    state = F.when(F.col("value") > 20, "motion").when(F.col("value") <= 20, "stationary")
    runs = segment.states(e, ["user_id"], "t", state).select("user_id", "state", F.col("start").alias("w0"), F.col("end").alias("w1")).filter("w1 > w0")
    within = intervals.range_join(e.select("user_id", "event_type", "t"), runs, ["user_id"], "t", "w0", "w1", DAY, "both")
    spikes = within.groupBy("user_id", "event_type").agg(*(F.count_if(F.col("state") == s).alias(f"_{s}") for s in ("stationary", "motion")))
    times = runs.groupBy("user_id").agg(*(F.sum(F.when(F.col("state") == s, F.col("w1") - F.col("w0"))).alias(f"{s}_time") for s in ("stationary", "motion")))
    out = e.select("user_id", "event_type").distinct().join(times, "user_id").join(spikes, ["user_id", "event_type"], "left")
    rates = [(F.coalesce(f"_{s}", F.lit(0)) / F.col(f"{s}_time")).alias(f"{s}_fr") for s in ("stationary", "motion")]
    return out.select("user_id", "event_type", rates[0], "stationary_time", rates[1], "motion_time")


def f14_stationary_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rates_by_state(spark, sf_dir)
    return rounded(rounded(out, "stationary_time", "motion_time", digits=4), "stationary_fr", "motion_fr", digits=10)


def t2_stationary_vs_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.signed_rank(rates_by_state(spark, sf_dir), ["event_type"], "stationary_fr", "motion_fr", p_values=False, digits=12)
    return rounded(rounded(out.select("event_type", "n", "n_used", "w_plus", "w_minus", "z"), "z"), "w_plus", "w_minus", digits=2)


def t2_significant_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.signed_rank(rates_by_state(spark, sf_dir), ["event_type"], "stationary_fr", "motion_fr", digits=12), "z", "p").withColumns({c: F.round(c, 12) for c in ("x_median", "y_median")})


_SIDE = """{n}_y AS (SELECT *, (f AND NOT coalesce(lag(f) OVER w, false))::INT AS s FROM (SELECT *, value {op} 20 AS f FROM e) WINDOW w AS (PARTITION BY user_id ORDER BY t)),
{n}_z AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY t) AS island FROM {n}_y), {n}_i AS (SELECT user_id, min(t) AS w0, max(t) AS w1 FROM {n}_z WHERE f GROUP BY user_id, island HAVING max(t) > min(t)),
{n}_d AS (SELECT user_id, sum(w1 - w0) AS dt FROM {n}_i GROUP BY 1), {n}_n AS (SELECT i.user_id, e.event_type, count(*) AS k FROM {n}_i i JOIN e ON e.user_id = i.user_id AND e.t BETWEEN w0 AND w1 GROUP BY 1, 2),
{n} AS (SELECT u.user_id, u.event_type, coalesce(k, 0) / dt AS fr, dt FROM (SELECT DISTINCT user_id, event_type FROM e) u JOIN {n}_d USING (user_id) LEFT JOIN {n}_n USING (user_id, event_type))"""
_BOTH = f"{E}, {_SIDE.format(n='rest', op='<=')}, {_SIDE.format(n='move', op='>')}, b AS (SELECT user_id, event_type, r.fr AS stationary_fr, r.dt AS stationary_time, m.fr AS motion_fr, m.dt AS motion_time FROM rest r FULL JOIN move m USING (user_id, event_type))"

ORACLES["f14_stationary_motion"] = f"{_BOTH} SELECT user_id, event_type, round(stationary_fr, 10) AS stationary_fr, round(stationary_time, 4) AS stationary_time, round(motion_fr, 10) AS motion_fr, round(motion_time, 4) AS motion_time FROM b"
ORACLES["t2_stationary_vs_motion"] = f"""{_BOTH}, pr AS (SELECT event_type, round(stationary_fr - motion_fr, 12) AS d FROM b WHERE stationary_fr IS NOT NULL AND motion_fr IS NOT NULL),
u AS (SELECT event_type, d, rank() OVER (PARTITION BY event_type ORDER BY abs(d)) + (count(*) OVER (PARTITION BY event_type, abs(d)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY event_type, abs(d)) AS ties FROM pr WHERE d <> 0),
w AS (SELECT event_type, count(*) AS n_used, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus, sum(ties * ties - 1) AS tie FROM u GROUP BY 1)
SELECT event_type, (SELECT count(*) FROM pr WHERE pr.event_type = w.event_type) AS n, n_used, round(w_plus, 2) AS w_plus, round(w_minus, 2) AS w_minus,
round(sign(w_plus - n_used * (n_used + 1) / 4.0::DOUBLE) * greatest(abs(w_plus - n_used * (n_used + 1) / 4.0::DOUBLE) - 0.5, 0) / sqrt(n_used * (n_used + 1) * (2 * n_used + 1) / 24.0::DOUBLE - tie / 48.0::DOUBLE), 6) AS z FROM w"""
QUERIES |= {f.__name__: f for f in (f14_stationary_motion, t2_stationary_vs_motion, t2_significant_units)}
