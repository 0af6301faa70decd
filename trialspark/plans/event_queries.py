"""Queries over `events`: users are units, events spikes or samples, event types conditions; t is seconds since 2024-01-01."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.functions import basis
from trialspark.operators import glm, intervals, rates, rf, segment, signals, stats, tuning

DAY, HOUR = 86_400.0, 3_600.0


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", (us / F.lit(1e6)).alias("t"))


#: Begins the SQL of the queries below.
E = "WITH e AS (SELECT event_id, user_id, event_type, value, (epoch_us(ts) - 1704067200000000) / 1e6::DOUBLE AS t FROM events)"
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def rounded_scaled(df: DataFrame, *columns: str, digits: int) -> DataFrame:
    """Columns rounded as DuckDB does: the double times a power of ten, halves away from zero. Spark's own rounding takes the
    double's decimal digits, which goes the other way for some values that are a half in the last place but one."""
    scaled = lambda c: F.col(c) * F.lit(10.0**digits)
    return df.withColumns({c: F.round(F.abs(scaled(c))) * F.signum(scaled(c)) / F.lit(10.0**digits) for c in columns})


@query(f"""{E}, x AS (SELECT *, (value > 250)::INT AS f FROM e), y AS (SELECT *, f - lag(f) OVER (PARTITION BY user_id ORDER BY event_id) AS edge FROM x)
SELECT user_id, event_id, edge FROM y WHERE edge <> 0""")
def g1_edges(spark, d):
    return segment.edges(events(spark, d), ["user_id"], "event_id", F.col("value") > 250).select("user_id", "event_id", "edge")


_ISLANDS = """x AS (SELECT *, value > 20 AS f FROM e), y AS (SELECT *, (f AND NOT coalesce(lag(f) OVER w, false))::INT AS s FROM x WINDOW w AS (PARTITION BY user_id ORDER BY t)),
z AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY t)::BIGINT AS island FROM y),
i AS (SELECT user_id, island, min(t) AS start, max(t) AS "end", count(*) AS n, max(value) AS peak FROM z WHERE f GROUP BY ALL)"""


@query(f'{E}, {_ISLANDS} SELECT user_id, island, round(start, 6) AS start, round("end", 6) AS "end", n, peak FROM i')
def g3_islands(spark, d):
    out = segment.islands(events(spark, d), ["user_id"], "t", F.col("value") > 20, {"peak": F.max("value")})
    return rounded(out, "start", "end")


@query(f"""{E}, {_ISLANDS} SELECT user_id, count(*) AS n_bouts, round(sum("end" - start), 6) AS time FROM i WHERE "end" - start >= 36000 GROUP BY 1""")
def g10_bouts(spark, d):
    runs = segment.bouts(events(spark, d), ["user_id"], "t", F.col("value") > 20, 1.0, true_start=False)
    out = runs.filter(F.col("duration") >= 10 * HOUR).groupBy("user_id").agg(F.count("*").alias("n_bouts"), F.sum("duration").alias("time"))
    return rounded(out, "time")


@query(f"""{E}, x AS (SELECT *, value < 15 AS s FROM e), y AS (SELECT *, (s <> coalesce(lag(s) OVER (PARTITION BY user_id ORDER BY t), NOT s))::INT AS c FROM x),
z AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY t) AS run FROM y)
SELECT event_id, user_id, NOT (s AND max(t) OVER w - min(t) OVER w >= 20000) AS moving FROM z WINDOW w AS (PARTITION BY user_id, run)""")
def g4_motion_mask(spark, d):
    out = segment.flag_runs(events(spark, d), ["user_id"], "t", F.col("value") < 15, "still", 20_000, 1.0)
    return out.select("event_id", "user_id", (~F.col("still")).alias("moving"))


@query(f"""{E}, x AS (SELECT *, CASE WHEN abs(value - 30) < 5 THEN 0 ELSE value - 30 END AS v FROM e)
SELECT user_id, event_id, round(sum(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) / 10, 4) AS position FROM x""")
def g14_position(spark, d):
    df = events(spark, d).withColumn("velocity", F.col("value") - 30)
    return rounded(segment.position(df, ["user_id"], "event_id", "velocity", 10, 5.0).select("user_id", "event_id", "position"), "position", digits=4)


@query(f"""{E}, x AS (SELECT *, value - lag(value) OVER w AS b, lead(value) OVER w - value AS a FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, round((coalesce(b, a) + coalesce(a, b)) / 2 * 100, 4) AS acceleration FROM x""")
def g15_acceleration(spark, d):
    out = segment.acceleration(events(spark, d), ["user_id"], "event_id", "value", 10_000)
    return rounded(out.select("user_id", "event_id", "acceleration"), "acceleration", digits=4)


@query(f"""{E}, x AS (SELECT *, coalesce((t - lag(t) OVER w > 43200)::INT, 0) AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
y AS (SELECT *, (sum(n) OVER (PARTITION BY user_id ORDER BY t) + 1)::BIGINT AS session FROM x)
SELECT user_id, session, round(min(t), 6) AS start, round(max(t), 6) AS "end", count(*) AS n FROM y GROUP BY 1, 2""")
def g18_sessions(spark, d):
    return rounded(segment.session_bounds(events(spark, d), ["user_id"], "t", 12 * HOUR), "start", "end")


@query(f"""{E}, x AS (SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1)::INT AS c FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
y AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS instance FROM x),
z AS (SELECT user_id, instance, event_type, min(event_id) AS lower, max(event_id) AS m FROM y GROUP BY ALL)
SELECT user_id, instance, event_type, lower, coalesce(lead(lower) OVER (PARTITION BY user_id ORDER BY instance), m) AS upper FROM z""")
def g23_change_points(spark, d):
    out = segment.change_points(events(spark, d), ["user_id"], "event_id", "event_type", 0)
    return out.withColumns({c: F.col(c).cast("long") for c in ("lower", "upper")})


_HOURLY = """h AS (SELECT user_id // 2 AS pair, user_id % 2 AS side, floor(t / 21600)::INT AS cell, count(*) AS n FROM e GROUP BY ALL),
g AS (SELECT p.pair, p.side, c.cell, coalesce(h.n, 0)::DOUBLE AS v FROM (SELECT DISTINCT pair, side FROM h) p, (SELECT unnest(range(0, 120)) AS cell) c
LEFT JOIN h ON h.pair = p.pair AND h.side = p.side AND h.cell = c.cell)"""


@query(f"""{E}, {_HOURLY}, s AS (SELECT o.pair, l.lag, round(corr(o.v, r.v), 9) AS r FROM (SELECT unnest(range(-8, 9)) AS lag) l, g o JOIN g r ON o.pair = r.pair AND o.side = 0 AND r.side = 1
WHERE r.cell - l.lag = o.cell GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY r DESC, lag) AS place FROM s)
SELECT pair, lag::INT AS lag, round(r, 6) AS r FROM k WHERE place = 1""")
def g19_replay_lag(spark, d):
    counts = events(spark, d).groupBy(F.floor(F.col("user_id") / 2).alias("pair"), (F.col("user_id") % 2).alias("side"), F.floor(F.col("t") / 21_600).cast("int").alias("cell")).agg(F.count("*").alias("n"))
    cells = counts.select("pair", "side").distinct().withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(119))))
    dense = cells.join(counts, ["pair", "side", "cell"], "left").withColumn("v", F.coalesce("n", F.lit(0)).cast("double"))
    original, replay = (dense.filter(F.col("side") == k).select("pair", "cell", "v") for k in (0, 1))
    return rounded(segment.best_lag(original, replay, ["pair"], "cell", "v", list(range(-8, 9))), "r")


_WINDOWS = "w AS (SELECT user_id, event_id AS trigger_id, t AS w0, t + 86400 AS w1 FROM e WHERE event_type = 'signup')"


@query(f"""{E}, {_WINDOWS} SELECT w.user_id, w.trigger_id, count(e.t) AS n_spikes, round(any_value(w1 - w0), 6) AS dt, round(count(e.t) / any_value(w1 - w0), 12) AS rate
FROM w LEFT JOIN e ON e.user_id = w.user_id AND e.t >= w0 AND e.t < w1 GROUP BY 1, 2""")
def f4_window_rates(spark, d):
    e = events(spark, d)
    windows = e.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("trigger_id"), F.col("t").alias("w0"), (F.col("t") + DAY).alias("w1"))
    out = rounded(intervals.window_rates(e, windows, ["user_id"], ["trigger_id"], DAY), "dt")
    return rounded(out, "rate", digits=12)


@query(f"{E} SELECT user_id, floor(t / 60 + 1.5)::BIGINT AS sample, count(*) AS n FROM e GROUP BY 1, 2")
def f1_spike_train(spark, d):
    return rates.spike_train(events(spark, d), ["user_id"], 1 / 60)


@query(f"{E} SELECT user_id, floor((t - 864000) / 43200)::INT AS bin, count(*) AS n FROM e WHERE t > 864000 AND t < 1728000 GROUP BY 1, 2")
def f6_histogram(spark, d):
    return rates.histogram(events(spark, d), ["user_id"], 10 * DAY, 20 * DAY, DAY / 2)


_AROUND = "p AS (SELECT s.user_id, s.event_id AS trigger_id, q.event_id, q.event_type, q.value, q.t - s.t AS lag FROM e s JOIN e q ON s.user_id = q.user_id AND s.event_type = 'signup' AND q.t > s.t - 172800 AND q.t < s.t + 172800)"


@query(f"""{E}, {_AROUND}, b AS (SELECT user_id, floor(lag / 21600)::INT AS bin, count(*) AS n FROM p WHERE event_type = 'purchase' AND lag <> floor(lag / 21600) * 21600 GROUP BY 1, 2)
SELECT u.user_id, k.bin::INT AS bin, coalesce(b.n, 0) AS n FROM (SELECT DISTINCT user_id FROM e WHERE event_type = 'signup') u CROSS JOIN (SELECT unnest(range(-8, 8)) AS bin) k
LEFT JOIN b ON b.user_id = u.user_id AND b.bin = k.bin""")
def f7_psth(spark, d):
    e = events(spark, d)
    triggers = e.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("trigger_id"), F.col("t").alias("t0"))
    return intervals.psth(e.filter("event_type = 'purchase'").select("user_id", "t"), triggers, ["user_id"], 6 * HOUR, 2 * DAY, 2 * DAY)


@query(f"{E}, {_AROUND} SELECT user_id, trigger_id, event_id, round(lag, 6) AS lag FROM p")
def f8_raster(spark, d):
    e = events(spark, d)
    triggers = e.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("trigger_id"), F.col("t").alias("t0"))
    out = intervals.raster(e.select("user_id", "event_id", "t"), triggers, ["user_id"], 2 * DAY, 2 * DAY)
    return rounded(out.select("user_id", "trigger_id", "event_id", "lag"), "lag")


@query(f"""{E}, {_AROUND}, h AS (SELECT user_id, round(avg(CASE WHEN lag >= -86400 AND lag < 0 THEN value END), 8) AS baseline, round(avg(CASE WHEN lag >= 0 AND lag < 86400 THEN value END), 8) AS response FROM p GROUP BY 1)
SELECT *, round(response - baseline, 4) AS delta, row_number() OVER (ORDER BY round(response - baseline, 4) NULLS FIRST, user_id)::INT AS place FROM h""")
def f10_heatmap(spark, d):
    e = events(spark, d)
    triggers = e.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("trigger_id"), F.col("t").alias("t0"))
    around = intervals.raster(e.select("user_id", "value", "t"), triggers, ["user_id"], 2 * DAY, 2 * DAY)
    out = rounded_scaled(rates.responses_within(around, ["user_id"], "lag", "value", (-DAY, 0), (0, DAY)), "baseline", "response", digits=8)
    return rates.response_order(rounded_scaled(out.withColumn("delta", F.col("response") - F.col("baseline")), "delta", digits=4), ["user_id"])


_KERNEL = f"{rates._table(3600.0, 86400.0, 1000)}"


@query(f"""{E}, {_ISLANDS}, a AS (SELECT user_id, start - 7200 AS w0, "end" + 7200 AS w1 FROM i), b AS (SELECT *, (w0 > coalesce(max(w1) OVER (PARTITION BY user_id ORDER BY w0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w0 - 1))::INT AS new FROM a),
o AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY w0) AS k FROM b), v AS (SELECT user_id, min(w0) AS w0, max(w1) AS w1 FROM o GROUP BY user_id, k),
c AS (SELECT v.user_id, v.w0, v.w1, e.t, greatest(0, least(1000, (w1 - t + 86400) * (1000 / 172800.0::DOUBLE))) AS hi, greatest(0, least(1000, (w0 - t + 86400) * (1000 / 172800.0::DOUBLE))) AS lo
FROM v JOIN e ON e.user_id = v.user_id AND e.t >= w0 - 86400 AND e.t <= w1 + 86400),
k AS (SELECT {_KERNEL} AS a),
m AS (SELECT user_id, a[least(floor(hi), 999)::INT + 1] + (a[least(floor(hi), 999)::INT + 2] - a[least(floor(hi), 999)::INT + 1]) * (hi - least(floor(hi), 999))
- a[least(floor(lo), 999)::INT + 1] - (a[least(floor(lo), 999)::INT + 2] - a[least(floor(lo), 999)::INT + 1]) * (lo - least(floor(lo), 999)) AS mass FROM c, k),
s AS (SELECT user_id, sum(mass) AS mass FROM m GROUP BY 1), g AS (SELECT user_id, sum(w1 - w0) AS dt FROM v GROUP BY 1)
SELECT user_id, round(dt, 4) AS dt, round(coalesce(mass, 0) / dt, 10) AS rate FROM g LEFT JOIN s USING (user_id)""")
def f2_smoothed_means(spark, d):
    e = events(spark, d)
    runs = segment.islands(e, ["user_id"], "t", F.col("value") > 20)
    windows = runs.select("user_id", (F.col("start") - 7200).alias("w0"), (F.col("end") + 7200).alias("w1"))
    out = rates.smoothed_means(e, segment.merged(windows, ["user_id"]), ["user_id"], [], DAY, HOUR, DAY)
    return rounded(rounded(out, "dt", digits=4), "rate", digits=10)


@query(f"""{E}, x AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t) - t AS dt FROM e),
v AS (SELECT floor(value / 20)::INT AS bin, sum(dt) AS occupancy, avg(t) AS mean_speed FROM x GROUP BY 1), n AS (SELECT event_type, floor(value / 20)::INT AS bin, count(*) AS n FROM x GROUP BY 1, 2)
SELECT u.event_type, v.bin, round(occupancy, 4) AS occupancy, coalesce(n.n, 0) AS n, round(CASE WHEN occupancy > 0 THEN coalesce(n.n, 0) / occupancy END, 10) AS rate
FROM v CROSS JOIN (SELECT DISTINCT event_type FROM e) u LEFT JOIN n ON n.bin = v.bin AND n.event_type = u.event_type""")
def f15_spatial_map(spark, d):
    from pyspark.sql import Window

    e = events(spark, d).withColumn("place", F.col("value")).withColumn("one", F.lit(1))
    samples = e.withColumn("dt", F.lead("t").over(Window.partitionBy("user_id").orderBy("t")) - F.col("t"))
    out = rates.spatial_map(e, samples, ["one"], "event_type", 20.0, "dt")
    return rounded(rounded(out.drop("one"), "occupancy", digits=4), "rate", digits=10)


@query(f"""{E}, v AS (SELECT user_id, t, value, lead(t) OVER w AS nt, lead(value) OVER w AS nv FROM e WHERE event_type = 'view' WINDOW w AS (PARTITION BY user_id ORDER BY t)),
p AS (SELECT * FROM e WHERE event_type = 'purchase')
SELECT p.user_id, p.event_id, round(v.value + (v.nv - v.value) / (v.nt - v.t) * (p.t - v.t), 6) AS value_at FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.t >= v.t""")
def j11_interpolated(spark, d):
    e = events(spark, d)
    out = intervals.interpolated(e.filter("event_type = 'purchase'").select("user_id", "event_id", "t"), e.filter("event_type = 'view'").select("user_id", "t", "value"), ["user_id"], "t", "value")
    return rounded(out.select("user_id", "event_id", "value_at"), "value_at")


@query(f"""{E}, a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM e WHERE event_type = 'click'),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM e WHERE event_type = 'error')
SELECT a.user_id, a.event_id, b.event_id AS b_event_id FROM a JOIN b ON a.user_id = b.user_id AND a.k = b.k WHERE abs(a.event_id - b.event_id) <= 2000""")
def j10_pairs_by_place(spark, d):
    e = events(spark, d).select("user_id", "event_id", "event_type")
    out = intervals.pairs_by_place(e.filter("event_type = 'click'"), e.filter("event_type = 'error'"), ["user_id"], "event_id", 2000)
    return out.select("user_id", "event_id", "b_event_id")


@query(f"""{E}, x AS (SELECT user_id, event_id, floor(value)::INT AS name, event_type = 'view' AS replay FROM e),
o AS (SELECT user_id, name, count(*) AS n, min(event_id) AS m FROM x WHERE NOT replay GROUP BY 1, 2)
SELECT x.user_id, x.event_id, CASE WHEN replay AND n = 1 THEN m END AS original FROM x LEFT JOIN o USING (user_id, name)""")
def j8_replayed_originals(spark, d):
    e = events(spark, d).select("user_id", "event_id", F.floor("value").cast("int").alias("name"), (F.col("event_type") == "view").alias("replay"))
    return intervals.replayed_originals(e, ["user_id"], "name", "replay", "event_id").select("user_id", "event_id", "original")


@query(f"""{E}, x AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS isi FROM e),
z AS (SELECT user_id, count(*) AS n, coalesce(sum((isi < 3600)::INT), 0)::BIGINT AS violations, max(t) - min(t) AS duration FROM x GROUP BY 1)
SELECT user_id, n, violations, round(duration, 4) AS duration, round(CASE WHEN duration > 0 THEN (violations / (2 * 3540.0::DOUBLE * n)) / (n / duration) END, 8) AS fp_rate FROM z""")
def t18_isi_violations(spark, d):
    out = stats.isi_violations(events(spark, d), ["user_id"], "t", HOUR, 60.0)
    return rounded(rounded(out, "duration", digits=4), "fp_rate", digits=8)


@query(f"{E}, c AS (SELECT user_id, event_type, count(*) AS n FROM e GROUP BY 1, 2) SELECT user_id, sum(n)::BIGINT AS n, count(*) - 1 AS df, round(sum(n * n) * count(*) / sum(n) - sum(n), 6) AS chi2 FROM c GROUP BY 1")
def t13_chi2_equal(spark, d):
    return rounded(stats.chi2_equal(events(spark, d), ["user_id"], "event_type").drop("p"), "chi2")


@query(f"""{E}, m AS (SELECT user_id, avg(CASE WHEN event_type = 'click' THEN value END) AS x, avg(CASE WHEN event_type = 'purchase' THEN value END) AS y FROM e GROUP BY 1)
SELECT user_id, round((y - x) / (y + x), 6) AS mi FROM m""")
def t8_modulation_index(spark, d):
    side = lambda v: F.avg(F.when(F.col("event_type") == v, F.col("value")))
    out = events(spark, d).groupBy("user_id").agg(side("click").alias("x"), side("purchase").alias("y"))
    return out.select("user_id", F.round(stats.modulation_index(F.col("x"), F.col("y")), 6).alias("mi"))


@query(f"{E} SELECT event_id, round((value - avg(CASE WHEN t < 864000 THEN value END) OVER w) / stddev_samp(CASE WHEN t < 864000 THEN value END) OVER w, 6) AS z FROM e WINDOW w AS (PARTITION BY user_id)")
def t14_zscore(spark, d):
    return rounded(stats.zscore(events(spark, d), ["user_id"], "value", F.col("t") < 10 * DAY).select("event_id", "z"), "z")


@query(f"""{E}, m AS (SELECT user_id, avg(CASE WHEN t < 864000 THEN value END) AS before, stddev_samp(CASE WHEN t < 864000 THEN value END) AS sd, avg(CASE WHEN t >= 864000 THEN value END) AS after FROM e GROUP BY 1)
SELECT user_id, round(before, 6) AS before, round(sd, 6) AS sd, round(after, 6) AS after, after < before - 0.2 * sd AS dropped FROM m""")
def t15_running_drops(spark, d):
    out = stats.drops(events(spark, d), ["user_id"], "value", F.col("t") < 10 * DAY, F.col("t") >= 10 * DAY, 0.2)
    return rounded(out, "before", "sd", "after")


@query(f"""{E}, x AS (SELECT user_id % 3 AS unit, event_type AS a, (floor(t / 21600) % 4)::INT AS b, value FROM e), c AS (SELECT unit, a, b, sum(value) AS s, count(*) AS m, sum(value * value) AS q FROM x GROUP BY ALL),
ra AS (SELECT unit, sum(s * s / m) AS v, count(*) AS k FROM (SELECT unit, a, sum(s) AS s, sum(m) AS m FROM c GROUP BY ALL) GROUP BY 1), rb AS (SELECT unit, sum(s * s / m) AS v, count(*) AS k FROM (SELECT unit, b, sum(s) AS s, sum(m) AS m FROM c GROUP BY ALL) GROUP BY 1),
t AS (SELECT unit, sum(s) AS s, sum(m) AS n, sum(q) AS q, sum(s * s / m) AS v, count(*) AS k FROM c GROUP BY 1),
z AS (SELECT t.unit, n, ra.v - s * s / n AS sa, rb.v - s * s / n AS sb, t.v - s * s / n AS sc, (q - t.v) / (n - t.k) AS er, ra.k - 1 AS da, rb.k - 1 AS db FROM t JOIN ra USING (unit) JOIN rb USING (unit))
SELECT unit, n::BIGINT AS n, round(sa / da / er, 5) AS f_a, round(sb / db / er, 5) AS f_b, round((sc - sa - sb) / (da * db) / er, 5) AS f_ab FROM z""")
def t4_two_way_anova(spark, d):
    e = events(spark, d).select((F.col("user_id") % 3).alias("unit"), F.col("event_type").alias("a"), (F.floor(F.col("t") / 21_600) % 4).cast("int").alias("b"), "value")
    return rounded(stats.two_way_anova(e, ["unit"], "a", "b", "value", p_values=False), "f_a", "f_b", "f_ab", digits=5)


@query(f"""{E}, x AS (SELECT event_type, value, t, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::DOUBLE AS r FROM e)
SELECT event_type, round(r, 2) AS rank, t FROM x""")
def t1_mid_ranks(spark, d):
    return stats.mid_ranks(events(spark, d), ["event_type"], "value").select("event_type", "rank", "t")


@query(f"""{E}, x AS (SELECT event_id, user_id % 5 AS unit, event_id % (SELECT count(*) FROM embeddings) AS frame FROM e), c AS (SELECT unit, frame, count(*) AS n FROM x GROUP BY ALL),
p AS (SELECT unit, n, unnest(range(0, len(embedding))) AS pixel, unnest(embedding)::DOUBLE AS v FROM c JOIN embeddings ON vec_id = frame)
SELECT unit, pixel::INT AS pixel, round(sum(n * v) / sum(n), 6) AS sta, sum(n)::BIGINT AS n_spikes FROM p GROUP BY 1, 2""")
def v8_frame_average(spark, d):
    frames = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("frame"), F.col("embedding").alias("pixels"))
    n = frames.agg(F.count("*")).scalar()
    counts = events(spark, d).select((F.col("user_id") % 5).alias("unit"), (F.col("event_id") % n).alias("frame")).groupBy("unit", "frame").agg(F.count("*").alias("n"))
    return rounded(rf.frame_average(counts, frames, ["unit"]), "sta")



@query(f"""{E}, x AS (SELECT user_id, ln(greatest(value, 0) + 0.5) AS u FROM e), k AS (SELECT unnest(range(0, 5)) AS j),
b AS (SELECT user_id, j, CASE WHEN abs(u - (ln(0.5) + j * s)) <= 1.5 * s THEN 0.5 * (1 + cos((u - (ln(0.5) + j * s)) * (pi() / (1.5 * s)))) ELSE 0 END AS v FROM x, k, (SELECT (ln(500.5) - ln(0.5)) / 4 AS s))
SELECT user_id, j::INT AS j, round(sum(v), 6) AS weight FROM b GROUP BY 1, 2""")
def l3_raised_cosine(spark, d):
    spread = events(spark, d).select("user_id", F.posexplode(basis.raised_cosine(F.col("value"), 5, 0.0, 500.0)).alias("j", "v"))
    return rounded(spread.groupBy("user_id", "j").agg(F.sum("v").alias("weight")), "weight")


@query(f"""{E}, d AS (SELECT DISTINCT user_id % 7 AS unit, user_id AS trial, event_type AS condition FROM e),
r AS (SELECT *, ((row_number() OVER (PARTITION BY unit, condition ORDER BY (trial % 2147483647 * 48271 + 16807) % 2147483647 * 39373 % 2147483647, trial) - 1) % 5)::INT AS fold FROM d)
SELECT unit, trial, condition, fold FROM r""")
def l7_folds(spark, d):
    rows = events(spark, d).select((F.col("user_id") % 7).alias("unit"), F.col("user_id").alias("trial"), F.col("event_type").alias("condition")).distinct()
    return glm.folds(rows, ["unit"], "trial", "condition").select("unit", "trial", "condition", "fold")


def _glm_bins(spark, d):
    e = events(spark, d).withColumn("unit", F.col("user_id") % 4)
    cells = e.groupBy("unit", F.floor(F.col("t") / 21_600).cast("int").alias("bin")).agg(F.count("*").alias("spike_count"), F.avg("value").alias("speed"), F.max("event_type").alias("condition"))
    cells = cells.withColumns({"dt": F.lit(6.0), "speed_basis": basis.raised_cosine(F.col("speed"), 4, 0.0, 500.0), "phase": F.array(F.cos(F.col("bin") * 1.5707963267948966), F.sin(F.col("bin") * 1.5707963267948966))})
    cells = cells.withColumn("speed_phase", basis.products(F.col("speed_basis"), F.col("phase")))
    return glm.folds(cells, ["unit"], "bin", "condition")


@query()
def l6_poisson_fits(spark, d):
    out = glm.fitted(_glm_bins(spark, d), ["unit"], ["bin"], {"null": [], "speed": ["speed_basis"], "additive": ["speed_basis", "phase"]})
    return out.select("unit", "model", F.transform("beta", lambda b: F.round(b, 6)).alias("beta"), *(F.round(c, 5).alias(c) for c in ("log_likelihood", "aic", "bic", "deviance", "dispersion", "cv_bits")))


@query()
def l9_forward_selection(spark, d):
    out = glm.forward_selected(_glm_bins(spark, d), ["unit"], ["bin"], ["speed_basis", "phase"], {"speed_phase": ("speed_basis", "phase")})
    return rounded(out, "cv_bits", "gain")


@query(f"""{E}, h AS (SELECT event_type, floor(t / 86400)::INT AS day, avg(value) AS v FROM e GROUP BY 1, 2),
x AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY event_type) AS n FROM h WINDOW w AS (PARTITION BY event_type ORDER BY day))
SELECT a.event_type, a.day, round(avg(b.v), 6) AS smooth FROM x a JOIN x b ON a.event_type = b.event_type AND abs(a.i - b.i) <= least(3, a.i - 1, a.n - a.i) GROUP BY 1, 2""")
def w4_moving_average(spark, d):
    daily = events(spark, d).groupBy("event_type", F.floor(F.col("t") / DAY).cast("int").alias("day")).agg(F.avg("value").alias("v"))
    return rounded(signals.moving_average(daily, ["event_type"], "day", "v", 3).select("event_type", "day", "smooth"), "smooth")


def low_pass_sql(partition: str, rate: float, cutoff: float) -> str:
    """A third-order filter forward, then reversed, as recursive steps of three states."""
    filt = signals.low_pass_recurrence(3, cutoff, rate)
    number = lambda v: f"({float(v)!r}::DOUBLE)"
    times = lambda row, x: " + ".join([*(f"{number(v)} * s.z{j}" for j, v in enumerate(row)), x])
    states = ", ".join(f"{times(row, f'{number(v)} * n.v')} AS z{i}" for i, (row, v) in enumerate(zip(filt.step, filt.input, strict=True)))
    first = ", ".join(f"{number(v)} * v AS z{i}" for i, v in enumerate(filt.input))
    y = times(filt.out, f"{number(filt.direct)} * n.v")
    step = lambda t: f"SELECT k, i, {number(filt.direct)} * v AS y, {first} FROM {t} WHERE i = 1 UNION ALL SELECT n.k, n.i, {y}, {states} FROM r{t} s JOIN {t} n ON n.k = s.k AND n.i = s.i + 1"
    return f"""x AS (SELECT {partition} AS k, event_id, value::DOUBLE AS v, row_number() OVER (PARTITION BY {partition} ORDER BY event_id) AS i FROM e), rx AS ({step("x")}),
w AS (SELECT k, y AS v, row_number() OVER (PARTITION BY k ORDER BY i DESC) AS i, max(i) OVER (PARTITION BY k) + 1 - row_number() OVER (PARTITION BY k ORDER BY i DESC) AS at FROM rx), rw AS ({step("w")})
SELECT x.event_id, round(rw.y, 6) AS filtered FROM x JOIN w ON w.k = x.k AND w.at = x.i JOIN rw ON rw.k = w.k AND rw.i = w.i"""


@query(f"{E.replace('WITH', 'WITH RECURSIVE', 1)}, {low_pass_sql('user_id', 10.0, 1.0)}")
def g16_low_pass(spark, d):
    e = events(spark, d).select("user_id", "event_id", "value")
    return rounded(signals.low_pass(e, ["user_id"], "event_id", "value", 10.0, 1.0).select("event_id", "filtered"), "filtered")


@query()
def h2_band_power(spark, d):
    e = events(spark, d).select("user_id", "event_id", "value")
    return rounded(signals.band_power(e, ["user_id"], "event_id", "value", 10.0, 1.0, 4.0), "power")


def _daily_cells(spark, d):
    return events(spark, d).groupBy("event_type", F.floor(F.col("t") / DAY).cast("double").alias("x"), (F.col("user_id") % 4).alias("trial")).agg(F.avg("value").alias("rate"))


@query()
def m11_selected_models(spark, d):
    out = tuning.selected_models(_daily_cells(spark, d), ["event_type"], "x", "rate")
    return out.select("event_type", "model", F.round("r2", 5).alias("r2"), F.round("mean_r2", 5).alias("mean_r2"), F.round("bic", 3).alias("bic"), "best")


@query(f"""{E}, c AS (SELECT event_type, floor(t / 86400)::DOUBLE AS x, user_id % 4 AS trial, avg(value) AS y FROM e GROUP BY ALL),
s AS (SELECT event_type, count(*) AS n, regr_syy(y, x) AS syy, regr_syy(y, x) - regr_sxy(y, x) ^ 2 / regr_sxx(y, x) AS sse, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM c GROUP BY 1),
m AS (SELECT event_type, x, avg(y) AS y FROM c GROUP BY 1, 2), q AS (SELECT event_type, 1 - sum((y - (a * x + b)) ^ 2) / (var_pop(y) * count(*)) AS mean_r2 FROM m JOIN (SELECT event_type, a, b FROM s) USING (event_type) GROUP BY 1)
SELECT event_type, round(1 - sse / syy, 6) AS r2, round(mean_r2, 6) AS mean_r2, round(-n / 2.0::DOUBLE * (ln(2 * pi() * sse / n) + 1), 4) AS log_likelihood, round(2 * ln(n) + n * (ln(2 * pi() * sse / n) + 1), 4) AS bic FROM s JOIN q USING (event_type)""")
def m12_linear_fit_statistics(spark, d):
    out = tuning.selected_models(_daily_cells(spark, d), ["event_type"], "x", "rate", ("linear",))
    return rounded(rounded(out.select("event_type", "r2", "mean_r2", "log_likelihood", "bic"), "r2", "mean_r2"), "log_likelihood", "bic", digits=4)
