"""Queries that call operators whose other tests are on small fixtures: the smoothed central table and tuning curves, lags of
frame averages, quality and classes of units, corrected tests by category, power of bands."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trialspark.operators import anatomy, compare, glm, rates, rf, segment, select, signals, stats, tuning
from trialspark.plans.event_queries import DAY, HOUR, E, events, rounded
from trialspark.plans.table_queries import table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


#: The kernel of an hour, a day to either side, cumulated in 1000 steps.
_KERNEL = f"k AS (SELECT {rates._table(HOUR, DAY, 1000)} AS a)"
_AT = lambda x: f"(a[least(floor({x}), 999)::INT + 1] + (a[least(floor({x}), 999)::INT + 2] - a[least(floor({x}), 999)::INT + 1]) * ({x} - least(floor({x}), 999)))"
_SIDE = lambda n, flag: f"""x{n} AS (SELECT *, {flag} AS f FROM e), y{n} AS (SELECT *, (f AND NOT coalesce(lag(f) OVER (PARTITION BY user_id ORDER BY t), false))::INT AS s FROM x{n}),
z{n} AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY t) AS i FROM y{n}), i{n} AS (SELECT user_id, min(t) - 7200 AS w0, max(t) + 7200 AS w1 FROM z{n} WHERE f GROUP BY user_id, i),
b{n} AS (SELECT *, (w0 > coalesce(max(w1) OVER (PARTITION BY user_id ORDER BY w0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w0 - 1))::INT AS new FROM i{n}),
o{n} AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY w0) AS g FROM b{n}), v{n} AS (SELECT user_id, min(w0) AS w0, max(w1) AS w1 FROM o{n} GROUP BY user_id, g),
c{n} AS (SELECT e.user_id, event_type, greatest(0, least(1000, (w1 - t + 86400) * (1000 / 172800.0::DOUBLE))) AS hi, greatest(0, least(1000, (w0 - t + 86400) * (1000 / 172800.0::DOUBLE))) AS lo
FROM v{n} v JOIN e ON e.user_id = v.user_id AND e.t >= w0 - 86400 AND e.t <= w1 + 86400), s{n} AS (SELECT user_id, event_type, sum({_AT("hi")} - {_AT("lo")}) AS mass FROM c{n}, k GROUP BY 1, 2),
r{n} AS (SELECT d.user_id, d.event_type, dt, coalesce(mass, 0) / dt AS rate FROM (SELECT user_id, sum(w1 - w0) AS dt FROM v{n} GROUP BY 1) JOIN (SELECT DISTINCT user_id, event_type FROM e) d USING (user_id) LEFT JOIN s{n} s ON s.user_id = d.user_id AND s.event_type = d.event_type)"""  # noqa: E731


@query(f"""{E}, {_KERNEL}, {_SIDE(1, "value < 10")}, {_SIDE(2, "value > 100")}
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, round(a.dt, 3) AS stationary_time, round(b.dt, 3) AS motion_time, round(a.rate, 10) AS stationary_fr, round(b.rate, 10) AS motion_fr
FROM r1 a FULL JOIN r2 b ON a.user_id = b.user_id AND a.event_type = b.event_type""")
def f14_smoothed_table(spark, d):
    e = events(spark, d)

    def windows(flag):
        runs = segment.islands(e, ["user_id"], "t", flag)
        return segment.merged(runs.select("user_id", (F.col("start") - 2 * HOUR).alias("w0"), (F.col("end") + 2 * HOUR).alias("w1")), ["user_id"])

    out = rates.stationary_motion(e.select("user_id", "event_type", "t"), windows(F.col("value") < 10), windows(F.col("value") > 100), ["user_id"], "event_type", [], DAY, HOUR, DAY)
    return rounded(rounded(out, "stationary_time", "motion_time", digits=3), "stationary_fr", "motion_fr", digits=10)


@query(f"""{E}, x AS (SELECT user_id % 6 AS unit, event_id % (SELECT count(*) FROM embeddings) AS f, (SELECT count(*) FROM embeddings) AS m FROM e),
c AS (SELECT unit, lag, (f + m - lag) % m AS frame, count(*) AS n FROM x, (SELECT unnest([0, 3, 7, 12]) AS lag) GROUP BY ALL), p AS (SELECT unit, lag, n, unnest(range(0, len(embedding))) AS pixel, unnest(embedding)::DOUBLE AS v FROM c JOIN embeddings ON vec_id = frame),
s AS (SELECT unit, lag, pixel, sum(n * v) / sum(n) AS sta FROM p GROUP BY ALL), r AS (SELECT unit, lag, max(abs(sta)) / stddev_samp(sta) AS snr FROM s GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY snr DESC, lag) AS place FROM r)
SELECT unit, lag::INT AS lag, round(snr, 6) AS snr FROM k WHERE place = 1""")
def v8_best_lags(spark, d):
    frames = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("frame"), F.col("embedding").alias("pixels"))
    n = frames.agg(F.count("*")).scalar()
    seen = events(spark, d).select((F.col("user_id") % 6).alias("unit"), (F.col("event_id") % n).alias("_f"), F.explode(F.array(*map(F.lit, (0, 3, 7, 12)))).alias("lag"))
    counts = seen.groupBy("unit", "lag", ((F.col("_f") + n - F.col("lag")) % n).alias("frame")).agg(F.count("*").alias("n"))
    return rounded(rf.best_lags(rf.frame_average(counts, frames, ["unit", "lag"]), ["unit"]), "snr")


_METRICS = "m AS (SELECT p_partkey, (p_size % 30) / 100.0::DOUBLE AS isi_viol, (p_partkey % 50)::DOUBLE AS isolation_distance, (p_partkey % 20) / 100.0::DOUBLE AS amplitude_cutoff, p_size % 7 / 10.0::DOUBLE AS max_drift, CASE WHEN p_type LIKE '%STEEL' THEN 'mua' ELSE 'good' END AS \"group\", p_retailprice / 2100 AS duration, p_brand AS region FROM part)"


def _clusters(spark, d):
    share = lambda c, n, by: ((c % n) / F.lit(by)).cast("double")
    return table(spark, d, "part").select(
        "p_partkey", share(F.col("p_size"), 30, 100.0).alias("isi_viol"), (F.col("p_partkey") % 50).cast("double").alias("isolation_distance"), share(F.col("p_partkey"), 20, 100.0).alias("amplitude_cutoff"), share(F.col("p_size"), 7, 10.0).alias("max_drift"),
        F.when(F.col("p_type").endswith("STEEL"), "mua").otherwise("good").alias("group"), (F.col("p_retailprice") / 2100).alias("duration"),
    )


@query(f"""WITH {_METRICS} SELECT p_partkey, CASE WHEN duration < {select.NARROW_MS} THEN 'narrow' WHEN duration IS NOT NULL THEN 'wide' END AS class FROM m WHERE "group" = 'good' AND {" AND ".join(f"{c} {s} {v}" for c, (s, v) in select.QUALITY.items())}""")
def p6_good_units(spark, d):
    m = _clusters(spark, d)
    kept = select.good_units(m, m.select("p_partkey", *select.QUALITY), m.select("p_partkey", "group"), ["p_partkey"])
    return kept.select("p_partkey", select.spiking_class(F.col("duration")).alias("class"))


@query(f"""{E}, u AS (SELECT user_id, event_type, (event_type = 'view')::INT * 0.01::DOUBLE + abs(avg(value) - 50) / 100 AS p FROM e WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1, 2),
w AS (SELECT user_id, coalesce(max(CASE WHEN event_type = 'view' THEN p END) < 0.05, false) AS t, coalesce(max(CASE WHEN event_type = 'click' THEN p END) < 0.05, false) AS v, coalesce(max(CASE WHEN event_type = 'purchase' THEN p END) < 0.05, false) AS vt FROM u GROUP BY 1)
SELECT user_id, CASE WHEN t AND v THEN 'T_and_V' WHEN t THEN 'T_only' WHEN v THEN 'V_only' WHEN vt THEN 'VT_only' ELSE 'none' END AS category, t OR v OR vt AS fit FROM w""")
def l1_category(spark, d):
    names = F.create_map(*(F.lit(x) for pair in (("view", "T"), ("click", "V"), ("purchase", "VT")) for x in pair))
    rows = events(spark, d).filter(F.col("event_type").isin("view", "click", "purchase"))
    p = (F.col("event_type") == "view").cast("int") * 0.01 + F.abs(F.col("m") - 50) / 100
    mean = rows.groupBy("user_id", "event_type").agg(F.avg("value").alias("m"))
    # A mean on the threshold falls to either side by the order in which its values are added, so those are added in order.
    close = rows.join(mean.filter(F.abs(p - 0.05) < 1e-9).drop("m"), ["user_id", "event_type"], "left_semi")
    told = stats.mean_in_order(close, ["user_id", "event_type"], "event_id", "value", "_m")
    mean = mean.join(told, ["user_id", "event_type"], "left").withColumn("m", F.coalesce("_m", "m"))
    return glm.category(mean.select("user_id", names[F.col("event_type")].alias("condition"), p.alias("p")), ["user_id"])


@query(f"""{E}, c AS (SELECT user_id % 7 AS unit, floor(t / 86400)::INT AS day, event_type, avg(value) AS v FROM e GROUP BY ALL), r AS (SELECT unit, day, avg(v) AS rest FROM c WHERE event_type = 'error' GROUP BY 1, 2),
p AS (SELECT unit, event_type, round(rest - v, 9) AS d FROM c JOIN r USING (unit, day) WHERE event_type <> 'error'), u AS (SELECT *, abs(d) AS a FROM p WHERE d <> 0),
k AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY unit, event_type, a) - 1) / 2.0::DOUBLE AS rank FROM u WINDOW w AS (PARTITION BY unit, event_type ORDER BY a)),
s AS (SELECT unit, event_type, count(*) AS n_used, sum(CASE WHEN d > 0 THEN rank ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN rank ELSE 0 END) AS w_minus FROM k GROUP BY 1, 2), n AS (SELECT unit, event_type, count(*) AS n FROM p GROUP BY 1, 2)
SELECT unit, event_type, n, coalesce(n_used, 0) AS n_used, coalesce(w_plus, 0) AS w_plus, coalesce(w_minus, 0) AS w_minus FROM n LEFT JOIN s USING (unit, event_type)""")
def t11_ranks_by_category(spark, d):
    cells = events(spark, d).groupBy((F.col("user_id") % 7).alias("unit"), F.floor(F.col("t") / DAY).cast("int").alias("day"), "event_type").agg(F.avg("value").alias("v"))
    rest = cells.filter("event_type = 'error'").groupBy("unit", "day").agg(F.avg("v").alias("rest"))
    out = stats.category_tests(cells.filter("event_type <> 'error'").join(rest, ["unit", "day"]), ["unit"], "event_type", "v", "rest", p_values=False)
    return out.select("unit", "event_type", "n", "n_used", "w_plus", "w_minus")


_PERIODOGRAM = lambda rate, low, high: f"""WITH n AS (SELECT k, count(*) AS n, sum((0.54 - 0.46 * cos(2 * pi() * i / greatest(m - 1, 1))) ^ 2) AS w2 FROM x GROUP BY k),
f AS (SELECT n.*, unnest(range(0, n // 2 + 1)) AS j FROM n), g AS (SELECT * FROM f WHERE j * {rate} / n BETWEEN {low} AND {high}),
q AS (SELECT g.k, g.j, any_value(g.n) AS n, any_value(w2) AS w2, sum(v * w * cos(2 * pi() * ((i * j) % g.n) / g.n)) AS re, sum(v * w * sin(2 * pi() * ((i * j) % g.n) / g.n)) AS im FROM g JOIN (SELECT *, CASE WHEN m = 1 THEN 1 ELSE 0.54 - 0.46 * cos(2 * pi() * i / (m - 1)) END AS w FROM x) x ON x.k = g.k GROUP BY 1, 2)
SELECT k, round(sum((re * re + im * im) / ({rate} * w2) * CASE WHEN j > 0 AND 2 * j <> n THEN 2 ELSE 1 END * {rate} / n), 6) AS power FROM q GROUP BY 1"""  # noqa: E731


@query(f"""{E}, o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r FROM e), z AS (SELECT user_id, count(*) AS n FROM o GROUP BY 1),
b AS (SELECT user_id, unnest(range(0, CASE WHEN n >= 15 THEN (n - 15) // 20 + 1 ELSE 0 END)) AS batch FROM z),
x AS (SELECT o.user_id * 100000 + batch AS k, value AS v, r - 5 - 20 * batch AS i, 10 AS m FROM o JOIN b ON b.user_id = o.user_id AND r >= 5 + 20 * batch AND r < 15 + 20 * batch), p AS ({_PERIODOGRAM("10.0::DOUBLE", 1, 4)})
SELECT k // 100000 AS user_id, (k % 100000)::INT AS batch, power FROM p""")
def h2_batch_power(spark, d):
    """Batches of a second, from half a second on, every two seconds, of samples at 10 Hz."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    samples = events(spark, d).select("user_id", "value", nth.alias("r"))
    length = samples.groupBy("user_id").agg((F.max("r") + 1).alias("n"))
    starts = signals.batch_starts(F.col("n") / 10.0, 0.5, 2.0, 1.0)
    batches = length.select("user_id", F.posexplode(starts).alias("batch", "t0")).select("user_id", "batch", F.round(F.col("t0") * 10).cast("int").alias("w0"), F.round(F.col("t0") * 10 + 9).cast("int").alias("w1"))
    cut = segment.slices(samples, batches.withColumnsRenamed({"w0": "start_idx", "w1": "end_idx"}), ["user_id"], "r", 20)
    return rounded(signals.band_power(cut, ["user_id", "batch"], "r", "value", 10.0, 1.0, 4.0), "power")


@query(f"""{E}, t AS (SELECT user_id, event_id, floor(t / 432000)::INT AS trial FROM e), m AS (SELECT user_id, (min(trial) + max(trial)) / 2.0::DOUBLE AS middle FROM t GROUP BY 1)
SELECT t.user_id, event_id, trial, (trial > middle)::INT AS fold FROM t JOIN m USING (user_id)""")
def l11_profile_folds(spark, d):
    rows = events(spark, d).select("user_id", "event_id", F.floor(F.col("t") / 432_000).cast("int").alias("trial"))
    return glm.profile_generalisation(rows, ["user_id"], "trial")


_FITS = "f AS (SELECT user_id % 40 AS unit, event_type, regr_slope(value, t) * 86400 AS slope, regr_r2(value, t) AS r2, avg(value) AS rate, count(*) AS n FROM e GROUP BY 1, 2)"


@query(f"""{E}, {_FITS} SELECT unit, event_type, CASE WHEN r2 < 0.02 AND r2 / 0.4::DOUBLE < 0.05 THEN CASE WHEN rate > 30 THEN 'excited' ELSE 'suppressed' END || '_' || CASE WHEN slope > 0 THEN 'up' ELSE 'down' END ELSE 'untuned' END AS class FROM f""")
def m15_tuned_classes(spark, d):
    """A fit's r2 stands for its p."""
    fits = stats.linear_fit(events(spark, d).withColumn("unit", F.col("user_id") % 40).withColumn("day", F.col("t")), ["unit", "event_type"], "value", "day")
    mean = events(spark, d).groupBy((F.col("user_id") % 40).alias("unit"), "event_type").agg(F.avg("value").alias("rate"))
    return tuning.tuned_classes(fits.join(mean, ["unit", "event_type"]).withColumns({"p": F.col("r2") / 0.4, "rest": F.lit(30.0)}), "rate", "rest").select("unit", "event_type", "class")


_LAYERS = "SELECT r_regionkey, CASE WHEN r_regionkey < 4 THEN 'VISp' || (r_regionkey + 1) ELSE 'root' END AS region, p AS probe, s AS shank_id, 900.0::DOUBLE + 150 * r_regionkey + 20 * s + 7 * p AS lower, 1050.0::DOUBLE + 150 * r_regionkey + 20 * s + 7 * p AS upper FROM region, (SELECT DISTINCT p_size % 3 AS p, p_partkey % 2 AS s FROM part)"


@query(f"""WITH l AS ({_LAYERS}) SELECT p_partkey, CASE WHEN region LIKE 'VISp%' THEN region ELSE '' END AS layer, CASE WHEN region LIKE 'VISp%' THEN round((upper - p_retailprice) / (upper - lower), 8) ELSE -1 END AS relative
FROM part LEFT JOIN l ON probe = p_size % 3 AND shank_id = p_partkey % 2 AND lower <= p_retailprice AND p_retailprice < upper""")
def j12_layers_by_shank(spark, d):
    clusters = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 3).cast("int").alias("probe"), (F.col("p_partkey") % 2).cast("int").alias("shank_id"), F.col("p_retailprice").cast("double").alias("from_tip"))
    shanks = clusters.select("probe", "shank_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    names = table(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("k"))
    lower = F.lit(900.0) + 150 * F.col("k") + 20 * F.col("shank_id") + 7 * F.col("probe")
    layers = shanks.join(names, "k").select("probe", "shank_id", F.when(F.col("k") < 4, F.concat(F.lit("VISp"), F.col("k") + 1)).otherwise("root").alias("region"), lower.alias("lower"), (lower + 150).alias("upper"))
    return rounded(anatomy.layer_positions(clusters, layers, ["probe"]).select("p_partkey", "layer", "relative"), "relative", digits=8)


@query(f"""{E}, g AS (SELECT user_id, min(t) AS a, max(t) AS b, round((max(t) - min(t)) / 21600)::INT AS n FROM e GROUP BY 1), s AS (SELECT *, unnest(range(0, n)) AS step FROM g WHERE n > 1),
q AS (SELECT user_id, step, CASE WHEN step = n - 1 THEN b ELSE a + step * ((b - a) / (n - 1)) END AS x FROM s), v AS (SELECT user_id, t, value, event_id, lead(t) OVER w AS nt, lead(value) OVER w AS nv, lead(event_id) OVER w AS ne FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
j AS (SELECT q.*, v.* EXCLUDE (user_id) FROM q ASOF JOIN v ON q.user_id = v.user_id AND q.x >= v.t)
SELECT user_id, 'value' AS channel, step::INT AS step, round(value + CASE WHEN x > t THEN (nv - value) / (nt - t) * (x - t) ELSE 0 END, 5) AS value FROM j
UNION ALL SELECT user_id, 'event_id', step::INT, round(event_id + CASE WHEN x > t THEN (ne - event_id)::DOUBLE / (nt - t) * (x - t) ELSE 0 END, 5) FROM j""")
def f22_coarse_traces(spark, d):
    out = rates.coarse_traces(events(spark, d), ["user_id"], "t", ["value", "event_id"], 1 / 21_600)
    return rounded(out.select("user_id", "channel", "step", "value"), "value", digits=5)


@query(f"""{E}, s AS (SELECT user_id, event_id AS stim, t AS w0, least(t + 86400, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t), t + 86400)) AS w1 FROM e WHERE event_type = 'signup')
SELECT e.event_id, stim FROM e LEFT JOIN s ON e.user_id = s.user_id AND t >= w0 AND t < w1""")
def f20_stimuli(spark, d):
    e = events(spark, d)
    ahead = F.lead("t").over(Window.partitionBy("user_id").orderBy("t"))
    shown = e.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("stim"), F.col("t").alias("w0"), F.least(F.col("t") + DAY, F.coalesce(ahead, F.col("t") + DAY)).alias("w1"))
    return compare.with_stimulus(e.select("user_id", "event_id", "t"), shown, ["user_id"], "t", DAY).select("event_id", "stim")


@query(f"""{E}, u AS (SELECT user_id, user_id % 3 AS g, avg(CASE WHEN event_type = 'click' THEN value END) - avg(CASE WHEN event_type = 'view' THEN value END) AS s, avg(CASE WHEN event_type = 'purchase' THEN value END) - avg(CASE WHEN event_type = 'error' THEN value END) AS p FROM e GROUP BY 1),
r AS (SELECT *, abs(round(p, 9)) AS a FROM u WHERE round(p, 9) <> 0), k AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY g, a) - 1) / 2.0::DOUBLE AS rank FROM r WINDOW w AS (PARTITION BY g ORDER BY a)),
s AS (SELECT g, sum(CASE WHEN p > 0 THEN rank ELSE 0 END) AS w_plus, sum(CASE WHEN p < 0 THEN rank ELSE 0 END) AS w_minus FROM k GROUP BY 1)
SELECT g, round(median(s), 8) AS standard, round(median(p), 8) AS profile, round(median(CASE WHEN s > 0 THEN p / s END), 8) AS retained, count(p) AS n, any_value(w_plus) AS w_plus, any_value(w_minus) AS w_minus FROM u JOIN s USING (g) GROUP BY 1""")
def l11_generalised(spark, d):
    mean = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    units = events(spark, d).groupBy("user_id", (F.col("user_id") % 3).alias("g")).agg((mean("click") - mean("view")).alias("s"), (mean("purchase") - mean("error")).alias("p"))
    return rounded(glm.generalised(units, ["g"], "s", "p", p_values=False), "standard", "profile", "retained", digits=8)
