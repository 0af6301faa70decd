"""More queries over the driver's tables: tuning, encoding facts, receptive fields and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspark.operators import glm, intervals, rates, rf, segment, select, signals, stats, tuning
from trialspark.plans.event_queries import DAY, E, HOUR, events, rounded
from trialspark.plans.table_queries import _hazen_sql, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""{E}, f AS (SELECT *, (value > 250)::INT AS g FROM e), x AS (SELECT *, g - lag(g) OVER (PARTITION BY user_id ORDER BY t) AS edge FROM f)
SELECT user_id, round(min(t) - 3, 6) AS t0, round(min(t) - 1, 6) AS t1 FROM x WHERE edge = -1 AND user_id % 2 = 0 GROUP BY 1
UNION ALL SELECT user_id, round(min(t) + 2, 6) AS t0, round(min(t) + 4, 6) AS t1 FROM x WHERE edge = 1 AND user_id % 2 = 1 GROUP BY 1""")
def g5_baseline_windows(spark, d):
    e = events(spark, d).select("user_id", "t", (F.col("value") / 100).alias("gate"), F.when(F.col("user_id") % 2 == 0, "Coupled").otherwise("StageOnly").alias("protocol"))
    return rounded(segment.baseline_windows(e, ["user_id"], "gate", "t", ["Coupled"]), "t0", "t1")


@query(f"""{E}, f AS (SELECT *, value > 100 AS g FROM e), y AS (SELECT *, (g AND NOT coalesce(lag(g) OVER w, false))::INT AS s FROM f WINDOW w AS (PARTITION BY user_id ORDER BY t)),
z AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY t)::BIGINT AS island FROM y)
SELECT user_id, island, count(*) AS n, round(min(t), 6) AS onset, round(max(t), 6) AS "offset", round(max(value - event_id % 7), 6) AS saliency, round(max(t) - min(t), 6) AS duration FROM z WHERE g GROUP BY 1, 2""")
def g12_mismatches(spark, d):
    e = events(spark, d).withColumns({"gain": F.col("value") / 40, "stage": F.col("value"), "treadmill": (F.col("event_id") % 7).cast("double")})
    out = segment.mismatches(e, ["user_id"], "gain", "t", "stage", "treadmill").drop("saliency_t")
    return rounded(out, "onset", "offset", "saliency", "duration")


@query(f"""{E}, b AS (SELECT user_id, min(t) AS t0, max(t) AS t1, count(*) AS n FROM e GROUP BY 1), s AS (SELECT e.user_id, e.event_id, row_number() OVER (PARTITION BY e.user_id ORDER BY event_id) - 1 AS i FROM e)
SELECT s.user_id, event_id, round(t0 + CASE WHEN n > 1 THEN i / (n - 1) ELSE 0 END * 0.999 * (t1 - t0), 4) AS probe_t FROM s JOIN b USING (user_id)""")
def g17_synchronized(spark, d):
    from pyspark.sql import Window

    e = events(spark, d)
    samples = e.select("user_id", "event_id", F.lit(1).alias("session"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("sample_idx"))
    pulses = e.select("user_id", F.col("t").alias("time"))
    out = segment.synchronized(samples, pulses, ["user_id"], 100 * DAY, 0.999)
    return rounded(out.select("user_id", "event_id", "probe_t"), "probe_t", digits=4)


@query(f"""{E}, r AS (SELECT user_id, event_id AS low, event_id + 40 AS high FROM e WHERE event_type = 'error')
SELECT e.event_id, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.user_id = e.user_id AND e.event_id BETWEEN low AND high) THEN -2.0::DOUBLE ELSE value END AS value FROM e""")
def g24_blanked(spark, d):
    e = events(spark, d)
    ranges = e.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("low"), (F.col("event_id") + 40).alias("high"))
    return segment.blank(e, ranges, ["user_id"], "event_id", "value", -2.0, 40).select("event_id", "value")


@query(f"{E} SELECT user_id, max(value) AS reach, CASE WHEN max(value) > 90 THEN 'long' ELSE 'short' END AS length_class FROM e GROUP BY 1")
def g25_trial_lengths(spark, d):
    return segment.trial_lengths(events(spark, d), ["user_id"], "value")


@query(f"""{E}, i AS (SELECT user_id, event_id AS trial, event_id AS s, event_id + 200 AS f FROM e WHERE event_type = 'signup')
SELECT i.user_id, i.trial, e.event_id, e.event_id - s AS "offset" FROM i JOIN e ON i.user_id = e.user_id AND e.event_id BETWEEN s AND f""")
def p1_trial_slices(spark, d):
    e = events(spark, d).select("user_id", "event_id", "event_type")
    trials = e.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("trial"), F.col("event_id").alias("start_idx"), (F.col("event_id") + 200).alias("end_idx"))
    return segment.slices(e, trials, ["user_id"], "event_id", 200).select("user_id", "trial", "event_id", "offset")


@query(f"""{E}, s AS (SELECT user_id, event_id, t AS t0 FROM e WHERE event_type = 'signup'), g AS (SELECT unnest(range(-4, 5)) AS step), p AS (SELECT s.user_id, step, t0 + step * 21600.0::DOUBLE AS at FROM s, g),
r AS (SELECT p.user_id, p.step, p.at, sum(exp(-(e.t - p.at) * (e.t - p.at) / (2 * 7200.0::DOUBLE * 7200.0::DOUBLE))) AS w FROM p LEFT JOIN e ON e.user_id = p.user_id AND e.t BETWEEN p.at - 28800 AND p.at + 28800 GROUP BY ALL)
SELECT user_id, step::INT AS step, round(avg(coalesce(w, 0)), 6) AS rate FROM r GROUP BY 1, 2""")
def f9_mean_response(spark, d):
    import math

    e = events(spark, d)
    points = rates.grid(e.filter("event_type = 'signup'").select("user_id", F.col("t").alias("t0")), DAY, DAY, 1 / 21_600)
    found = rates.smoothed_at(e, points.select("user_id", "at").distinct(), ["user_id"], 7200.0, 28_800.0)
    scale = 7200 * math.sqrt(2 * math.pi) * (1 - math.erfc(4 / math.sqrt(2)))
    out = points.join(found, ["user_id", "at"]).groupBy("user_id", "step").agg(F.avg(F.col("rate") * scale).alias("rate"))
    return rounded(out, "rate")


@query(f"""{E}, m AS (SELECT event_type, floor(value / 10)::INT AS bin, count(*)::DOUBLE AS rate FROM e WHERE value < 100 GROUP BY 1, 2),
p AS (SELECT event_type, max(rate) AS peak, min_by(bin, (-rate, bin)) AS peak_bin FROM m GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY peak_bin, event_type)::INT AS place FROM p)
SELECT m.event_type, bin, peak_bin, place, round(rate / peak, 6) AS scaled FROM m JOIN o USING (event_type)""")
def f16_field_order(spark, d):
    maps = events(spark, d).filter("value < 100").groupBy("event_type", F.floor(F.col("value") / 10).cast("int").alias("bin")).agg(F.count("*").cast("double").alias("rate"))
    return rounded(rates.field_order(maps, ["event_type"]).select("event_type", "bin", "peak_bin", "place", "scaled"), "scaled")


@query(f"""{E}, b AS (SELECT user_id, event_id, t FROM e WHERE value > 150), w AS (SELECT b.user_id, b.event_id, sum((e.t >= b.t - 259200 AND e.t < b.t - 86400)::INT) / 172800.0::DOUBLE AS x, sum((e.t >= b.t AND e.t < b.t + 172800)::INT) / 172800.0::DOUBLE AS y
FROM b JOIN e ON e.user_id = b.user_id GROUP BY 1, 2) SELECT user_id, round(median(x), 12) AS before, round(median(y), 12) AS after, count(*) AS n FROM w GROUP BY 1""")
def f18_before_after(spark, d):
    e = events(spark, d)
    starts = e.filter("value > 150").select("user_id", "event_id", F.col("t").alias("t0"))
    sides = [intervals.window_rates(e, starts.select("user_id", "event_id", (F.col("t0") + a * DAY).alias("w0"), (F.col("t0") + b * DAY).alias("w1")), ["user_id"], ["event_id"], 2 * DAY).select("user_id", "event_id", (F.col("n_spikes") / 172_800.0).alias(n)) for n, a, b in (("x", -3, -1), ("y", 0, 2))]
    out = sides[0].join(sides[1], ["user_id", "event_id"]).groupBy("user_id").agg(F.median("x").alias("before"), F.median("y").alias("after"), F.count("*").alias("n"))
    return rounded(out, "before", "after", digits=12)


@query(f"""{E}, h AS (SELECT event_type, floor(t / 86400)::INT AS day, count(*) AS n FROM e GROUP BY 1, 2), a AS (SELECT event_type, min(day) AS m FROM h GROUP BY 1)
SELECT event_type, min_by(day, (-n, day))::INT AS peak_depth, max(n)::DOUBLE AS peak_power FROM h WHERE day BETWEEN 5 AND 25 GROUP BY 1""")
def h4_peak_depth(spark, d):
    profile = events(spark, d).groupBy("event_type", F.floor(F.col("t") / DAY).cast("int").alias("day")).agg(F.count("*").cast("double").alias("power"))
    return signals.peak_depth(profile, ["event_type"], "day", "power", 5, 25)


@query(f"""{E}, t AS (SELECT unnest(range(0, 4)) AS k, unnest([2.0::DOUBLE, 5, 5, 2]) AS m), h AS (SELECT user_id, floor(t / 86400)::INT AS at, count(*)::DOUBLE AS v FROM e GROUP BY 1, 2),
s AS (SELECT h.user_id, h.at AS start, sum((x.v - m) * (x.v - m)) AS error, count(*) AS n FROM h CROSS JOIN t JOIN h x ON x.user_id = h.user_id AND x.at = h.at + k GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY error, start) AS place FROM s WHERE n = 4) SELECT user_id, start, error, place::INT AS place FROM r WHERE place <= 2""")
def t16_template_matches(spark, d):
    trace = events(spark, d).groupBy("user_id", F.floor(F.col("t") / DAY).cast("int").alias("at")).agg(F.count("*").cast("double").alias("v"))
    template = spark.createDataFrame([(0, 2.0), (1, 5.0), (2, 5.0), (3, 2.0)], "k int, m double")
    return signals.template_matches(trace, template, trace.select("user_id", F.col("at").alias("start")), ["user_id"], 2)


@query(f"""{E}, c AS (SELECT user_id, event_type AS category, avg(value) AS rate, count(*) AS n FROM e GROUP BY 1, 2)
SELECT user_id, min_by(category, (-round(rate, 8), category)) AS preferred, CASE WHEN min(n / 100.0::DOUBLE) < 0.05 THEN 'tuned' WHEN min(n / 200.0::DOUBLE) < 0.05 THEN 'responsive' ELSE 'unresponsive' END AS class FROM c GROUP BY 1""")
def t12_response_classes(spark, d):
    facts = events(spark, d).groupBy("user_id", F.col("event_type").alias("category")).agg(F.round(F.avg("value"), 8).alias("rate"), F.count("*").alias("n"))
    facts = facts.withColumns({"k": F.col("n") / 100.0, "r": F.col("n") / 200.0})
    return stats.response_classes(facts, ["user_id"], "category", "k", "r", "rate")


@query("""WITH l AS (SELECT l_suppkey, l_linestatus, l_quantity::INT AS q, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS i FROM lineitem)
SELECT l_suppkey, q, round(avg(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END), 8) AS o, round(avg(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END), 8) AS p FROM l GROUP BY 1, 2""")
def j9_paired_means(spark, d):
    lines = table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").cast("int").alias("q"), "l_linestatus", "l_extendedprice")
    side = lambda v, n: lines.filter(F.col("l_linestatus") == v).groupBy("l_suppkey", "q").agg(F.round(F.avg("l_extendedprice"), 8).alias(n))
    return side("F", "o").join(side("O", "p"), ["l_suppkey", "q"], "full")


@query("""WITH m AS (SELECT l_suppkey, (l_quantity / 5)::INT AS bin, avg(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END) AS o, avg(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END) AS p FROM (SELECT l_suppkey, floor(l_quantity / 5) * 5 AS l_quantity, l_linestatus, l_extendedprice FROM lineitem) GROUP BY 1, 2)
SELECT l_suppkey, round(corr(o, p), 7) AS r, round(regr_r2(o, p), 7) AS r2, count(*) AS n_bins FROM m GROUP BY 1""")
def l12_observed_predicted(spark, d):
    lines = table(spark, d, "lineitem").select("l_suppkey", F.floor(F.col("l_quantity") / 5).alias("bin"), *(F.when(F.col("l_linestatus") == v, F.col("l_extendedprice")).alias(n) for n, v in (("observed", "F"), ("predicted", "O"))))
    return rounded(glm.observed_predicted(lines, ["l_suppkey"], "bin"), "r", "r2", digits=7)


@query("""WITH c AS (SELECT p_type AS name, p_retailprice AS value FROM part), x AS (SELECT regexp_extract(lower(name), '^([a-z_]+)', 1) AS label, value FROM c)
SELECT label, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(*)), 6) AS sem, count(*) AS n FROM x GROUP BY 1""")
def l15_grouped_parameters(spark, d):
    parts = table(spark, d, "part").select(F.lower("p_type").alias("name"), F.col("p_retailprice").alias("value"))
    return rounded(glm.grouped_parameters(parts), "mean", "sem")


@query(f"""{E}, o AS (SELECT user_id, min(t) AS onset FROM e GROUP BY 1), s AS (SELECT e.*, floor((t - onset) / 43200)::INT AS bin FROM e JOIN o USING (user_id)),
b AS (SELECT user_id, bin, avg(value) AS speed, avg((value > 15)::INT) AS share FROM s GROUP BY 1, 2 HAVING avg((value > 15)::INT) >= 0.5), n AS (SELECT user_id, event_type, bin, count(*) AS k FROM s GROUP BY 1, 2, 3)
SELECT b.user_id, u.event_type, b.bin, round(speed, 7) AS speed, coalesce(n.k, 0) AS spike_count, round((b.bin + 0.5::DOUBLE) * 43200, 3) AS time_since_onset
FROM b JOIN (SELECT DISTINCT user_id, event_type FROM e) u USING (user_id) LEFT JOIN n ON n.user_id = b.user_id AND n.bin = b.bin AND n.event_type = u.event_type""")
def l2_time_bins(spark, d):
    e = events(spark, d).withColumn("trial", F.lit(1))
    onsets = e.groupBy("user_id", "trial").agg(F.min("t").alias("onset"))
    samples = e.select("user_id", "trial", "t", F.col("value").alias("speed"), (F.col("value") > 15).alias("moving"))
    out = glm.time_bins(samples, onsets, e.select("user_id", "trial", "event_type", "t"), ["user_id"], "trial", "event_type", 12 * HOUR)
    return rounded(rounded(out.drop("trial"), "speed", digits=7), "time_since_onset", digits=3)


@query(f"""{E}, s AS (SELECT event_id, user_id % 6 AS cell FROM e WHERE event_type = 'signup'), o AS (SELECT 1 AS k, event_id AS stim, t AS onset, coalesce(lead(t) OVER (ORDER BY t), t + 0.25) AS f FROM e WHERE event_type = 'signup'),
n AS (SELECT o.stim, u.unit, count(e.t) AS n FROM o CROSS JOIN (SELECT unnest(range(0, 3)) AS unit) u LEFT JOIN e ON e.event_type <> 'signup' AND e.user_id % 3 = u.unit AND e.t >= o.onset AND e.t < o.f GROUP BY 1, 2)
SELECT unit, cell, round(avg(n), 8) AS sta, count(*) AS n_frames FROM n JOIN s ON s.event_id = n.stim GROUP BY 1, 2""")
def v3_sparse_average(spark, d):
    e = events(spark, d).withColumn("k", F.lit(1))
    shown = e.filter("event_type = 'signup'")
    spikes = e.filter("event_type <> 'signup'").select("k", "t", (F.col("user_id") % 3).alias("unit"))
    counts = rf.stimulus_counts(spikes, shown.select("k", F.col("event_id").alias("stim"), F.col("t").alias("onset")), ["k"], "unit")
    cells = shown.select(F.col("event_id").alias("stim"), (F.col("user_id") % 6).alias("cell"), F.lit(1).alias("polarity"))
    return rounded(rf.sparse_average(counts, cells, ["unit"]).drop("polarity"), "sta", digits=8)


@query(f"""{E}, s AS (SELECT user_id % 10 AS g, value - 20 AS v FROM e WHERE value <> 20), m AS (SELECT g, 'all' AS mode, v FROM s UNION ALL SELECT g, 'acc', v FROM s WHERE v > 0 UNION ALL SELECT g, 'dec', v FROM s WHERE v < 0)
SELECT g, mode, count(*) AS n, round(avg(v), 8) AS mean FROM m GROUP BY 1, 2""")
def m2_signed_modes(spark, d):
    e = events(spark, d).filter("value <> 20").select((F.col("user_id") % 10).alias("g"), (F.col("value") - 20).alias("v"))
    modes = F.array_compact(F.array(F.lit("all"), F.when(F.col("v") > 0, "acc"), F.when(F.col("v") < 0, "dec")))
    return rounded(e.withColumn("mode", F.explode(modes)).groupBy("g", "mode").agg(F.count("*").alias("n"), F.avg("v").alias("mean")), "mean", digits=8)


@query(f"""{E}, s AS (SELECT user_id % 10 AS g, value - 20 AS v FROM e), m AS (SELECT g, 'all' AS mode, v FROM s UNION ALL SELECT g, 'acc', v FROM s WHERE v > 0 UNION ALL SELECT g, 'dec', v FROM s WHERE v < 0),
{_hazen_sql('m', 'g, mode', 'v', 'list_transform(range(0, 6), lambda k: 100.0::DOUBLE * k / 5)')}, b AS (SELECT g, mode, row_number() OVER w AS bin, value AS lo, lead(value) OVER w AS hi FROM q WINDOW w AS (PARTITION BY g, mode ORDER BY prc))
SELECT g, mode, bin::INT AS bin, round(lo, 6) AS lo, round(hi, 6) AS hi, round((lo + hi) / 2, 6) AS center FROM b WHERE bin <= 5""")
def m2_signed_bins(spark, d):
    e = events(spark, d).select((F.col("user_id") % 10).alias("g"), (F.col("value") - 20).alias("v"))
    return rounded(tuning.signed_bins(e, ["g"], "v", 5), "lo", "hi", "center")


@query()
def m13_model_p(spark, d):
    cells = events(spark, d).groupBy("event_type", F.floor(F.col("t") / (3 * DAY)).cast("int").alias("bin"), (F.col("user_id") % 4).alias("trial")).agg(F.avg("value").alias("rate"))
    cells = cells.withColumn("x", F.col("bin").cast("double"))
    best = tuning.selected_models(cells, ["event_type"], "x", "rate")
    return rounded(tuning.model_p(cells, best, ["event_type"], "bin", "x", "rate"), "p")


@query()
def t7_lilliefors(spark, d):
    return rounded(stats.lilliefors(events(spark, d), ["event_type"], "value"), "d", "critical")


_FRAMES = "n AS (SELECT count(*) AS k FROM embeddings), c AS (SELECT user_id % 3 AS unit, event_id % k AS frame, count(*) AS n FROM e, n GROUP BY 1, 2)"
_DRAWN = """i AS (SELECT unit, frame, n, row_number() OVER (PARTITION BY unit ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY unit) AS m, sum(n) OVER (PARTITION BY unit ORDER BY frame) - n AS first FROM c),
s AS (SELECT unit, m, unnest(range(first::BIGINT, (first + n)::BIGINT)) AS s FROM i), r AS (SELECT *, unnest(range(0, 100)) AS rep FROM s),
b AS (SELECT unit, rep, floor(('0x' || substr(md5('1:' || rep || ':' || s), 1, 8))::BIGINT / 4294967296.0::DOUBLE * m)::BIGINT AS i FROM r),
h AS (SELECT unit, rep, i, count(*) AS n FROM b GROUP BY ALL), p AS (SELECT h.unit, rep, h.n, unnest(range(0, len(embedding))) AS pixel, unnest(embedding)::DOUBLE AS v FROM h JOIN i USING (unit, i) JOIN embeddings ON vec_id = frame),
t AS (SELECT unit, rep, pixel, sum(n * v) / sum(n) AS sta FROM p GROUP BY ALL)"""


@query(f"{E}, {_FRAMES}, {_DRAWN} SELECT unit, pixel::INT AS pixel, round(avg(sta), 6) AS null_mean, round(stddev_samp(sta), 6) AS null_std FROM t GROUP BY 1, 2")
def v9_resampled_null(spark, d):
    frames = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("frame"), F.col("embedding").alias("pixels"))
    n = frames.agg(F.count("*")).scalar()
    counts = events(spark, d).select((F.col("user_id") % 3).alias("unit"), (F.col("event_id") % n).alias("frame")).groupBy("unit", "frame").agg(F.count("*").alias("n"))
    return rounded(rf.resampled_null(counts, frames, ["unit"]), "null_mean", "null_std")


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'VT' WHEN c_mktsegment = 'MACHINERY' AND c_acctbal > 0 THEN 'V' WHEN c_mktsegment = 'MACHINERY' THEN 'T' END AS label FROM customer""")
def p5_trial_labels(spark, d):
    rules = {"BUILDING": [("VT", [])], "MACHINERY": [("V", [("rich", True)]), ("T", [("rich", False)])]}
    customers = table(spark, d, "customer").withColumn("rich", F.col("c_acctbal") > 0)
    return customers.select("c_custkey", select.label_column(rules, "c_mktsegment").alias("label"))


@query("""WITH x AS (SELECT p_partkey, CASE WHEN regexp_matches(p_type, '^S') THEN 'a' WHEN regexp_matches(p_type, '^(M|L)') THEN 'b' END AS batch, CASE WHEN regexp_matches(p_type, '^S') THEN 1.5::DOUBLE WHEN regexp_matches(p_type, '^(M|L)') THEN 2.0::DOUBLE END AS gain, p_size FROM part)
SELECT p_partkey, batch, p_size * gain AS tf FROM x WHERE batch IS NOT NULL""")
def p15_stimulus_batches(spark, d):
    batch, gain = select.stimulus_batch(F.col("p_type"), [("^S", "a", 1.5), ("^(M|L)", "b", 2.0)])
    return table(spark, d, "part").select("p_partkey", batch.alias("batch"), (F.col("p_size") * gain).alias("tf")).filter("batch IS NOT NULL")
