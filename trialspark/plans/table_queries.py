"""Queries over the star-schema tables: paired values, tuning, normalisation, look-ups, selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialspark.operators import anatomy, intervals, select, stats, tuning

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _hazen_sql(source: str, keys: str, value: str, percents: str) -> str:
    return f"""r AS (SELECT {keys}, {value}::DOUBLE AS v, row_number() OVER (PARTITION BY {keys} ORDER BY {value}) AS i, count(*) OVER (PARTITION BY {keys}) AS n,
lead({value}) OVER (PARTITION BY {keys} ORDER BY {value}) AS nv FROM {source}),
p AS (SELECT *, greatest(1.0::DOUBLE, least(n::DOUBLE, prc / 100 * n + 0.5::DOUBLE)) AS pos FROM r CROSS JOIN (SELECT unnest({percents}) AS prc)),
q AS (SELECT {keys}, prc::DOUBLE AS prc, v + coalesce(nv - v, 0) * (pos - i) AS value FROM p WHERE i = floor(pos))"""


@query(f"WITH {_hazen_sql('lineitem', 'l_returnflag', 'l_extendedprice', '[5.0::DOUBLE, 25, 50, 75, 95]')} SELECT l_returnflag, prc, round(value, 8) AS value FROM q")
def a14_hazen_percentiles(spark, d):
    return rounded(stats.hazen(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [5, 25, 50, 75, 95]), "value", digits=8)


_BINS = f"""WITH {_hazen_sql('lineitem', 'l_returnflag', 'l_extendedprice', 'list_transform(range(0, 21), lambda k: 100.0::DOUBLE * k / 20)')},
b AS (SELECT l_returnflag, row_number() OVER w AS bin, value AS lo, lead(value) OVER w AS hi FROM q WINDOW w AS (PARTITION BY l_returnflag ORDER BY prc))"""


@query(f"{_BINS} SELECT l_returnflag, bin::INT AS bin, round(lo, 8) AS lo, round(hi, 8) AS hi, round((lo + hi) / 2, 8) AS center FROM b WHERE bin <= 20")
def m1_equal_population_bins(spark, d):
    out = tuning.equal_population_bins(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return rounded(out, "lo", "hi", "center", digits=8)


@query(f"""{_BINS} SELECT l.l_returnflag, l_linestatus, bin::INT AS bin, round(avg(l_quantity), 8) AS rate, count(*) AS n FROM lineitem l JOIN b ON b.l_returnflag = l.l_returnflag AND lo <= l_extendedprice AND l_extendedprice < hi AND bin <= 20 GROUP BY ALL""")
def m4_tuning_by_bin(spark, d):
    lines = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice", "l_quantity")
    bins = tuning.equal_population_bins(lines, ["l_returnflag"], "l_extendedprice")
    return rounded(tuning.mean_by_bin(lines, bins, ["l_returnflag"], ["l_linestatus"], "l_extendedprice", "l_quantity"), "rate", digits=8)


@query("SELECT l_suppkey, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(corr(l_quantity, l_extendedprice), 8) AS r, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem GROUP BY 1")
def m8_linear_fit(spark, d):
    out = stats.linear_fit(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity")
    return rounded(rounded(rounded(out, "r", "r2", digits=8), "slope", digits=5), "intercept", digits=4)


_CELLS = "c AS (SELECT l_suppkey, floor(l_quantity / 5)::INT AS x, round(avg(l_extendedprice / l_quantity), 6) AS y FROM lineitem GROUP BY 1, 2)"


@query(f"""WITH {_CELLS}, k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY x, y) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM c),
s AS (SELECT l_suppkey, x, n, i, unnest(range(0, 1000)) AS rep FROM k), a AS (SELECT *, (rep * 48271 + i * 69621 + 29152) % 2147483647 AS a FROM s),
b AS (SELECT *, floor(((a * 39373 + a % 65536 * 7 + 1) % 2147483647 * 16807 % 2147483647) * n / 2147483647.0::DOUBLE)::BIGINT AS j FROM a),
f AS (SELECT b.l_suppkey, b.rep, regr_r2(k.y, b.x) AS r FROM b JOIN k ON k.l_suppkey = b.l_suppkey AND k.i = b.j GROUP BY 1, 2), r AS (SELECT l_suppkey, regr_r2(y, x) AS r2, count(*) AS n FROM c GROUP BY 1)
SELECT r.l_suppkey, round(any_value(r2), 8) AS r2, any_value(n) AS n, round(sum((r > r2)::INT) / 1000, 6) AS p FROM f JOIN r USING (l_suppkey) GROUP BY 1""")
def m9_shuffled_fits(spark, d):
    cells = table(spark, d, "lineitem").groupBy("l_suppkey", F.floor(F.col("l_quantity") / 5).cast("int").alias("x")).agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("y"))
    out = tuning.shuffled_fits(cells, ["l_suppkey"], "x", "y")
    return rounded(rounded(out.drop("slope"), "r2", digits=8), "p")


_SIGNED = """a AS (SELECT l_suppkey, l_linenumber, avg(l_discount) AS x, avg(l_tax) AS y FROM lineitem GROUP BY 1, 2), pr AS (SELECT *, round(x - y, 9) AS d FROM a),
u AS (SELECT l_suppkey, d, rank() OVER (PARTITION BY l_suppkey ORDER BY abs(d)) + (count(*) OVER (PARTITION BY l_suppkey, abs(d)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY l_suppkey, abs(d)) AS ties FROM pr WHERE d <> 0),
w AS (SELECT l_suppkey, count(*) AS n_used, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus, sum(ties * ties - 1) AS tie FROM u GROUP BY 1)"""


@query(f"""WITH {_SIGNED} SELECT l_suppkey, n_used, round(w_plus, 2) AS w_plus, round(w_minus, 2) AS w_minus,
round(sign(w_plus - n_used * (n_used + 1) / 4.0::DOUBLE) * greatest(abs(w_plus - n_used * (n_used + 1) / 4.0::DOUBLE) - 0.5, 0) / sqrt(n_used * (n_used + 1) * (2 * n_used + 1) / 24.0::DOUBLE - tie / 48.0::DOUBLE), 6) AS z FROM w""")
def t1_signed_rank(spark, d):
    pairs = table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.avg("l_discount").alias("x"), F.avg("l_tax").alias("y"))
    out = stats.signed_rank(pairs, ["l_suppkey"], "x", "y", p_values=False)
    return rounded(rounded(out.select("l_suppkey", "n_used", "w_plus", "w_minus", "z"), "z"), "w_plus", "w_minus", digits=2)


@query()
def t2_signed_rank_p(spark, d):
    pairs = table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.avg("l_discount").alias("x"), F.avg("l_tax").alias("y"))
    return rounded(stats.signed_rank(pairs, ["l_suppkey"], "x", "y"), "x_median", "y_median", "z", "p")


@query("""WITH x AS (SELECT l_suppkey, l_returnflag AS g, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0::DOUBLE AS r,
count(*) OVER (PARTITION BY l_suppkey, l_quantity) AS ties FROM lineitem), b AS (SELECT l_suppkey, g, sum(r) AS r, count(*) AS n, sum(ties * ties - 1) AS tie FROM x GROUP BY 1, 2),
t AS (SELECT l_suppkey, sum(n)::DOUBLE AS n, count(*) - 1 AS df, sum(r * r / n) AS s, sum(tie) AS tie FROM b GROUP BY 1)
SELECT l_suppkey, n::BIGINT AS n, df, round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - tie / (n * n * n - n)), 6) AS h FROM t""")
def t10_kruskal_wallis(spark, d):
    out = stats.kruskal_wallis(table(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag", "l_quantity", p_values=False)
    return rounded(out, "h")


@query()
def t10_tukey_kramer(spark, d):
    lines = table(spark, d, "lineitem")
    return rounded(stats.tukey_kramer_ranks(lines, ["l_linestatus"], "l_returnflag", "l_quantity"), "difference", "p")


@query("""WITH s AS (SELECT l_returnflag, count(*) AS n, covar_pop(l_quantity, l_quantity) AS s11, covar_pop(l_discount, l_discount) AS s22, covar_pop(l_quantity, l_discount) AS s12, covar_pop(l_quantity, l_extendedprice) AS s1y,
covar_pop(l_discount, l_extendedprice) AS s2y, covar_pop(l_extendedprice, l_extendedprice) AS syy, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my FROM lineitem GROUP BY 1),
b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s)
SELECT l_returnflag, n, round(my - b1 * m1 - b2 * m2, 3) AS intercept, round(b1, 4) AS b1, round(b2, 3) AS b2, round((b1 * s1y + b2 * s2y) / syy, 8) AS r2 FROM b""")
def t17_two_regressors(spark, d):
    out = stats.two_regressors(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", "l_discount")
    return rounded(rounded(rounded(out, "intercept", "b2", digits=3), "b1", digits=4), "r2", digits=8)


@query("""SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 3) AS mean, round(stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS sem, round(median(o_totalprice), 4) AS median,
round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders GROUP BY 1""")
def a13_described(spark, d):
    out = stats.described(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice")
    return rounded(rounded(out, "sem", "median", "std", digits=4), "mean", digits=3)


@query("""WITH n AS (SELECT o_orderpriority, o_orderstatus, o_totalprice / avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) OVER (PARTITION BY o_orderpriority) AS v FROM orders)
SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus = 'F' THEN v END), 7) AS "F", round(avg(CASE WHEN o_orderstatus = 'O' THEN v END), 7) AS "O", round(avg(CASE WHEN o_orderstatus = 'P' THEN v END), 7) AS "P" FROM n GROUP BY 1""")
def a12_normalised_pivot(spark, d):
    out = stats.normalised(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", F.col("o_orderstatus") == "F", "v")
    return rounded(out.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.avg("v")), "F", "O", "P", digits=7)


@query("""WITH a AS (SELECT o_custkey, avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS x, avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS y FROM orders GROUP BY 1)
SELECT floor((y - x) / sqrt(2.0::DOUBLE) / 5000)::INT AS bin, count(*) AS n FROM a WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1""")
def a18_unity_histogram(spark, d):
    side = lambda v: F.avg(F.when(F.col("o_orderstatus") == v, F.col("o_totalprice")))
    pairs = table(spark, d, "orders").groupBy("o_custkey").agg(side("F").alias("x"), side("O").alias("y")).dropna()
    return stats.unity_histogram(pairs, [], "x", "y", 5000.0)


@query(f"""WITH {_hazen_sql('orders', 'o_orderpriority', 'o_totalprice', '[25.0::DOUBLE, 50, 75]')}, s AS (SELECT o_orderpriority, max(CASE WHEN prc = 25 THEN value END) AS q1, max(CASE WHEN prc = 50 THEN value END) AS median,
max(CASE WHEN prc = 75 THEN value END) AS q3 FROM q GROUP BY 1), f AS (SELECT *, q1 - 0.5::DOUBLE * (q3 - q1) AS low, q3 + 0.5::DOUBLE * (q3 - q1) AS high FROM s)
SELECT f.o_orderpriority, round(q1, 8) AS q1, round(median, 8) AS median, round(q3, 8) AS q3, round(low, 8) AS low, round(high, 8) AS high, sum((o_totalprice < low OR o_totalprice > high)::INT)::BIGINT AS outliers
FROM orders JOIN f USING (o_orderpriority) GROUP BY ALL""")
def a19_box_summary(spark, d):
    return rounded(stats.box_summary(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", 0.5), "q1", "median", "q3", "low", "high", digits=8)


@query("""SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 8) AS share FROM orders GROUP BY 1, 2""")
def a17_win_shares(spark, d):
    n = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("o_orderpriority")), 8))


@query("""SELECT p_partkey, (SELECT min_by(s_suppkey, (abs(s_acctbal - p_retailprice), s_acctbal)) FROM supplier) AS near_s_suppkey FROM part""")
def j7_nearest(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_retailprice")
    found = intervals.nearest(parts, table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), [], "p_retailprice", "s_acctbal")
    return found.select("p_partkey", "near_s_suppkey")


@query("""WITH i AS (SELECT p_brand, p_size, min(p_retailprice) AS lower, lead(min(p_retailprice)) OVER (PARTITION BY p_brand ORDER BY min(p_retailprice), p_size) AS upper FROM part GROUP BY 1, 2)
SELECT p.p_partkey, i.p_size AS region, i.lower, i.upper FROM part p LEFT JOIN i ON p.p_brand = i.p_brand AND p.p_retailprice < i.upper AND p.p_retailprice >= i.lower""")
def j6_layer_of_depth(spark, d):
    parts = table(spark, d, "part")
    low = parts.groupBy("p_brand", "p_size").agg(F.min("p_retailprice").alias("lower"))
    bands = low.withColumn("upper", F.lead("lower").over(Window.partitionBy("p_brand").orderBy("lower", "p_size"))).withColumnRenamed("p_size", "region")
    return anatomy.regions_of(parts.select("p_brand", "p_partkey", "p_retailprice"), bands, ["p_brand"], "p_retailprice").select("p_partkey", "region", "lower", "upper")


@query("""SELECT d.doc_id, CASE WHEN n_chars < 1000 THEN 'narrow' ELSE 'wide' END AS class FROM documents d JOIN labels l ON l.doc_id = d.doc_id AND quality = 1 AND NOT (toxic = 1 AND n_chars > 3000) WHERE regexp_matches(source, '^src1\\d')""")
def p6_quality_filter(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    votes = table(spark, d, "labels").filter("quality = 1").join(docs, "doc_id")
    votes = votes.withColumns({"first": F.when(F.col("toxic") == 1, "b"), "second": F.when(F.col("n_chars") > 3000, "b")})
    kept = select.curated(votes, ["first", "second"]).filter(F.col("source").rlike(r"^src1\d"))
    return kept.select("doc_id", F.when(F.col("n_chars") < 1000, "narrow").otherwise("wide").alias("class"))


@query("""SELECT o_orderkey, o_custkey, o_totalprice, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 4""")
def w6_top_four(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("place", F.row_number().over(w)).filter("place <= 4").select("o_orderkey", "o_custkey", "o_totalprice", "place")


@query("""WITH a AS (SELECT l_suppkey, avg(CASE WHEN l_linestatus = 'F' THEN l_discount END) AS x, avg(CASE WHEN l_linestatus = 'O' THEN l_discount END) AS y FROM lineitem GROUP BY 1), b AS (SELECT s_nationkey, x, y, sign(round(y - x, 9))::INT AS dir FROM a JOIN supplier ON s_suppkey = l_suppkey)
SELECT s_nationkey, round(median(x), 8) AS x_median, round(median(y), 8) AS y_median, sum((dir = 1)::INT)::BIGINT AS n_up, sum((dir = -1)::INT)::BIGINT AS n_down, sum((dir = 0)::INT)::BIGINT AS n_none, sum((x IS NULL OR y IS NULL)::INT)::BIGINT AS n_missing FROM b GROUP BY 1""")
def a20_scorecard(spark, d):
    side = lambda v: F.avg(F.when(F.col("l_linestatus") == v, F.col("l_discount")))
    pairs = table(spark, d, "lineitem").groupBy("l_suppkey").agg(side("F").alias("x"), side("O").alias("y"))
    pairs = pairs.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).withColumn("dir", F.signum(F.round(F.col("y") - F.col("x"), 9)).cast("int"))
    return rounded(stats.scorecard(pairs, ["s_nationkey"], "x", "y", "dir").select("s_nationkey", "x_median", "y_median", "n_up", "n_down", "n_none", "n_missing"), "x_median", "y_median", digits=8)


@query("""WITH g AS (SELECT n_regionkey, n_nationkey, avg(s_acctbal) AS v FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2)
SELECT r_name, round(avg(v), 5) AS mean, round(stddev_samp(v) / sqrt(count(v)), 5) AS sem, count(v) AS n FROM g JOIN region ON r_regionkey = n_regionkey GROUP BY 1""")
def m18_population_mean(spark, d):
    nations = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_nationkey").agg(F.avg("s_acctbal").alias("rate"))
    out = tuning.population_curve(nations.withColumnRenamed("n_regionkey", "bin"), []).join(table(spark, d, "region"), F.col("bin") == F.col("r_regionkey"))
    return rounded(out.select("r_name", "mean", "sem", "n"), "mean", "sem", digits=5)


@query("""WITH p AS (SELECT vec_id % 4 AS unit, unnest(range(0, len(embedding))) AS pixel, unnest(embedding)::DOUBLE AS v FROM embeddings), s AS (SELECT unit, pixel, abs(avg(v)) AS m, pixel % 8 AS x, pixel // 8 AS y FROM p GROUP BY 1, 2),
t AS (SELECT unit, sum(m) AS m, sum(m * x) / sum(m) AS cx, sum(m * y) / sum(m) AS cy, sum(m * x * x) / sum(m) - (sum(m * x) / sum(m)) * (sum(m * x) / sum(m)) AS a, sum(m * y * y) / sum(m) - (sum(m * y) / sum(m)) * (sum(m * y) / sum(m)) AS b,
sum(m * x * y) / sum(m) - (sum(m * x) / sum(m)) * (sum(m * y) / sum(m)) AS c FROM s GROUP BY 1)
SELECT unit, round(cx, 6) AS cx, round(cy, 6) AS cy, round(sqrt((a + b) / 2 + sqrt(((a - b) / 2) * ((a - b) / 2) + c * c)), 6) AS sigma_major, round(sqrt(greatest((a + b) / 2 - sqrt(((a - b) / 2) * ((a - b) / 2) + c * c), 0)), 6) AS sigma_minor, round(0.5 * atan2(2 * c, a - b), 5) AS angle FROM t""")
def v10_field_moments(spark, d):
    from trialspark.operators import rf

    pixels = table(spark, d, "embeddings").select((F.col("vec_id") % 4).alias("unit"), F.posexplode("embedding").alias("pixel", "v"))
    sta = pixels.groupBy("unit", "pixel").agg(F.avg(F.col("v").cast("double")).alias("sta"))
    return rounded(rounded(rf.field_moments(sta, ["unit"], 8), "cx", "cy", "sigma_major", "sigma_minor"), "angle", digits=5)
