"""Statistics of groups, all groups in one job: percentiles, rank tests, ANOVA, regressions, normalisations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.functions.tails import p_chi2, p_f, p_normal, p_signed_rank, p_studentized_range, p_t
from trialspark.operators.ordered import stored, value_places

#: Pairs up to which the signed-rank p is exact.
EXACT_PAIRS = 15


def count_up_to(array: str, less: str, value: str, low: int, high: int) -> str:
    """SQL of how many entries of a sorted array are less, by bisection; the entries before low are, those from high on (or beyond the array) aren't."""
    if low == high:
        return str(low)
    middle = (low + high) // 2
    return f"CASE WHEN get({array}, {middle}) {less} {value} THEN {count_up_to(array, less, value, middle + 1, high)} ELSE {count_up_to(array, less, value, low, middle)} END"


def near_ranks(df: DataFrame, keys: list[str], value: str, percents: list[float], accuracy: int = 20_000) -> DataFrame:
    """(keys, value, n, before, total, next) of the distinct values around each of the percents' ranks, as `value_places`
    has them for all values, by selection.

    A sketch per key, with a rank error of at most a part in `accuracy`, gives each percent a bracket four times as wide on
    either side. One aggregate then counts the values between brackets, by the number of brackets begun and ended, and the
    distinct values within; a key of up to `accuracy` values is one bracket. Nothing is dealt, sorted or stored but the
    few values within brackets, which are ordered within one.
    """
    share = 4.0 / accuracy
    ends = lambda sign: F.lit([min(1.0, max(0.0, p / 100 + sign * share)) for p in sorted(percents)])
    sketch = df.groupBy(*keys).agg(F.count("*").alias("total"), F.percentile_approx(value, ends(-1), accuracy).alias("_low"), F.percentile_approx(value, ends(1), accuracy).alias("_high"))
    # A small key's only bracket begins and ends nowhere.
    sketch = sketch.withColumns({c: F.when(F.col("total") > accuracy, F.col(c)) for c in ("_low", "_high")})
    theirs = sketch.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    match = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys))
    many = len(percents)
    begun = F.expr(f"CASE WHEN _low IS NULL THEN 1 ELSE {count_up_to('_low', '<=', f'`{value}`', 0, many)} END")
    ended = F.expr(f"CASE WHEN _high IS NULL THEN 0 ELSE {count_up_to('_high', '<', f'`{value}`', 0, many)} END")
    placed = df.join(theirs, match).select(*keys, "total", begun.alias("_a"), ended.alias("_b"), F.col(value).alias("_v"))
    within = F.when(F.col("_a") > F.col("_b"), F.col("_v"))
    counts = placed.groupBy(*keys, "total", "_a", "_b", within.alias("_v")).agg(F.count("*").alias("n"))
    # Cells follow each other by the sum of begun and ended brackets; a key has at most two a percent, and one more.
    cell = F.col("_a") + F.col("_b")
    counts = counts.withColumn("_cell", cell)
    sizes = counts.groupBy(*keys, "_cell").agg(F.sum("n").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_cell").alias("_k_cell"), before.alias("_before"))
    inside = counts.filter("_a > _b").join(sizes, match & (F.col("_cell") == F.col("_k_cell")))
    w = Window.partitionBy(*keys, "_cell").orderBy("_v")
    so_far = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return inside.select(*keys, F.col("_v").alias(value), "n", (F.col("_before") + so_far).alias("before"), "total", F.lead("_v").over(w).alias("next"))


def hazen(df: DataFrame, keys: list[str], value: str, percents: list[float], name: str = "value", accuracy: int = 20_000) -> DataFrame:
    """Percentiles with the ith of n values at 100 (i - 0.5) / n, linear between, the extremes beyond: keys, prc, value."""
    kept = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    places = near_ranks(kept, keys, "_v", percents, accuracy)
    at = lambda prc: f"greatest(1D, least(double(total), {prc} / 100 * total + 0.5D))"
    here = lambda prc: f"floor({at(prc)}) > before AND floor({at(prc)}) <= before + n"
    some = " OR ".join(f"({here(f'{float(p)!r}D')})" for p in percents)  # compiled, and true of few values
    wanted = f"explode(filter(array({', '.join(f'{float(p)!r}D' for p in percents)}), p -> {here('p')}))"
    hit = places.filter(some).withColumn("prc", F.expr(wanted)).withColumn("_at", F.expr(at("prc")))
    above = F.when(F.floor("_at") + 1 <= F.col("before") + F.col("n"), F.col("_v")).otherwise(F.col("next"))
    line = F.col("_v") + F.coalesce(above - F.col("_v"), F.lit(0.0)) * (F.col("_at") - F.floor("_at"))
    return hit.select(*keys, "prc", line.alias(name))


def medians(df: DataFrame, keys: list[str], **columns: str) -> DataFrame:
    """keys and the median of each column, in one selection over all of them; null where a key has no value."""
    one = F.explode(F.array(*(F.struct(F.lit(n).alias("_name"), F.col(c).cast("double").alias("_value")) for n, c in columns.items())))
    long = df.select(*keys, one.alias("_m")).select(*keys, "_m.*")
    found = hazen(long, [*keys, "_name"], "_value", [50.0]).groupBy(*keys).agg(*(F.max(F.when(F.col("_name") == n, F.col("value"))).alias(n) for n in columns))
    return found


def quantile(value: str, share: float) -> Column:
    return F.percentile(value, F.lit(share))


def joined(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """df with the other columns of a table that has a row for each of its keys; null keys are keys."""
    theirs = other.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    match = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys), F.lit(True))
    return df.join(theirs, match, "left").drop(*(f"_k_{k}" for k in keys))


def described(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, sem, median, std, min and max by keys."""
    std = F.stddev_samp(value)
    told = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (std / F.sqrt(F.count(value))).alias("sem"), std.alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return joined(told, medians(df, keys, median=value), keys).select(*keys, "n", "mean", "sem", "median", "std", "min", "max")


def mean_in_order(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """(keys, name): the mean of value, with a key's values added one by one in order, so that its last bits don't depend on
    how rows are dealt. A key is one task, which streams its rows."""
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.select(*keys, F.sum(value).over(so_far).alias("_s"), F.count(value).over(so_far).alias("_n"), F.count("*").over(so_far).alias("_row"))
    last = sums.groupBy(*keys).agg(F.max_by(F.struct("_s", "_n"), "_row").alias("_last"))
    return last.select(*keys, F.when(F.col("_last._n") > 0, F.col("_last._s") / F.col("_last._n")).alias(name))


def mid_ranks(df: DataFrame, keys: list[str], value: str, name: str = "rank") -> DataFrame:
    """df with the rank of value within keys, equals sharing the mean of their ranks, and `ties`, how many are equal."""
    places = value_places(df.select(*keys, value), keys, value).select(*(F.col(c).alias(f"_p_{c}") for c in (*keys, value)), F.col("n").alias("ties"), (F.col("before") + (F.col("n") + 1) / 2).alias(name))
    match = F.lit(True)
    for c in (*keys, value):
        match = match & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    return df.join(places, match).drop(*(f"_p_{c}" for c in (*keys, value)))


def signed_rank(df: DataFrame, keys: list[str], x: str, y: str, exact_pairs: int = EXACT_PAIRS, p_values: bool = True, digits: int = 9) -> DataFrame:
    """Wilcoxon signed-rank of pairs by keys: n pairs, n_used (not equal), w_plus, w_minus of x - y, z, p and direction.

    Pairs with a null are left out, equal ones too. Differences are rounded to `digits` so that equal ones tie. p is exact
    over all signs up to exact_pairs used pairs, else normal with ties and half a step of continuity. Direction: 0 unless
    p < 0.05; else 1 where y's median is greater, -1 where less; of equal medians by the greater rank sum.
    """
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y, F.round(F.col(x) - F.col(y), digits).alias("_d"))
    pairs = stored(pairs)  # read by the medians, the counts of equal differences and their ranks
    medians = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.median(x).alias("x_median"), F.median(y).alias("y_median"))
    used = pairs.filter("_d <> 0").select(*keys, "_d", F.abs("_d").alias("_a"))
    ranked = mid_ranks(used, keys, "_a", "_rank")
    sums = ranked.groupBy(*keys).agg(
        F.count("*").alias("n_used"),
        F.sum(F.when(F.col("_d") > 0, F.col("_rank")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col("_d") < 0, F.col("_rank")).otherwise(0.0)).alias("w_minus"),
        F.sum(F.pow("ties", F.lit(2)) - 1).alias("_tie"),
    )
    n = F.col("n_used")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("_tie") / 48
    gap = F.col("w_plus") - n * (n + 1) / 4
    z = F.when(variance > 0, F.signum(gap) * F.greatest(F.abs(gap) - 0.5, F.lit(0.0)) / F.sqrt(variance)).otherwise(0.0)
    out = medians.join(sums, keys, "left").withColumns({"n_used": F.coalesce("n_used", F.lit(0)), "w_plus": F.coalesce("w_plus", F.lit(0.0)), "w_minus": F.coalesce("w_minus", F.lit(0.0))})
    out = out.withColumn("z", F.coalesce(z, F.lit(0.0))).drop("_tie")
    if not p_values:
        return out
    few = ranked.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") <= exact_pairs).drop("_n")
    lists = ranked.join(few, keys, "left_semi").groupBy(*keys).agg(F.sort_array(F.collect_list("_rank")).alias("_ranks"))
    out = out.join(lists, keys, "left")
    p = F.when(F.col("n_used") == 0, 1.0).otherwise(F.coalesce(p_signed_rank(F.col("_ranks"), F.col("w_plus")), p_normal(F.col("z"))))
    out = out.withColumn("p", p).drop("_ranks")
    greater = F.when(F.col("y_median") != F.col("x_median"), F.signum(F.col("y_median") - F.col("x_median"))).otherwise(F.signum(F.col("w_minus") - F.col("w_plus")))
    return out.withColumn("direction", F.when(F.col("p") < 0.05, greater).otherwise(0).cast("int"))


def one_tailed(tests: DataFrame) -> DataFrame:
    """Signed-rank tests with p_greater: of x being greater than y, not of their being different."""
    greater = F.when(F.col("w_plus") > F.col("w_minus"), F.col("p") / 2).when(F.col("w_plus") < F.col("w_minus"), 1 - F.col("p") / 2).otherwise(0.5)
    return tests.withColumn("p_greater", greater)


def kruskal_wallis(df: DataFrame, keys: list[str], group: str, value: str, p_values: bool = True) -> DataFrame:
    """H (corrected for ties), degrees of freedom and p of value between groups, by keys."""
    kept = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    ranked = mid_ranks(kept, keys, value, "_rank")
    by = ranked.groupBy(*keys, group).agg(F.sum("_rank").alias("_r"), F.count("*").alias("_n"), F.sum(F.pow("ties", F.lit(2)) - 1).alias("_tie"))
    out = by.groupBy(*keys).agg(F.sum("_n").alias("n"), (F.count("*") - 1).alias("df"), F.sum(F.col("_r") ** 2 / F.col("_n")).alias("_s"), F.sum("_tie").alias("_tie"))
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("_s") - 3 * (n + 1)) / (1 - F.col("_tie") / (n**3 - n))
    out = out.withColumn("h", h).drop("_s", "_tie")
    return out.withColumn("p", p_chi2(F.col("h"), F.col("df").cast("double"))) if p_values else out


def tukey_kramer_ranks(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """Pairs of groups (a < b) with the difference of mean ranks and its studentized-range p."""
    ranked = mid_ranks(df.filter(F.col(value).isNotNull()), keys, value, "_rank")
    by = ranked.groupBy(*keys, group).agg(F.avg("_rank").alias("mean_rank"), F.count("*").alias("n"))
    total = ranked.groupBy(*keys).agg(F.count("*").alias("_n"), F.countDistinct(group).alias("k"), F.sum(F.pow("ties", F.lit(2)) - 1).alias("_tie"))
    variance = F.col("_n") * (F.col("_n") + 1) / 12 - F.col("_tie") / (12 * (F.col("_n") - 1))
    side = lambda s: by.select(*keys, F.col(group).alias(s), F.col("mean_rank").alias(f"_m{s}"), F.col("n").alias(f"_n{s}"))
    pairs = side("a").join(side("b"), keys).filter("a < b").join(total, keys)
    gap = F.col("_ma") - F.col("_mb")
    q = F.abs(gap) / F.sqrt(variance / 2 * (1 / F.col("_na") + 1 / F.col("_nb")))
    return pairs.select(*keys, "a", "b", gap.alias("difference"), p_studentized_range(q, F.col("k"), F.lit(float("inf"))).alias("p"))


def chi2_equal(df: DataFrame, keys: list[str], category: str) -> DataFrame:
    """Chi-squared of the categories' counts against equal ones, by keys."""
    counts = df.groupBy(*keys, category).agg(F.count("*").alias("_n"))
    out = counts.groupBy(*keys).agg(F.sum("_n").alias("n"), (F.count("*") - 1).alias("df"), F.sum(F.col("_n").cast("double") ** 2).alias("_s"))
    out = out.withColumn("chi2", F.col("_s") * (F.col("df") + 1) / F.col("n") - F.col("n")).drop("_s")
    return out.withColumn("p", p_chi2(F.col("chi2"), F.col("df").cast("double")))


def two_way_anova(df: DataFrame, keys: list[str], a: str, b: str, value: str, p_values: bool = True, interaction: bool = True) -> DataFrame:
    """Balanced two-way ANOVA, by keys: F (and p) of a, b and a x b; without interaction it is left in the error, and only
    a and b are told. Rows with a null value are left out."""
    kept = df.filter(F.col(value).isNotNull())
    cells = kept.groupBy(*keys, a, b).agg(F.sum(value).alias("s"), F.count("*").alias("m"), F.sum(F.col(value) ** 2).alias("q"))
    square = lambda by: cells.groupBy(*keys, by).agg(F.sum("s").alias("s"), F.sum("m").alias("m")).groupBy(*keys).agg(F.sum(F.col("s") ** 2 / F.col("m")).alias(f"_{by}"), F.count("*").alias(f"_n{by}"))
    total = cells.groupBy(*keys).agg(F.sum("s").alias("_s"), F.sum("m").alias("n"), F.sum("q").alias("_q"), F.sum(F.col("s") ** 2 / F.col("m")).alias("_c"), F.count("*").alias("_nc"))
    t = total.join(square(a), keys).join(square(b), keys)
    mean = F.col("_s") ** 2 / F.col("n")
    df_a, df_b = F.col(f"_n{a}") - 1, F.col(f"_n{b}") - 1
    ss = {a: F.col(f"_{a}") - mean, b: F.col(f"_{b}") - mean}
    inter, rest = F.col("_c") - mean - ss[a] - ss[b], F.col("_q") - F.col("_c")
    df_rest = F.col("n") - F.col("_nc")
    if not interaction:
        rest, df_rest = rest + inter, F.col("n") - 1 - df_a - df_b
    error = rest / df_rest
    stats = {"a": (ss[a] / df_a / error, df_a), "b": (ss[b] / df_b / error, df_b)}
    if interaction:
        stats["ab"] = inter / (df_a * df_b) / error, df_a * df_b
    out = [v.alias(f"f_{k}") for k, (v, _) in stats.items()]
    if p_values:
        out += [p_f(v, d.cast("double"), df_rest.cast("double")).alias(f"p_{k}") for k, (v, d) in stats.items()]
    return t.select(*keys, "n", *out)


def lilliefors(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Greatest gap of the standardised values' distribution from the normal one, its 5 % critical value, and whether it is normal."""
    from trialspark.operators.rates import cumulative_kernel

    kept = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    moments = kept.groupBy(*keys).agg(F.avg("_v").alias("_mean"), F.stddev_samp("_v").alias("_sd"))
    placed = value_places(kept, keys, "_v").join(moments, keys)
    cdf = cumulative_kernel((F.col("_v") - F.col("_mean")) / F.when(F.col("_sd") > 0, F.col("_sd")), 1.0, 8.0, 4000)
    gap = F.greatest(F.abs((F.col("before") + F.col("n")) / F.col("total") - cdf), F.abs(cdf - F.col("before") / F.col("total")))
    out = placed.groupBy(*keys).agg(F.max("total").alias("n"), F.max(gap).alias("d"))
    critical = 0.895 / (F.sqrt("n") - 0.01 + 0.85 / F.sqrt("n"))  # the published approximation of the 5 % table
    return out.withColumn("critical", critical).withColumn("normal", F.col("d") <= F.col("critical"))


def modulation_index(x: Column, y: Column) -> Column:
    """(y - x) / (y + x); null where both are 0."""
    return F.when(y + x != 0, (y - x) / (y + x))


def zscore(df: DataFrame, keys: list[str], value: str, base: Column, name: str = "z") -> DataFrame:
    """df with value standardised by the rows where base holds."""
    kept = F.when(base, F.col(value))
    told = joined(df, df.groupBy(*keys).agg(F.avg(kept).alias("_mean"), F.stddev_samp(kept).alias("_std")), keys)
    return told.withColumn(name, (F.col(value) - F.col("_mean")) / F.col("_std")).drop("_mean", "_std")


def drops(df: DataFrame, keys: list[str], value: str, before: Column, after: Column, n_sd: float = 2.0) -> DataFrame:
    """By keys the means before and after, and whether the latter is more than n_sd deviations of the former lower."""
    b = F.when(before, F.col(value))
    out = df.groupBy(*keys).agg(F.avg(b).alias("before"), F.stddev_samp(b).alias("sd"), F.avg(F.when(after, F.col(value))).alias("after"))
    return out.withColumn("dropped", F.col("after") < F.col("before") - n_sd * F.col("sd"))


def isi_violations(spikes: DataFrame, keys: list[str], time: str, refractory: float, least: float = 0.0, corrected: bool = False) -> DataFrame:
    """Spikes, intervals shorter than refractory, and the false-positive rate: violations over the time in which they could
    be seen, 2 n (refractory - least), over the rate. corrected: (1 - sqrt(1 - 4 rate)) / 2 below a quarter, 1 from there on."""
    w = Window.partitionBy(*keys).orderBy(time)
    gaps = spikes.withColumn("_isi", F.col(time) - F.lag(time).over(w))
    out = gaps.groupBy(*keys).agg(F.count("*").alias("n"), F.sum((F.col("_isi") < refractory).cast("long")).alias("violations"), (F.max(time) - F.min(time)).alias("duration"))
    out = out.withColumn("violations", F.coalesce("violations", F.lit(0)))
    limit = 2 * (F.lit(refractory) - least) * F.col("n")
    rate = F.when(F.col("duration") > 0, (F.col("violations") / limit) / (F.col("n") / F.col("duration")))
    if corrected:
        rate = F.when(rate < 0.25, (1 - F.sqrt(1 - 4 * rate)) / 2).when(rate.isNotNull(), 1.0)
    return out.withColumn("fp_rate", rate)


def two_regressors(df: DataFrame, keys: list[str], y: str, x1: str, x2: str) -> DataFrame:
    """y on x1 and x2 by keys, by the normal equations of centred sums: intercept, b1, b2 and r2."""
    c = lambda a, b: F.covar_pop(a, b)
    s = df.dropna(subset=[y, x1, x2]).groupBy(*keys).agg(
        F.count("*").alias("n"), c(x1, x1).alias("_11"), c(x2, x2).alias("_22"), c(x1, x2).alias("_12"), c(x1, y).alias("_1y"), c(x2, y).alias("_2y"), c(y, y).alias("_yy"),
        F.avg(x1).alias("_m1"), F.avg(x2).alias("_m2"), F.avg(y).alias("_my"),
    )
    det = F.col("_11") * F.col("_22") - F.col("_12") ** 2
    b1 = F.when(det != 0, (F.col("_1y") * F.col("_22") - F.col("_2y") * F.col("_12")) / det)
    b2 = F.when(det != 0, (F.col("_2y") * F.col("_11") - F.col("_1y") * F.col("_12")) / det)
    out = s.withColumns({"b1": b1, "b2": b2})
    r2 = (F.col("b1") * F.col("_1y") + F.col("b2") * F.col("_2y")) / F.col("_yy")
    return out.select(*keys, "n", (F.col("_my") - F.col("b1") * F.col("_m1") - F.col("b2") * F.col("_m2")).alias("intercept"), "b1", "b2", F.when(F.col("_yy") > 0, r2).alias("r2"))


def linear_fit(df: DataFrame, keys: list[str], y: str, x: str, p_values: bool = False) -> DataFrame:
    """Slope, intercept, r and r2 (and the slope's p) of y on x, by keys."""
    r = F.corr(x, y)
    out = df.dropna(subset=[y, x]).groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), r.alias("r"), F.regr_r2(y, x).alias("r2"))
    if not p_values:
        return out
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("r") ** 2, F.lit(1e-300)))
    return out.withColumn("p", F.when(F.col("n") > 2, p_t(t, (F.col("n") - 2).cast("double"))))


def normalised(df: DataFrame, keys: list[str], value: str, reference: Column, name: str = "normalised") -> DataFrame:
    """df with value over the mean of the rows of its keys where reference holds."""
    told = joined(df, df.groupBy(*keys).agg(F.avg(F.when(reference, F.col(value))).alias("_mean")), keys)
    return told.withColumn(name, F.when(F.col("_mean") != 0, F.col(value) / F.col("_mean"))).drop("_mean")


def rescaled_to(df: DataFrame, reference: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """df with value scaled so that its mean (by keys, or of all) becomes the reference's."""
    if keys:
        means = df.groupBy(*keys).agg(F.avg(value).alias("_own")).join(reference.groupBy(*keys).agg(F.avg(value).alias("_other")), keys)
        joined = df.join(means, keys)
    else:
        own, other = (t.agg(F.avg(value).alias("m")).scalar() for t in (df, reference))
        joined = df.withColumn("_own", own).withColumn("_other", other)
    return joined.withColumn(name, F.when(F.col("_own") != 0, F.col(value) / F.col("_own") * F.col("_other"))).drop("_own", "_other")


def distribution(df: DataFrame, keys: list[str], value: str, width: float, n_edges: int = 20) -> DataFrame:
    """Share of values by keys and cell of a width, with how many of the equal-population edges lie below the cell's end."""
    cells = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.floor(F.col(value) / width).cast("int").alias("cell")).agg(F.count("*").alias("_n"))
    edges = hazen(df, keys, value, [100.0 * k / n_edges for k in range(n_edges + 1)], "_edge").groupBy(*keys).agg(F.collect_list("_edge").alias("_edges"))
    below = F.size(F.filter("_edges", lambda e: e < (F.col("cell") + 1) * F.lit(float(width)))).alias("edges_below")
    share = (F.col("_n") / F.sum("_n").over(Window.partitionBy(*keys))).alias("share")
    return cells.join(edges, keys).select(*keys, "cell", share, below)


def scorecard(df: DataFrame, keys: list[str], x: str, y: str, direction: str) -> DataFrame:
    """Medians and quartiles of both sides, how many went up, down or neither, and how many lack a side. Quartiles lie
    linearly between ranks, the first and last value being the ends."""
    return df.groupBy(*keys).agg(
        *(F.median(c).alias(f"{c}_median") for c in (x, y)),
        *(quantile(c, q).alias(f"{c}_q{n}") for c in (x, y) for n, q in ((1, 0.25), (3, 0.75))),
        *(F.sum((F.col(direction) == v).cast("long")).alias(n) for n, v in (("n_up", 1), ("n_down", -1), ("n_none", 0))),
        F.sum((F.col(x).isNull() | F.col(y).isNull()).cast("long")).alias("n_missing"),
    )


def bonferroni(p: Column, n: int) -> Column:
    return F.least(F.lit(1.0), p * n)


def category_tests(pairs: DataFrame, keys: list[str], category: str, value: str, rest: str, p_values: bool = True) -> DataFrame:
    """By keys and category the signed-rank test of value against rest, p times the key's number of categories (at most 1),
    and the direction of what is significant then (1 where value is greater)."""
    tests = signed_rank(pairs, [*keys, category], rest, value, p_values=p_values)
    if not p_values:
        return tests
    many = tests.groupBy(*keys).agg(F.count("*").alias("_many"))
    out = joined(tests, many, keys).withColumn("p", F.least(F.lit(1.0), F.col("p") * F.col("_many"))).drop("_many")
    return out.withColumn("direction", F.when(F.col("p") < 0.05, F.col("direction")).otherwise(0))


def response_classes(tests: DataFrame, keys: list[str], category: str, kruskal_p: str, rank_p: str, rate: str) -> DataFrame:
    """Per unit 'tuned' (groups differ), 'responsive' (some category does from rest) or 'unresponsive', and the category of the greatest rate."""
    out = tests.groupBy(*keys).agg(F.min(kruskal_p).alias("_k"), F.min(rank_p).alias("_r"), F.max_by(category, rate).alias("preferred"))
    label = F.when(F.col("_k") < 0.05, "tuned").when(F.col("_r") < 0.05, "responsive").otherwise("unresponsive")
    return out.withColumn("class", label).drop("_k", "_r")


def unity_histogram(df: DataFrame, keys: list[str], x: str, y: str, width: float) -> DataFrame:
    """Counts of the distance (y - x) / sqrt 2 from the unity line, by bins of a width."""
    return df.groupBy(*keys, F.floor((F.col(y) - F.col(x)) / F.sqrt(F.lit(2.0)) / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def box_summary(df: DataFrame, keys: list[str], value: str, whisker: float = 1.5) -> DataFrame:
    """Hazen quartiles and median by keys, fences, and how many values lie beyond them."""
    q = hazen(df, keys, value, [25, 50, 75]).groupBy(*keys).agg(*(F.max(F.when(F.col("prc") == p, F.col("value"))).alias(n) for n, p in (("q1", 25.0), ("median", 50.0), ("q3", 75.0))))
    q = q.withColumns({"low": F.col("q1") - whisker * (F.col("q3") - F.col("q1")), "high": F.col("q3") + whisker * (F.col("q3") - F.col("q1"))})
    beyond = (F.col(value) < F.col("low")) | (F.col(value) > F.col("high"))
    return df.join(q, keys).groupBy(*keys, "q1", "median", "q3", "low", "high").agg(F.sum(beyond.cast("long")).alias("outliers"))
