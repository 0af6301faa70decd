"""Comparisons of conditions: masks and their times, motion against motion, mismatches, populations, conditions of a tuning.

Everything is a composition of joins and aggregates over all units at once.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.operators.intervals import pairs_by_place, range_join, window_rates
from trialspark.operators.rates import smoothed_means
from trialspark.operators.scan import Scan
from trialspark.operators.segment import edges
from trialspark.operators.stats import hazen, joined, signed_rank, two_way_anova


def stationary(window: Column, *moving: Column) -> Column:
    """Within the analysis window and not in motion of any kind; a null flag is false."""
    return reduce(lambda a, m: a & ~F.coalesce(m, F.lit(False)), moving, F.coalesce(window, F.lit(False)))


def moving_by_protocol(protocol: Column, window: Column, masks: dict[str, Column]) -> Column:
    """Within the analysis window and moving by what counts for the protocol (masks by protocol); others never move."""
    moving = F.lit(False)
    for name, mask in masks.items():
        moving = F.when(protocol == name, mask).otherwise(moving)
    return F.coalesce(window & moving, F.lit(False))


def mask_times(samples: DataFrame, keys: list[str], masks: dict[str, Column], rate: float) -> DataFrame:
    """By keys the time that each mask holds: its samples over the rate."""
    return samples.groupBy(*keys).agg(*((F.count_if(F.coalesce(m, F.lit(False))) / F.lit(float(rate))).alias(f"{n}_time") for n, m in masks.items()))


def backward_starts(samples: DataFrame, keys: list[str], order: str, velocity: str, level: float = -10.0) -> DataFrame:
    """The samples at which velocity falls below level."""
    return edges(samples, keys, order, F.col(velocity) < level).filter("edge = 1").drop("edge")


def trains_around(spikes: DataFrame, starts: DataFrame, keys: list[str], start: str, before: float, after: float, width: float) -> DataFrame:
    """Spike counts by start (keys, start id, t0) and bin of a width; only bins with spikes."""
    around = starts.withColumns({"_w0": F.col("t0") - before, "_w1": F.col("t0") + after})
    near = range_join(spikes.select(*keys, "t"), around, keys, "t", "_w0", "_w1", before + after)
    return near.groupBy(*keys, start, F.floor((F.col("t") - F.col("t0")) / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def motion_vs_motion(rates: DataFrame, keys: list[str], trial: str, label: str, x: str, y: str, value: str, most_apart: int | None = None, most_pairs: int | None = None, **options) -> DataFrame:
    """Signed-rank of a value between two trial groups of each key: the nth trial of x with the nth of y.

    Pairs that lack a value don't count; of the others the first most_pairs do.
    """
    side = lambda name, column: rates.filter(F.col(label) == name).select(*keys, trial, F.col(value).alias(column))
    pairs = pairs_by_place(side(x, "x"), side(y, "y"), keys, trial, most_apart).withColumnRenamed("b_y", "y")
    pairs = pairs.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    if most_pairs is not None:
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(trial))
        pairs = pairs.withColumn("_nth", nth).filter(F.col("_nth") <= most_pairs).drop("_nth")
    return signed_rank(pairs, keys, "x", "y", **options)


def all_motion_pairs(rates: DataFrame, keys: list[str], trial: str, label: str, value: str, **options) -> DataFrame:
    """motion_vs_motion of every two trial groups (x before y by name) of each key."""
    numbered = rates.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, label).orderBy(trial)))
    side = lambda s: numbered.select(*keys, "_nth", F.col(label).alias(f"{s}_label"), F.col(value).alias(s))
    pairs = side("x").join(side("y"), [*keys, "_nth"]).filter("x_label < y_label")
    return signed_rank(pairs, [*keys, "x_label", "y_label"], "x", "y", **options)


def mismatch_responses(spikes: DataFrame, onsets: DataFrame, keys: list[str], trial: str, window: float, bucket: float, **smoothing) -> DataFrame:
    """(keys, trial, baseline, response, delta): mean smoothed rate in a window before and after each onset (keys, trial, t0)."""
    sides = []
    for name, a, b in (("baseline", -window, 0.0), ("response", 0.0, window)):
        windows = onsets.select(*keys, trial, (F.col("t0") + a).alias("w0"), (F.col("t0") + b).alias("w1"))
        sides.append(smoothed_means(spikes, windows, keys, [trial], bucket, **smoothing).select(*keys, trial, F.col("rate").alias(name)))
    return sides[0].join(sides[1], [*keys, trial]).withColumn("delta", F.col("response") - F.col("baseline"))


def mismatch_windows(onsets: DataFrame, keys: list[str], trial: str, onset: str, n_windows: int = 4, width: float = 0.1) -> DataFrame:
    """(keys, trial, part, window, w0, w1): n_windows windows of a width from each mismatch's onset on (response), as many
    before it (baseline), and as many before those (control); none overlap."""
    parts = F.explode(F.array(*(F.struct(F.lit(n).alias("part"), F.lit(k).alias("_k")) for n, k in (("control", -2), ("baseline", -1), ("response", 0)))))
    steps = F.explode(F.sequence(F.lit(0), F.lit(n_windows - 1)))
    spread = onsets.select(*keys, trial, onset, parts.alias("_p")).select(*keys, trial, onset, "_p.*", steps.alias("window"))
    step = F.col("_k") * n_windows + F.col("window")
    return spread.select(*keys, trial, "part", "window", (F.col(onset) + step * F.lit(float(width))).alias("w0"), (F.col(onset) + (step + 1) * F.lit(float(width))).alias("w1"))


def mismatch_anova(spikes: DataFrame, onsets: DataFrame, keys: list[str], unit: list[str], trial: str, onset: str, n_windows: int = 4, width: float = 0.1, p_values: bool = True) -> DataFrame:
    """Per unit the rates in a mismatch's baseline and response, F (and p) of part in a two-way ANOVA (part, window; no
    interaction) of baseline and response, and of baseline and control. With p values also whether the response is
    significant (p_response, null where control and baseline differ, below 0.05) and its direction.

    spikes: keys, t; onsets: keys, unit, trial, onset. A unit may span several keys.
    """
    windows = mismatch_windows(onsets, [*keys, *unit], trial, onset, n_windows, width)
    rates = window_rates(spikes, windows, keys, [*unit, trial, "part", "window"], max(width, n_windows * width))
    means = rates.groupBy(*unit).agg(*(F.avg(F.when(F.col("part") == p, F.col("rate"))).alias(p) for p in ("baseline", "response")))
    out = means
    for side in ("response", "control"):
        found = two_way_anova(rates.filter(F.col("part").isin("baseline", side)), unit, "part", "window", "rate", p_values, interaction=False)
        out = joined(out, found.select(*unit, F.col("f_a").alias(f"f_{side}"), *([F.col("p_a").alias(f"p_{side}")] if p_values else [])), unit)
    if not p_values:
        return out
    out = out.withColumn("p_response", F.when(F.coalesce(F.col("p_control") >= 0.05, F.lit(True)), F.col("p_response")))
    out = out.withColumn("significant", F.coalesce(F.col("p_response") < 0.05, F.lit(False)))
    return out.withColumn("direction", F.when(F.col("significant"), F.when(F.col("baseline") < F.col("response"), 1).otherwise(-1)).otherwise(0))


def mismatch_medians(responses: DataFrame, keys: list[str], mean: bool = False) -> DataFrame:
    """By keys the median (or mean) baseline and response, and their difference."""
    average = F.avg if mean else F.median
    out = responses.groupBy(*keys).agg(average("baseline").alias("baseline"), average("response").alias("response"), F.count("*").alias("n"))
    return out.withColumn("delta", F.col("response") - F.col("baseline"))


def quartile_table(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, measure, q1, median, q3) of several columns, Hazen's percentiles."""
    long = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in columns))).alias("_x")).select(*keys, "_x.*")
    q = hazen(long, [*keys, "measure"], "v", [25, 50, 75])
    return q.groupBy(*keys, "measure").agg(*(F.max(F.when(F.col("prc") == p, F.col("value"))).alias(n) for n, p in (("q1", 25.0), ("median", 50.0), ("q3", 75.0))))


def populations(deltas: DataFrame, label: str, unit: list[str], value: str, x: str, y: str, keys: list[str], **options) -> DataFrame:
    """Signed-rank over units of a value between two labels, units paired."""
    side = lambda name, column: deltas.filter(F.col(label) == name).select(*keys, *unit, F.col(value).alias(column))
    return signed_rank(side(x, "x").join(side(y, "y"), [*keys, *unit]), keys, "x", "y", **options)


def isi_pairs(spikes: DataFrame, keys: list[str], time: str, limit: float, width: float, span: float | None = None) -> DataFrame:
    """Histogram of the gaps between all pairs of spikes of a key that are less than limit apart (and more than 0), all spikes used.

    No pair is made: for each spike and edge of a bin, the spikes up to that far ahead are counted by one merge of edges
    and spikes, and a bin's pairs are the difference of two edges' sums. With `span`, a unit may have any number of spikes.
    """
    n = math.ceil(limit / width)
    edges = F.lit([min(k * width, limit) for k in range(n + 1)])
    at = spikes.select(*keys, F.col(time).alias("_t"))
    ahead = at.select(*keys, "_t", F.posexplode(edges).alias("bin", "_far")).select(*keys, (F.col("_t") + F.col("_far")).alias("_t"), F.when(F.col("bin") == 0, 2).otherwise(0).alias("_kind"), "bin")
    both = at.select(*keys, "_t", F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("bin")).unionByName(ahead)
    ranked = Scan(both, keys, "_t", span, ("_kind",)).running(_rank=F.col("bin").isNull().cast("long")).rows()
    sums = ranked.filter(F.col("bin").isNotNull()).groupBy(*keys, "bin").agg(F.sum("_rank").alias("_sum"))
    pairs = F.lead("_sum").over(Window.partitionBy(*keys).orderBy("bin")) - F.col("_sum")
    return sums.select(*keys, "bin", pairs.alias("n")).filter("n > 0")


def synthetic_sum(tuning: DataFrame, keys: list[str], label: str, bin: str, trial: str, value: str, rest: DataFrame, v: str = "V", t: str = "T", name: str = "V+T") -> DataFrame:
    """The curve of V + T: each trial of T with V's mean by bin less V's mean rate at rest (rest: keys, stationary_fr)."""
    mean = tuning.filter(F.col(label) == v).groupBy(*keys, bin).agg(F.avg(value).alias("_mean")).join(rest, keys)
    out = tuning.filter(F.col(label) == t).join(mean, [*keys, bin])
    return out.select(*keys, F.lit(name).alias(label), bin, trial, (F.col(value) + F.col("_mean") - F.col("stationary_fr")).alias(value))


def against_synthetic(tuning: DataFrame, sums: DataFrame, keys: list[str], label: str, bin: str, trial: str, value: str, **options) -> DataFrame:
    """Balanced two-way ANOVA (condition, bin) of measured and synthetic curves: as many first trials of each, without those that lack a bin."""
    both = tuning.select(*keys, label, bin, trial, value).unionByName(sums.select(*keys, label, bin, trial, value))
    whole = both.groupBy(*keys, label, trial).agg(F.count(value).alias("_have"), F.count("*").alias("_all"))
    nth = F.row_number().over(Window.partitionBy(*keys, label).orderBy(trial))
    numbered = whole.filter("_have = _all").withColumn("_nth", nth)
    least = numbered.groupBy(*keys, label).agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.min("_n").alias("_least"), F.count("*").alias("_sides")).filter("_sides = 2")
    used = numbered.join(least, keys).filter("_nth <= _least").select(*keys, label, trial)
    return two_way_anova(both.join(used, [*keys, label, trial], "left_semi"), keys, label, bin, value, **options)


def outcomes(fits: DataFrame, keys: list[str], label: str, labels: list[str]) -> DataFrame:
    """One row per key with each condition's tuning (is_tuned, p, model, r2; model 'N/A' where there is none) and whether
    the first two conditions' models agree."""
    columns = []
    for c in labels:
        mine = F.col(label) == c
        columns += [F.max(F.when(mine, F.col("p") < 0.05)).alias(f"{c}_is_tuned"), F.max(F.when(mine, F.col("p"))).alias(f"{c}_p"), F.coalesce(F.max(F.when(mine, F.col("model"))), F.lit("N/A")).alias(f"{c}_model"), F.max(F.when(mine, F.col("r2"))).alias(f"{c}_r2")]
    out = fits.groupBy(*keys).agg(*columns)
    a, b = (F.col(f"{c}_model") for c in labels[:2])
    return out.withColumn("models_agree", F.when((a != "N/A") & (b != "N/A"), a == b))


def focus_units(fits: DataFrame, keys: list[str], label: str, condition: str = "V", r2: float = 0.65) -> DataFrame:
    """The units whose tuning in a condition is significant and above r2."""
    return fits.filter((F.col(label) == condition) & (F.col("p") < 0.05) & (F.col("r2") > r2)).select(*keys).distinct()


def unit_medians(rates: DataFrame, keys: list[str], recording: str, x: str, y: str, **options) -> DataFrame:
    """Per unit and recording the medians of both sides, the signed-rank between them and the modulation index."""
    out = signed_rank(rates, [*keys, recording], x, y, **options)
    total = F.col("x_median") + F.col("y_median")
    return out.withColumn("modulation", F.when(total != 0, (F.col("y_median") - F.col("x_median")) / total))


def preferred_stimuli(responses: DataFrame, keys: list[str], stimulus: list[str], value: str, most: int = 4) -> DataFrame:
    """The `most` stimuli (sf, tf, direction) of each unit with the greatest median response, with their place."""
    medians = responses.groupBy(*keys, *stimulus).agg(F.median(value).alias("median"), F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("median"), *stimulus))
    return medians.withColumn("place", place).filter(F.col("place") <= most)


def grating_intervals(starts: DataFrame, keys: list[str], length: float, blanks: int = 4) -> DataFrame:
    """(keys, stim, kind, w0, w1): each stimulus from its start to the next one's, a last one before a pause for the mean
    duration of the others; and `blanks` intervals of `length` before the first and after each last one. starts: keys, stim, t0."""
    w = Window.partitionBy(*keys).orderBy("t0")
    gap = starts.withColumn("_gap", F.lead("t0").over(w) - F.col("t0")).withColumn("_first", F.row_number().over(w) == 1)
    mean = F.avg(F.when(F.col("_gap") < 2 * length, F.col("_gap"))).over(Window.partitionBy(*keys))
    told = gap.withColumn("_mean", mean)
    short = F.col("_gap") < 2 * length
    shown = told.select(*keys, "stim", F.lit("stimulus").alias("kind"), F.col("t0").alias("w0"), (F.col("t0") + F.when(short, F.col("_gap")).otherwise(F.col("_mean"))).alias("w1"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(blanks)))
    before = told.filter("_first").select(*keys, "stim", "t0", steps.alias("_k")).select(*keys, "stim", F.lit("blank").alias("kind"), (F.col("t0") - F.col("_k") * length).alias("w0"), (F.col("t0") - (F.col("_k") - 1) * length).alias("w1"))
    after = told.filter(F.col("_gap") >= 2 * length).select(*keys, "stim", "t0", steps.alias("_k")).select(*keys, "stim", F.lit("blank").alias("kind"), (F.col("t0") + F.col("_k") * length).alias("w0"), (F.col("t0") + (F.col("_k") + 1) * length).alias("w1"))
    return shown.unionByName(before).unionByName(after)


def spline_values(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A cubic spline through (x, y), x increasing, at places inside and beyond: its first two and last two pieces are one
    cubic each; of three points a parabola, of two a line."""
    n = len(x)
    if n < 4:
        return np.polyval(np.polyfit(x, y, n - 1), at)
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    below, middle, above, right = np.zeros(n), np.ones(n), np.zeros(n), np.zeros(n)  # of the second derivatives
    below[1:-1], middle[1:-1], above[1:-1], right[1:-1] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:], 6 * np.diff(slope)
    # The ends' rows, h1 m0 - (h0 + h1) m1 + h0 m2 = 0, lose their third entry to the rows next to them.
    for end, near, h0, h1, side in ((0, 1, h[0], h[1], above), (n - 1, n - 2, h[-1], h[-2], below)):
        share = h0 / side[near]
        middle[end] = h1 - share * (below if side is above else above)[near]
        (above if end == 0 else below)[end] = -(h0 + h1) - share * middle[near]
        right[end] = -share * right[near]
    for i in range(1, n):
        f = below[i] / middle[i - 1]
        middle[i] -= f * above[i - 1]
        right[i] -= f * right[i - 1]
    m = np.zeros(n)
    m[-1] = right[-1] / middle[-1]
    for i in range(n - 2, -1, -1):
        m[i] = (right[i] - above[i] * m[i + 1]) / middle[i]
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    a, b = x[k + 1] - at, at - x[k]
    return (m[k] * a**3 + m[k + 1] * b**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * a + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * b


def gaussian_values(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray | None:
    """a exp(-((t - b) / c)**2) fitted to (x, y) by damped Gauss-Newton steps, at places; none where no fit is found."""
    shape = lambda p, t: p[0] * np.exp(-(((t - p[1]) / p[2]) ** 2))
    p = np.array([y.max(), x[int(y.argmax())], 0.3])
    damping, error = 1e-2, ((y - shape(p, x)) ** 2).sum()
    for _ in range(200):
        base, u = shape(p, x), (x - p[1]) / p[2]
        jacobian = np.stack([base / p[0] if p[0] else np.exp(-(u**2)), base * 2 * u / p[2], base * 2 * u**2 / p[2]], 1)
        normal = jacobian.T @ jacobian
        try:
            new = p + np.linalg.solve(normal + damping * np.diag(np.diag(normal) + 1e-12), jacobian.T @ (y - base))
        except np.linalg.LinAlgError:
            return None
        fresh = ((y - shape(new, x)) ** 2).sum() if abs(new[2]) > 1e-9 else np.inf
        if np.isfinite(fresh) and fresh < error:
            done = error - fresh <= 1e-12 * max(error, 1e-300)
            p, error, damping = new, fresh, damping / 3
            if done:
                break
        else:
            damping *= 4
            if damping > 1e12:
                break
    return shape(p, at)


def planned_progress(samples: DataFrame, keys: list[str], time: str, velocity: str, plan: str, running: float = 2.0, least: float = 0.1) -> DataFrame:
    """As trip_progress, with the velocity planned by plan "gaussian" or "spline" (through the running samples); a trip is
    one group. Where no Gaussian is found it is a parabola."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema) + ", progress double"

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(time)
        t, v = rows[time].to_numpy(float), rows[velocity].to_numpy(float)
        x = (t - t[0]) / (t[-1] - t[0]) if t[-1] > t[0] else np.zeros(len(t))
        run = v > running
        planned = None
        if run.sum() < 3:
            planned = np.full(len(v), np.nanmean(v) if np.isfinite(v).any() else np.nan)
        elif plan == "spline":
            places, at = np.unique(x[run], return_inverse=True)
            planned = spline_values(places, np.bincount(at, v[run]) / np.bincount(at), x)
        else:
            planned = gaussian_values(x[run], v[run], x)
        if planned is None:
            planned = np.polyval(np.polyfit(x[run], v[run], 2), x)
        if run.sum() >= 3:
            planned = np.maximum(planned, least)
        dt = np.append(np.diff(t), 0.0)
        total = np.nansum(planned * dt)
        way = np.cumsum(np.where(np.isfinite(v), v, 0.0) * dt)
        return rows.assign(progress=np.clip(100 * way / total, 0, 100) if total else None)

    return samples.groupBy(*keys).applyInPandas(one, schema)


def trip_progress(samples: DataFrame, keys: list[str], time: str, velocity: str, running: float = 2.0, least: float = 0.1, plan: str = "parabola") -> DataFrame:
    """samples with `progress` (0 to 100): the way so far over the way of a planned trip, a parabola of the velocity in
    time fitted by trial (keys) to the running samples, at least `least` everywhere; with fewer than three the mean.
    plan: "parabola", "gaussian" or "spline"."""
    if plan not in ("parabola", "gaussian", "spline"):
        raise ValueError("plan is parabola, gaussian or spline")
    if plan != "parabola":
        return planned_progress(samples, keys, time, velocity, plan, running, least)
    w, whole = Window.partitionBy(*keys).orderBy(time), Window.partitionBy(*keys)
    first, last = F.min(time).over(whole), F.max(time).over(whole)
    placed = samples.withColumns({"_x": F.when(last > first, (F.col(time) - first) / (last - first)).otherwise(0.0), "_dt": F.coalesce(F.lead(time).over(w) - F.col(time), F.lit(0.0)), "_v": F.col(velocity).cast("double")})
    run = F.col("_v") > running
    power = {f"_s{k}": F.sum(F.when(run, F.pow("_x", F.lit(k)))) for k in range(5)} | {f"_y{k}": F.sum(F.when(run, F.pow("_x", F.lit(k)) * F.col("_v"))) for k in range(3)}
    sums = placed.groupBy(*keys).agg(*(v.alias(n) for n, v in power.items()), F.avg("_v").alias("_mean"))
    s, y = [F.col(f"_s{k}") for k in range(5)], [F.col(f"_y{k}") for k in range(3)]
    det3 = lambda m: m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    rows = [[s[0], s[1], s[2]], [s[1], s[2], s[3]], [s[2], s[3], s[4]]]
    det = det3(rows)
    enough = (s[0] >= 3) & (F.abs(det) > 1e-12)
    solved = [F.when(enough, det3([[y[i] if j == k else rows[i][j] for j in range(3)] for i in range(3)]) / det) for k in range(3)]
    fits = sums.select(*keys, "_mean", *(c.alias(f"_c{k}") for k, c in enumerate(solved)))
    curve = F.greatest(F.col("_c0") + F.col("_c1") * F.col("_x") + F.col("_c2") * F.col("_x") * F.col("_x"), F.lit(least))
    planned = placed.join(fits, keys).withColumn("_planned", F.when(F.col("_c0").isNull(), F.col("_mean")).otherwise(curve))
    so_far = F.sum(F.col("_v") * F.col("_dt")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(F.col("_planned") * F.col("_dt")).over(whole)
    progress = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * so_far / F.when(total != 0, total)))
    return planned.withColumn("progress", progress).drop("_x", "_dt", "_v", "_mean", "_planned", "_c0", "_c1", "_c2")


def rates_by_progress(samples: DataFrame, keys: list[str], value: str, width: float = 5.0) -> DataFrame:
    """Quartiles of a value by keys and bin of progress."""
    binned = samples.filter(F.col(value).isNotNull()).withColumn("bin", F.floor(F.col("progress") / width).cast("int"))
    return quartile_table(binned, [*keys, "bin"], [value]).drop("measure")


def exported_spikes(spikes: DataFrame, samples: DataFrame, keys: list[str], time: str, place: str, lags: list[float], images_per_place: float, at) -> DataFrame:
    """Spikes with the place at their time and the number of the image shown at each lag before: image_<lag in ms>.

    at: interpolated(events, samples, keys, time, value, name), which looks values up in the samples; all lags are looked
    up at once.
    """
    names = [f"image_{round(lag * 1000)}ms" for lag in lags]
    row = F.struct(*(F.col(c) for c in spikes.columns if c not in keys))
    asked = spikes.select(*keys, row.alias("_row"), F.posexplode(F.array(*(F.col(time) - lag for lag in (0.0, *lags)))).alias("_lag", time))
    seen = at(asked, samples, keys, time, place, "_place")
    one = lambda k: F.max(F.when(F.col("_lag") == k, F.col("_place")))
    # Rows that repeat ask the same, so each lag has as many answers as there are rows.
    wide = seen.groupBy(*keys, "_row").agg(F.count_if(F.col("_lag") == 0).alias("_n"), one(0).alias("position"), *(F.floor(one(k + 1) * images_per_place).cast("int").alias(n) for k, n in enumerate(names)))
    return wide.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select(*keys, "_row.*", "position", *names)


def with_stimulus(spikes: DataFrame, shown: DataFrame, keys: list[str], time: str, bucket: float) -> DataFrame:
    """spikes with `stim`, the stimulus shown (keys, stim, w0, w1) at their time, null between stimuli."""
    return range_join(spikes, shown.select(*keys, "stim", "w0", "w1"), keys, time, "w0", "w1", bucket, "left", "left").drop("w0", "w1")


def two_condition_classes(tests: DataFrame, keys: list[str], first: str = "V", second: str = "VT") -> DataFrame:
    """Per unit, by its class in two conditions (columns first and second: tuned, responsive or unresponsive): V tuned, V
    responsive, V silent but VT tuned, or none."""
    a, b = F.col(first), F.col(second)
    label = F.when(a == "tuned", f"{first}_tuned").when(a == "responsive", f"{first}_responsive").when(b == "tuned", f"{first}_silent_{second}_tuned").otherwise("none")
    return tests.withColumn("class", label).select(*keys, "class")


def ordered_medians(rates: DataFrame, keys: list[str], category: str, value: str, order: Column) -> DataFrame:
    """Median by key and category with `place`, the category's number by `order` (as in the first condition, greatest first)."""
    medians = rates.groupBy(*keys, category).agg(F.median(value).alias("median"), F.max(order).alias("_o"))
    return medians.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("_o"), category))).drop("_o")
