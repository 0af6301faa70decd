"""Firing rates: spike trains, histograms, smoothed rates over intervals, spatial maps, heatmaps.

A mean of the smoothed rate over a mask is not taken from a dense trace: each spike adds the kernel's mass within each
interval, so a range join and a sum do.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.functions.gauss import Spikes
from trialspark.operators.intervals import interpolated, range_join
from trialspark.operators.ordered import row_numbers
from trialspark.operators.stats import joined

SIGMA, REACH, RATE = 0.02, 0.5, 10_000


def spike_train(spikes: DataFrame, keys: list[str], rate: float = RATE) -> DataFrame:
    """Spikes per sample of a time base that begins at 0; sample numbers from 1. Rounds halves up."""
    return spikes.groupBy(*keys, F.floor(F.col("t") * rate + 1.5).cast("long").alias("sample")).agg(F.count("*").alias("n"))


def counts_on_axis(spikes: DataFrame, keys: list[str], rate: float) -> DataFrame:
    """Spikes by keys and cell of a time axis with `rate` cells a second; cells without spikes are absent."""
    return spikes.groupBy(*keys, F.floor(F.col("t") * F.lit(float(rate))).cast("int").alias("cell")).agg(F.count("*").alias("n"))


def population_mean(table: DataFrame, unit: list[str], keys: list[str], axis: str, value: str) -> DataFrame:
    """Mean of value over all units, by keys and place on an axis; a unit without a row there counts 0."""
    units = table.select(*unit).distinct().agg(F.count("*")).scalar()
    return table.groupBy(*keys, axis).agg(F.sum(value).alias("_s")).select(*keys, axis, (F.col("_s") / units).alias(f"mean_{'count' if value == 'n' else value}"))


def coarse_traces(samples: DataFrame, keys: list[str], time: str, channels: list[str], rate: float = 60.0) -> DataFrame:
    """(keys, channel, step, at, value): each channel on a grid of about `rate` points a second, evenly from a trial's
    (keys) first sample to its last, linear between samples. All channels are looked up at once."""
    long = samples.select(*keys, F.col(time).cast("double").alias("_t"), F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("value")) for c in channels))).alias("_c")).select(*keys, "_t", "_c.*")
    ends = long.groupBy(*keys, "channel").agg(F.min("_t").alias("_low"), F.max("_t").alias("_high"))
    n = F.round((F.col("_high") - F.col("_low")) * rate).cast("int")
    steps = ends.withColumn("_n", n).filter("_n > 1").withColumn("step", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    # The last point is the last sample itself, whatever the product rounds to.
    at = F.when(F.col("step") == F.col("_n") - 1, F.col("_high")).otherwise(F.col("_low") + F.col("step") * ((F.col("_high") - F.col("_low")) / (F.col("_n") - 1)))
    grid = steps.select(*keys, "channel", "step", at.alias("at"))
    return interpolated(grid, long.withColumnRenamed("_t", "at"), [*keys, "channel"], "at", "value", "value")


def histogram(spikes: DataFrame, keys: list[str], low: float, high: float, width: float) -> DataFrame:
    """Counts of spikes between low and high (both excluded) in bins of a width; bins without spikes have no row."""
    inside = spikes.filter((F.col("t") > low) & (F.col("t") < high))
    return inside.groupBy(*keys, F.floor((F.col("t") - low) / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def merged_units(spikes: DataFrame, units: DataFrame, keys: list[str], unit: str, merged: int) -> DataFrame:
    return spikes.join(units, [*keys, unit], "left_semi").withColumn(unit, F.lit(merged))


def _table(sigma: float, reach: float, steps: int) -> list[float]:
    """The cumulative kernel at steps + 1 places from -reach to reach: a Gaussian cut off there and scaled to 1."""
    cdf = lambda x: 0.5 * math.erfc(-x / (sigma * math.sqrt(2)))
    low, high = cdf(-reach), cdf(reach)
    return [(cdf(-reach + 2 * reach * k / steps) - low) / (high - low) for k in range(steps + 1)]


def cumulative_kernel(x: Column, sigma: float = SIGMA, reach: float = REACH, steps: int = 1000) -> Column:
    """Mass of the smoothing kernel below x, by linear interpolation in a table of constants."""
    table = F.array(*map(F.lit, _table(sigma, reach, steps)))
    at = F.greatest(F.lit(0.0), F.least(F.lit(float(steps)), (x + reach) * (steps / (2 * reach))))
    k = F.least(F.floor(at), F.lit(steps - 1)).cast("int")
    a, b = F.get(table, k), F.get(table, k + 1)
    return a + (b - a) * (at - k)


def smoothed_means(spikes: DataFrame, intervals: DataFrame, keys: list[str], by: list[str], bucket: float, sigma: float = SIGMA, reach: float = REACH) -> DataFrame:
    """Mean smoothed rate over each group's intervals (keys, by, w0, w1), with their time."""
    wide = intervals.withColumns({"_w0": F.col("w0") - reach, "_w1": F.col("w1") + reach})
    near = range_join(spikes.select(*keys, "t"), wide, keys, "t", "_w0", "_w1", bucket, "both")
    mass = cumulative_kernel(F.col("w1") - F.col("t"), sigma, reach) - cumulative_kernel(F.col("w0") - F.col("t"), sigma, reach)
    sums = near.groupBy(*keys, *by).agg(F.sum(mass).alias("_mass"))
    time = intervals.groupBy(*keys, *by).agg(F.sum(F.col("w1") - F.col("w0")).alias("dt"))
    out = time.join(sums, [*keys, *by], "left")
    return out.withColumn("rate", F.when(F.col("dt") > 0, F.coalesce("_mass", F.lit(0.0)) / F.col("dt"))).drop("_mass")


def smoothed_at(spikes: DataFrame, times: DataFrame, keys: list[str], sigma: float = SIGMA, reach: float = REACH) -> DataFrame:
    """The smoothed rate at times (keys, at)."""
    wide = times.withColumns({"_w0": F.col("at") - reach, "_w1": F.col("at") + reach})
    near = range_join(spikes.select(*keys, "t"), wide, keys, "t", "_w0", "_w1", 2 * reach, "both")
    scale = 1 / (sigma * math.sqrt(2 * math.pi) * (1 - math.erfc(reach / (sigma * math.sqrt(2)))))
    weight = scale * F.exp(-F.pow(F.col("t") - F.col("at"), 2) / (2 * sigma**2))
    found = near.groupBy(*keys, "at").agg(F.sum(weight).alias("rate"))
    return times.join(found, [*keys, "at"], "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))


def grid(triggers: DataFrame, before: float, after: float, rate: float = 60.0) -> DataFrame:
    """triggers (t0) with a row per step of a grid around them: step, lag and at."""
    steps = F.sequence(F.lit(-round(before * rate)), F.lit(round(after * rate)))
    out = triggers.withColumn("step", F.explode(steps)).withColumn("lag", F.col("step") / rate)
    return out.withColumn("at", F.col("t0") + F.col("lag"))


def mean_response(spikes: DataFrame, triggers: DataFrame, keys: list[str], before: float, after: float, rate: float = 60.0, sigma: float = SIGMA, reach: float = REACH) -> DataFrame:
    """Mean smoothed rate by lag around triggers (keys, t0).

    Triggers are dealt by stretches of time, spikes to each stretch whose triggers they may reach; a task holds those of
    one, and of many spikes within reach no pairs are made (`functions.gauss`). A step's sum and count leave it.
    """
    steps = range(-round(before * rate), round(after * rate) + 1)
    scale = 1 / (sigma * math.sqrt(2 * math.pi) * (1 - math.erfc(reach / (sigma * math.sqrt(2)))))
    ends = steps[0] / rate - reach * 1.001, steps[-1] / rate + reach * 1.001
    span = F.lit((ends[1] - ends[0]) / 2)
    known = lambda df, time: df.select(*keys, F.col(time).cast("double").alias("_t")).filter(" AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, "_t")))
    stretch = lambda t: F.floor(t / span)
    shown = known(triggers, "t0").withColumns({"_stretch": stretch(F.col("_t")), "_is_spike": F.lit(False)})
    fired = known(spikes, "t").withColumn("_stretch", F.explode(F.sequence(stretch(F.col("_t") - ends[1]), stretch(F.col("_t") - ends[0])))).withColumn("_is_spike", F.lit(True))
    both = shown.unionByName(fired.join(shown.select(*keys, "_stretch").distinct(), [*keys, "_stretch"], "left_semi"))
    # The number of parts is given, since their rows are few and cost much.
    parts = int(triggers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key_schema = "".join(f"{c} {triggers.schema[c].dataType.simpleString()}, " for c in keys)

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        spike = rows["_is_spike"].to_numpy()
        times = rows["_t"].to_numpy()
        near, t0 = Spikes(times[spike], sigma, reach), np.sort(times[~spike])
        sums = [scale * float(near.sums(t0 + k / rate).sum()) for k in steps]
        return pd.DataFrame({**{c: [v] * len(steps) for c, v in zip(keys, key, strict=False)}, "step": list(steps), "_s": sums, "_n": len(t0)})

    told = both.repartition(parts, *keys, "_stretch").groupBy(*keys, "_stretch").applyInPandas(one, f"{key_schema}step int, _s double, _n long")
    return told.groupBy(*keys, "step").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("n_triggers")).select(*keys, "step", (F.col("_s") / F.col("n_triggers")).alias("rate"), "n_triggers")


def heatmap(responses: DataFrame, keys: list[str], lag: str, value: str, base: tuple[float, float], response: tuple[float, float]) -> DataFrame:
    """Per keys the mean of value in both lag windows, their difference, and the order by it (least first)."""
    return response_order(responses_within(responses, keys, lag, value, base, response), keys)


def responses_within(responses: DataFrame, keys: list[str], lag: str, value: str, base: tuple[float, float], response: tuple[float, float]) -> DataFrame:
    """Per keys the mean of value in both lag windows and their difference."""
    within = lambda w: F.avg(F.when((F.col(lag) >= w[0]) & (F.col(lag) < w[1]), F.col(value)))
    out = responses.groupBy(*keys).agg(within(base).alias("baseline"), within(response).alias("response"))
    return out.withColumn("delta", F.col("response") - F.col("baseline"))


def response_order(responses: DataFrame, keys: list[str], value: str = "delta") -> DataFrame:
    """responses with `place`, their number by value (least first)."""
    return row_numbers(responses, [value, *keys], "place")


def baseline_subtracted(responses: DataFrame, keys: list[str], lag: str, value: str, base: tuple[float, float]) -> DataFrame:
    mean = F.avg(F.when((F.col(lag) >= base[0]) & (F.col(lag) < base[1]), F.col(value)))
    told = joined(responses, responses.groupBy(*keys).agg(mean.alias("_mean")), keys)
    return told.withColumn("subtracted", F.col(value) - F.col("_mean")).drop("_mean")


def spatial_map(spikes: DataFrame, samples: DataFrame, keys: list[str], unit: str, width: float, dt: str, speed: str | None = None) -> DataFrame:
    """Rate by place bin: spikes (keys, unit, place) over occupancy of samples (keys, place, dt); bins never visited are absent."""
    cell = lambda c: F.floor(F.col(c) / width).cast("int")
    measures = [F.sum(dt).alias("occupancy"), *([(F.sum(F.col(speed) * F.col(dt)) / F.sum(F.when(F.col(speed).isNotNull(), F.col(dt)))).alias("mean_speed")] if speed else [])]
    visited = samples.groupBy(*keys, cell("place").alias("bin")).agg(*measures)
    fired = spikes.groupBy(*keys, unit, cell("place").alias("bin")).agg(F.count("*").alias("n"))
    every = visited.join(spikes.select(*keys, unit).distinct(), keys)
    out = every.join(fired, [*keys, unit, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("rate", F.when(F.col("occupancy") > 0, F.col("n") / F.col("occupancy")))


def smoothed_over_bins(table: DataFrame, keys: list[str], value: str, width: float, sigma: float, n_bins: int) -> DataFrame:
    """value smoothed over bin 0 to n_bins - 1 by a Gaussian, the ends mirrored; it is cut at four sigma."""
    reach = max(1, math.ceil(4 * sigma / width))
    spread = table.withColumn("_d", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("_to", F.col("bin") + F.col("_d"))
    mirrored = F.when(F.col("_to") < 0, -1 - F.col("_to")).when(F.col("_to") >= n_bins, 2 * n_bins - 1 - F.col("_to")).otherwise(F.col("_to"))
    weight = F.exp(-F.pow(F.col("_d") * width, 2) / (2 * sigma**2))
    out = spread.groupBy(*keys, mirrored.cast("int").alias("bin")).agg((F.sum(weight * F.col(value)) / F.sum(F.when(F.col(value).isNotNull(), weight))).alias("smoothed"))
    return table.join(out, [*keys, "bin"])


def field_order(maps: DataFrame, keys: list[str], rate: str = "rate") -> DataFrame:
    """Maps scaled to each unit's peak, with the peak's bin (of equals the first) and the units' order by it."""
    peak = maps.groupBy(*keys).agg(F.max_by("bin", F.struct(F.col(rate), -F.col("bin"))).alias("peak_bin"), F.max(rate).alias("peak"))
    peak = row_numbers(peak, ["peak_bin", *keys], "place")
    return maps.join(peak, keys).withColumn("scaled", F.when(F.col("peak") > 0, F.col(rate) / F.col("peak")))


def stationary_motion(spikes: DataFrame, stationary: DataFrame, moving: DataFrame, keys: list[str], unit: str, by: list[str], bucket: float, sigma: float = SIGMA, reach: float = REACH) -> DataFrame:
    """The central table: per trial and unit the smoothed rate and time at rest and in motion (interval tables: keys, by, w0, w1)."""
    units = spikes.select(*keys, unit).distinct()
    sides = []
    for name, table in (("stationary", stationary), ("motion", moving)):
        rates = smoothed_means(spikes, table.join(units, keys), [*keys, unit], by, bucket, sigma, reach)
        sides.append(rates.withColumnsRenamed({"rate": f"{name}_fr", "dt": f"{name}_time"}))
    return sides[0].join(sides[1], [*keys, unit, *by], "full")
