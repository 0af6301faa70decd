"""Joins of points with intervals, nearest points, interpolation and pairs by place.

Range joins get a hashed part: intervals are exploded to time buckets, points fall in one, and the exact predicate runs
within the equal buckets. That also spreads a key with very many points over its buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.operators.ordered import neighbours

#: What an interval holds: closed on the left only, on both sides, on neither.
CLOSED = {"left": (">=", "<"), "both": (">=", "<="), "neither": (">", "<")}


def range_join(points: DataFrame, intervals: DataFrame, keys: list[str], time: str, low: str, high: str, bucket: float, closed: str = "left", how: str = "inner") -> DataFrame:
    """Points with each interval of their keys that holds them. how "left" keeps points without any.

    bucket: width of a time bucket; near the usual length of an interval is best.
    """
    if closed not in CLOSED:
        raise ValueError(f"closed is one of {sorted(CLOSED)}")
    ge, lt = CLOSED[closed]
    cell = lambda c: F.floor(F.col(c) / F.lit(float(bucket)))
    spread = intervals.filter(F.col(low) <= F.col(high)).withColumn("_bucket", F.explode(F.sequence(cell(low), cell(high))))
    placed = points.withColumn("_bucket", cell(time))
    spread = spread.withColumnsRenamed({k: f"_r_{k}" for k in keys}).withColumnRenamed("_bucket", "_r_bucket")
    match = F.expr(f"`{time}` {ge} `{low}` AND `{time}` {lt} `{high}`") & (F.col("_bucket") == F.col("_r_bucket"))
    for k in keys:
        match = match & (F.col(k) == F.col(f"_r_{k}"))
    return placed.join(spread, match, how).drop("_bucket", "_r_bucket", *(f"_r_{k}" for k in keys))


def window_rates(spikes: DataFrame, windows: DataFrame, keys: list[str], by: list[str], bucket: float, closed: str = "left") -> DataFrame:
    """Spikes, time and rate of the windows (keys, by, w0, w1) of each keys and by; windows of one group don't overlap."""
    counted = range_join(spikes.select(*keys, "t"), windows, keys, "t", "w0", "w1", bucket, closed).groupBy(*keys, *by).agg(F.count("*").alias("n_spikes"))
    time = windows.groupBy(*keys, *by).agg(F.sum(F.col("w1") - F.col("w0")).alias("dt"))
    out = time.join(counted, [*keys, *by], "left").withColumn("n_spikes", F.coalesce("n_spikes", F.lit(0)))
    return out.withColumn("rate", F.when(F.col("dt") > 0, F.col("n_spikes") / F.col("dt")))


def raster(spikes: DataFrame, triggers: DataFrame, keys: list[str], before: float, after: float) -> DataFrame:
    """Spikes around each trigger (keys, trigger_id, t0) with their lag, ends excluded."""
    around = triggers.withColumns({"_w0": F.col("t0") - before, "_w1": F.col("t0") + after})
    out = range_join(spikes, around, keys, "t", "_w0", "_w1", before + after, "neither")
    return out.withColumn("lag", F.col("t") - F.col("t0")).drop("_w0", "_w1")


def psth(spikes: DataFrame, triggers: DataFrame, keys: list[str], bin_s: float, before: float, after: float) -> DataFrame:
    """Spike counts by lag bin (the bin's number: its lower edge / bin_s), pooled over triggers; bins without spikes too."""
    low, high = -int(before // bin_s), int(after // bin_s)
    found = raster(spikes, triggers, keys, -low * bin_s, high * bin_s).withColumn("bin", F.floor(F.col("lag") / bin_s).cast("int"))
    counts = found.filter(F.col("lag") != F.col("bin") * bin_s).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    every = triggers.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
    return every.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def nearest(points: DataFrame, targets: DataFrame, keys: list[str], place: str, target: str) -> DataFrame:
    """Each point with the target of its keys nearest by place, its columns prefixed `near_`.

    Of targets as near the lower is taken, of those at one place the one whose columns come first in order. Points and
    targets are merged in order and dealt by range, so a key may have any number of them; each point looks at the last
    target before and the first after.
    """
    names = [c for c in targets.columns if c not in keys]
    tagged = targets.groupBy(*keys, F.col(target).cast("double").alias("_at")).agg(F.min(F.struct(*names)).alias("_t")).withColumn("_kind", F.lit(0))
    rest = [c for c in points.columns if c not in keys]
    mine = points.select(*keys, F.col(place).cast("double").alias("_at"), F.struct(*rest).alias("_p"), F.lit(1).alias("_kind"))
    both = tagged.unionByName(mine, allowMissingColumns=True)
    found = neighbours(both, keys, ["_at", "_kind"], F.when(F.col("_kind") == 0, F.struct("_at", "_t")), "_b", "_a").filter("_kind = 1")
    use_before = F.col("_a").isNull() | (F.col("_b").isNotNull() & (F.col("_at") - F.col("_b._at") <= F.col("_a._at") - F.col("_at")))
    best = F.when(use_before, F.col("_b._t")).otherwise(F.col("_a._t"))
    return found.withColumn("_best", best).select(*keys, "_p.*", *(F.col("_best")[n].alias(f"near_{n}") for n in names))


def interpolated(events: DataFrame, samples: DataFrame, keys: list[str], time: str, value: str, name: str = "value_at", extrapolate: bool = False) -> DataFrame:
    """Each event with the samples' value at its time, linear between the two around it.

    Outside the samples it is null, or with extrapolate follows the two samples at that end. Events and samples are merged
    in order and dealt by range, so a key may have any number of them.
    """
    rest = [c for c in events.columns if c not in keys]
    mine = events.select(*keys, F.col(time).alias("_at"), F.struct(*rest).alias("_e"), F.lit(1).alias("_kind"))
    points = samples.select(*keys, F.col(time).alias("_at"), F.struct(F.col(time).alias("t"), F.col(value).cast("double").alias("v")).alias("_s"), F.lit(0).alias("_kind"))
    both = points.unionByName(mine, allowMissingColumns=True)
    found = neighbours(both, keys, ["_at", "_kind"], F.col("_s"), "_b", "_a").filter("_kind = 1")
    p, q = F.col("_b"), F.col("_a")
    inside = p.isNotNull() & (q.isNotNull() | (F.col("_at") == p["t"]))
    if extrapolate:
        end = lambda order, n: points.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_nth <= 2").groupBy(*keys).agg(F.max_by("_s", "_nth").alias(n))
        found = found.join(end(F.col("_at"), "_second"), keys, "left").join(end(F.col("_at").desc(), "_last_but_one"), keys, "left")
        p, q = F.coalesce(p, q), F.when(p.isNull(), F.col("_second")).otherwise(F.coalesce(q, F.col("_last_but_one")))
    slope = F.when(q["t"] != p["t"], (q["v"] - p["v"]) / (q["t"] - p["t"])).otherwise(0.0)
    line = p["v"] + slope * (F.col("_at") - p["t"])
    return found.select(*keys, "_e.*", (line if extrapolate else F.when(inside, line)).alias(name))


def pairs_by_place(a: DataFrame, b: DataFrame, keys: list[str], order: str, most_apart: int | None = None) -> DataFrame:
    """The nth row of a with the nth of b within keys (b's columns prefixed `b_`), of ids at most most_apart from another."""
    number = lambda df: df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    other = number(b).select(*keys, "_nth", *(F.col(c).alias(f"b_{c}") for c in b.columns if c not in keys))
    out = number(a).join(other, [*keys, "_nth"]).drop("_nth")
    return out if most_apart is None else out.filter(F.abs(F.col(order) - F.col(f"b_{order}")) <= most_apart)


def replayed_originals(trials: DataFrame, keys: list[str], name: str, is_replay: str, trial: str) -> DataFrame:
    """trials with `original`: for a replay the one original with its file name, null without any or with several."""
    originals = trials.filter(~F.col(is_replay)).groupBy(*keys, name).agg(F.count("*").alias("_n"), F.min(trial).alias("_original"))
    joined = trials.join(originals, [*keys, name], "left")
    return joined.withColumn("original", F.when(F.col(is_replay) & (F.col("_n") == 1), F.col("_original"))).drop("_n", "_original")
