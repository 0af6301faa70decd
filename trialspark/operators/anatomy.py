"""Anatomy along a probe: regions of depths, relative layer depth, averages over probes, electrode geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.operators.intervals import range_join
from trialspark.operators.select import in_region

#: Codes of places above the brain and beyond the track.
ABOVE, BEYOND = -10, -11


def regions_of(clusters: DataFrame, intervals: DataFrame, keys: list[str], depth: str = "from_tip", bucket: float = 500.0) -> DataFrame:
    """clusters with region, lower and upper of the interval that holds the depth: lower <= depth < upper."""
    bounds = intervals.select(*keys, "region", "lower", "upper")
    return range_join(clusters, bounds, keys, depth, "lower", "upper", bucket, "left", "left").select(*clusters.columns, "region", "lower", "upper")


def relative_depths(clusters: DataFrame, intervals: DataFrame, keys: list[str], depth: str = "from_tip") -> DataFrame:
    """regions_of with the share of the way from the region's upper edge down; null where the region occurs more than once."""
    times = intervals.groupBy(*keys, "region").agg(F.count("*").alias("_times"))
    out = regions_of(clusters, intervals, keys, depth).join(times, [*keys, "region"], "left")
    share = (F.col("upper") - F.col(depth)) / (F.col("upper") - F.col("lower"))
    return out.withColumn("relative", F.when(F.col("_times") == 1, share)).drop("_times")


def layer_positions(clusters: DataFrame, intervals: DataFrame, keys: list[str], shank: str = "shank_id", depth: str = "from_tip") -> DataFrame:
    """clusters with `layer` and `relative` (0 at its upper edge, 1 at its lower one) by the anatomy of their own shank; of
    a cluster in no cortical layer '' and -1. intervals: keys, shank, region, lower, upper."""
    placed = regions_of(clusters, intervals, [*keys, shank], depth)
    inside = F.coalesce(in_region(F.col("region")), F.lit(False))
    share = (F.col("upper") - F.col(depth)) / (F.col("upper") - F.col("lower"))
    return placed.select(*clusters.columns, F.when(inside, F.col("region")).otherwise("").alias("layer"), F.when(inside, share).otherwise(-1.0).alias("relative"))


def depths_of_good(clusters: DataFrame, good: DataFrame, keys: list[str], shank: int, depth: str = "from_tip") -> DataFrame:
    """Depths of the good units on a shank."""
    return clusters.filter(F.col("shank_id") == shank).join(good.select(*keys), keys, "left_semi").select(*keys, depth)


def cluster_rows(clusters: DataFrame, intervals: DataFrame, keys: list[str], depth: str = "from_tip") -> DataFrame:
    """Export rows of clusters by probe and shank: region, relative depth within it and distance from the region's upper edge."""
    out = relative_depths(clusters, intervals, keys, depth)
    return out.withColumn("from_upper", F.col("upper") - F.col(depth)).drop("lower", "upper")


def anatomy_rows(intervals: DataFrame, keys: list[str], layers: list[str]) -> DataFrame:
    """Export rows of probes: thickness of each layer, a column for each."""
    thick = F.col("upper") - F.col("lower")
    return intervals.groupBy(*keys).agg(*(F.sum(F.when(F.col("region") == r, thick)).alias(r) for r in layers))


def amplitude_ratio(spikes: DataFrame, keys: list[str], amplitude: str = "amplitude") -> DataFrame:
    """Median over least amplitude of each cluster's spikes."""
    least = F.min(amplitude)
    return spikes.groupBy(*keys).agg(F.when(least != 0, F.median(amplitude) / least).alias("ratio"))


def depth_code(depth, brain: float, tip: float):
    """Codes for depths above the brain or beyond the track, null between."""
    return F.when(depth > brain, ABOVE).when(depth < tip, BEYOND)


def average_anatomy(layers: DataFrame, defaults: DataFrame) -> DataFrame:
    """Mean thickness of each layer over probes, a probe without a layer having its default (layer, thickness)."""
    probes = layers.select("probe_id").distinct().withColumn("_one", F.lit(1))
    every = probes.join(defaults.withColumn("_one", F.lit(1)), "_one").drop("_one")
    filled = every.join(layers.select("probe_id", "layer", F.col("thickness").alias("_t")), ["probe_id", "layer"], "left")
    means = filled.groupBy("layer").agg(F.avg(F.coalesce("_t", "thickness")).alias("thickness"), F.first("place").alias("place"))
    w = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return means.withColumn("lower", F.sum("thickness").over(w)).withColumn("upper", F.col("lower") - F.col("thickness"))


def place_on_average(clusters: DataFrame, average: DataFrame) -> DataFrame:
    """clusters (layer, relative) with their depth on the average anatomy."""
    return clusters.join(average.select("layer", "upper", "lower"), "layer").withColumn("depth", F.col("upper") + F.col("relative") * (F.col("lower") - F.col("upper")))


def electrode_geometry(spark, n: int, rows_per: int, row_um: float, columns_um: list[float], shanks: int = 1, pitch_um: float = 250.0) -> DataFrame:
    """Electrodes of a probe: shank, row, column, x and from_tip by arithmetic on their number."""
    k = F.col("id")
    within = k % (n // shanks)
    column = (within % rows_per).cast("int")
    out = spark.range(n).select(k.cast("int").alias("electrode"), F.floor(k / (n // shanks)).cast("int").alias("shank"), F.floor(within / rows_per).cast("int").alias("row"), column.alias("column"))
    x = F.get(F.array(*map(F.lit, columns_um)), F.col("column"))
    return out.withColumns({"x": x + F.col("shank") * pitch_um, "from_tip": F.col("row") * row_um})


def channels_along(geometry: DataFrame, channels: DataFrame) -> DataFrame:
    """Channels with their electrode's place, ordered within a shank by depth and then from the left, and their column."""
    joined = channels.join(geometry, "electrode")
    return joined.withColumn("place", F.row_number().over(Window.partitionBy("shank").orderBy("from_tip", "x"))).withColumn("column_rank", F.dense_rank().over(Window.partitionBy("shank").orderBy("x")))


def template_facts(templates: DataFrame) -> DataFrame:
    """Per template its best channel (the greatest peak to peak, of equals the first) and that peak to peak."""
    p2p = F.array_max("waveform") - F.array_min("waveform")
    return templates.withColumn("_p", p2p).groupBy("template_id").agg(F.max_by("channel_idx", F.struct("_p", -F.col("channel_idx"))).alias("best_channel"), F.max("_p").alias("peak_to_peak"))


def main_template(spikes: DataFrame, keys: list[str]) -> DataFrame:
    """The commonest template of each cluster, of equals the least."""
    n = spikes.groupBy(*keys, "template_id").agg(F.count("*").alias("_n"))
    return n.groupBy(*keys).agg(F.max_by("template_id", F.struct("_n", -F.col("template_id"))).alias("template_id"))
