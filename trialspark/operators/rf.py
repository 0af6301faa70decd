"""Receptive fields by reverse correlation: stimulus-triggered averages, nulls, masks and moments."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.functions.digests import md5_of_numbers
from trialspark.operators.ordered import following
from trialspark.operators.tuning import draw_index

DEGREES = 5.0
#: Spikes whose draws are hashed at once.
BLOCK = 1 << 20


def stimulus_counts(spikes: DataFrame, onsets: DataFrame, keys: list[str], unit: str, last_s: float = 0.25, bucket: float | None = None) -> DataFrame:
    """Spikes of each unit during each stimulus (keys, stim, onset), which lasts until the next onset, the last last_s.

    bucket: width of the time buckets that stimuli are spread over; by default the stimuli's mean length.
    """
    shown = following(onsets, keys, "onset", "w1").withColumns({"w0": F.col("onset"), "w1": F.coalesce("w1", F.col("onset") + last_s)})
    from trialspark.operators.intervals import range_join

    if bucket is None:
        bucket = shown.agg(F.avg(F.col("w1") - F.col("w0"))).first()[0] or 1.0
    hits = range_join(spikes, shown, keys, "t", "w0", "w1", bucket).groupBy(*keys, unit, "stim").agg(F.count("*").alias("n"))
    every = shown.select(*keys, "stim").join(spikes.select(*keys, unit).distinct(), keys)
    return every.join(hits, [*keys, unit, "stim"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def sparse_average(counts: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Mean count per cell and polarity of the stimuli that show it (cells: stim, cell, polarity)."""
    return counts.join(cells, "stim").groupBy(*keys, "cell", "polarity").agg(F.avg("n").alias("sta"), F.count("*").alias("n_frames"))


def sparse_frames(frames: DataFrame) -> DataFrame:
    """(stim, cell, polarity) of every cell that a stimulus shows; frames: stim and grid (array of -1, 0 and 1 by cell)."""
    return frames.select("stim", F.posexplode("grid").alias("cell", "polarity")).filter("polarity <> 0")


def compared_displays(sta: DataFrame, keys: list[str], display: str, x: str, y: str) -> DataFrame:
    """Per unit and polarity the correlation of the averages under two displays, cell by cell, and both greatest values."""
    side = lambda name, s: sta.filter(F.col(display) == name).select(*keys, "cell", "polarity", F.col("sta").alias(s))
    both = side(x, "x").join(side(y, "y"), [*keys, "cell", "polarity"])
    return both.groupBy(*keys, "polarity").agg(F.corr("x", "y").alias("r"), F.max("x").alias(f"{x}_peak"), F.max("y").alias(f"{y}_peak"), F.count("*").alias("n_cells"))


def pooled(counts: DataFrame, session: str, stim: str = "stim") -> DataFrame:
    """Stimulus counts of several sessions as one: a stimulus is told apart by its session too."""
    return counts.withColumn(stim, F.struct(F.col(session), F.col(stim)))


def permutation_null(counts: DataFrame, cells: DataFrame, keys: list[str], reps: int = 100, seed: int = 1) -> DataFrame:
    """Mean and deviation over reps of the sparse average with counts dealt to other stimuli, by cell and polarity."""
    w = Window.partitionBy(*keys)
    numbered = counts.withColumns({"_i": F.row_number().over(w.orderBy("stim")) - 1, "_n": F.count("*").over(w)})
    spread = numbered.select(*keys, "stim", "n", "_i", "_n").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    order = Window.partitionBy(*keys, "rep").orderBy(draw_index(F.col("rep"), F.col("_i"), F.lit(1 << 30), seed), "_i")
    dealt = spread.withColumn("_i", F.row_number().over(order) - 1).select(*keys, "rep", "n", "_i")
    moved = dealt.join(numbered.select(*keys, "_i", "stim"), [*keys, "_i"])
    by = moved.join(cells, "stim").groupBy(*keys, "rep", "cell", "polarity").agg(F.avg("n").alias("sta"))
    return by.groupBy(*keys, "cell", "polarity").agg(F.avg("sta").alias("null_mean"), F.stddev_samp("sta").alias("null_std"))


def field_masks(sta: DataFrame, null: DataFrame, keys: list[str], columns: int, k: float = 3.0, least: int = 4) -> DataFrame:
    """Cells of each field: above null_mean + k * null_std and in a patch of at least `least` cells that touch, corners included."""
    key_schema = ", ".join(f"{c} {sta.schema[c].dataType.simpleString()}" for c in keys)
    hot = sta.join(null, [*keys, "cell", "polarity"]).filter(F.col("sta") > F.col("null_mean") + k * F.col("null_std"))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        left, out = set(map(int, rows["cell"])), []
        while left:
            patch, todo = [], deque([left.pop()])
            while todo:
                c = todo.popleft()
                patch.append(c)
                r, q = divmod(c, columns)
                for d in (i * columns + j for i in (r - 1, r, r + 1) for j in (q - 1, q, q + 1) if 0 <= j < columns):
                    if d in left:
                        left.remove(d)
                        todo.append(d)
            if len(patch) >= least:
                out += [(c, min(patch)) for c in patch]
        return pd.DataFrame([(*(rows[c].iloc[0] for c in keys), rows["polarity"].iloc[0], c, p) for c, p in out], columns=[*keys, "polarity", "cell", "patch"])

    return hot.groupBy(*keys, "polarity").applyInPandas(one, f"{key_schema}, polarity {sta.schema['polarity'].dataType.simpleString()}, cell int, patch int")


def field_sizes(masks: DataFrame, keys: list[str], columns: int, degrees: float = DEGREES) -> DataFrame:
    """Greatest number of masked cells in a row and in a column, in degrees."""
    row, column = F.floor(F.col("cell") / columns), F.col("cell") % columns
    widths = masks.groupBy(*keys, "polarity", row.alias("_r")).agg(F.count("*").alias("_w")).groupBy(*keys, "polarity").agg((F.max("_w") * degrees).alias("width"))
    heights = masks.groupBy(*keys, "polarity", column.alias("_c")).agg(F.count("*").alias("_h")).groupBy(*keys, "polarity").agg((F.max("_h") * degrees).alias("height"))
    return widths.join(heights, [*keys, "polarity"])


def frame_average(counts: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """Spike-weighted mean frame: counts (keys, frame, n) joined to frames (frame, pixels array), summed pixel by pixel."""
    pixels = counts.join(frames, "frame").select(*keys, "n", F.posexplode("pixels").alias("pixel", "value"))
    return pixels.groupBy(*keys, "pixel").agg((F.sum(F.col("n") * F.col("value").cast("double")) / F.sum("n")).alias("sta"), F.sum("n").alias("n_spikes"))


def best_lags(sta: DataFrame, keys: list[str], lag: str = "lag", null: DataFrame | None = None) -> DataFrame:
    """Per keys the lag whose average has the greatest signal to noise: its greatest absolute value over the null's
    deviation (null: keys, lag, null_std, a mean over pixels), without a null over the average's own."""
    by = sta.groupBy(*keys, lag).agg(F.max(F.abs("sta")).alias("_top"), F.stddev_samp("sta").alias("_s"))
    if null is not None:
        by = by.drop("_s").join(null.groupBy(*keys, lag).agg(F.avg("null_std").alias("_s")), [*keys, lag])
    snr = F.col("_top") / F.greatest(F.coalesce("_s", F.lit(0.0)), F.lit(2.0**-52))
    return by.withColumn("snr", snr).groupBy(*keys).agg(F.max_by(lag, F.struct("snr", -F.col(lag))).alias(lag), F.max("snr").alias("snr"))


def resampled_null(counts: DataFrame, frames: DataFrame, keys: list[str], reps: int = 100, seed: int = 1) -> DataFrame:
    """Mean and deviation over reps of the average with each of a unit's spikes dealt to one of its frames at random, by pixel.

    A spike's draw is a hash of its number and the repetition (that of `tuning.hashed_uniform`), turned to a frame by the
    inverse of the equal distribution. The hash is the same for all units, so each block of numbers is hashed once a
    repetition, and only how often each frame was hit leaves it.
    """
    w = Window.partitionBy(*keys).orderBy("frame")
    numbered = counts.select(*keys, "frame", (F.row_number().over(w) - 1).alias("_i"))
    total = counts.groupBy(*keys).agg(F.count("*").alias("_m"), F.sum("n").alias("_n")).filter("_n > 0")
    blocks = total.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / BLOCK))))
    asked = blocks.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    # The number of parts is given, since their rows are few and cost much.
    by_block = asked.repartition(reps, "rep", "_block").sortWithinPartitions("rep", "_block")
    key_schema = "".join(f"{c} {counts.schema[c].dataType.simpleString()}, " for c in keys)

    def hit(batches):
        at = hashes = None
        for rows in batches:
            for k, (rep, block, m, n) in enumerate(zip(rows["rep"], rows["_block"], rows["_m"], rows["_n"], strict=True)):
                if at != (rep, block):
                    # Rows of one block come together, those of units with most spikes maybe last.
                    at, hashes = (rep, block), np.empty(0, np.uint32)
                low, many = block * BLOCK, min(n - block * BLOCK, BLOCK)
                if len(hashes) < many:
                    hashes = np.concatenate([hashes, md5_of_numbers(f"{seed}:{rep}:", low + len(hashes), low + many)])
                n_hit = np.bincount(np.floor(hashes[:many] / 4294967296.0 * m).astype(np.int64))
                frame = n_hit.nonzero()[0]
                own = {c: rows[c].iloc[[k]].repeat(len(frame)).reset_index(drop=True) for c in keys}
                yield pd.DataFrame(own | {"rep": np.int32(rep), "_i": frame, "n": n_hit[frame]})

    drawn = by_block.mapInPandas(hit, f"{key_schema}rep int, _i long, n long")
    # Spark takes the draws for as few as the blocks that they come from, and would broadcast them.
    dealt = drawn.groupBy(*keys, "rep", "_i").agg(F.sum("n").alias("n")).hint("merge").join(numbered, [*keys, "_i"])
    sta = frame_average(dealt, frames, [*keys, "rep"])
    return sta.groupBy(*keys, "pixel").agg(F.avg("sta").alias("null_mean"), F.stddev_samp("sta").alias("null_std"))


def field_moments(sta: DataFrame, keys: list[str], columns: int, weight: str = "sta") -> DataFrame:
    """Center, axis deviations and angle of a field's weights (taken by absolute value) over a grid of cells (pixel)."""
    x, y, m = F.col("pixel") % columns, F.floor(F.col("pixel") / columns), F.abs(weight)
    sums = sta.groupBy(*keys).agg(F.sum(m).alias("_m"), *(F.sum(m * v).alias(n) for n, v in (("_x", x), ("_y", y), ("_xx", x * x), ("_yy", y * y), ("_xy", x * y))))
    mean = lambda c: F.col(c) / F.col("_m")
    out = sums.filter("_m > 0").select(*keys, mean("_x").alias("cx"), mean("_y").alias("cy"), (mean("_xx") - mean("_x") ** 2).alias("_a"), (mean("_yy") - mean("_y") ** 2).alias("_b"), (mean("_xy") - mean("_x") * mean("_y")).alias("_c"))
    half, root = (F.col("_a") + F.col("_b")) / 2, F.sqrt(((F.col("_a") - F.col("_b")) / 2) ** 2 + F.col("_c") ** 2)
    return out.select(*keys, "cx", "cy", F.sqrt(half + root).alias("sigma_major"), F.sqrt(F.greatest(half - root, F.lit(0.0))).alias("sigma_minor"), (0.5 * F.atan2(2 * F.col("_c"), F.col("_a") - F.col("_b"))).alias("angle"))
