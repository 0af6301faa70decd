"""Segmentation of sampled channels: edges, runs of a flag, sessions, trials, motion.

A mask over samples is kept as the table of its runs. All operators work on every key at once: one shuffle by the keys
and a sort by sample, which successive operators on the same keys share. Where a key may have any number of rows, such as
a session of a fast channel, `span` cuts it to stretches of the order column (see `scan`); results are the same.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.operators.intervals import range_join
from trialspark.operators.scan import Scan

HIGH = 2.5


def _by(keys: list[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def edges(df: DataFrame, keys: list[str], order: str, flag: Column, span: float | None = None) -> DataFrame:
    """The samples at which flag changes, with `edge` 1 (rising) or -1 (falling). A null flag is false."""
    marked = df.withColumn("_now", F.coalesce(flag, F.lit(False)).cast("int"))
    told = Scan(marked, keys, order, span).previous(_was=F.col("_now")).rows()
    return told.withColumn("edge", F.col("_now") - F.col("_was")).filter("edge <> 0").drop("_now", "_was")


def islands(df: DataFrame, keys: list[str], order: str, flag: Column, measures: dict[str, Column] | None = None, span: float | None = None) -> DataFrame:
    """The runs of true flags: keys, island (from 1), start and end (values of order), n samples, and measures."""
    marked = Scan(df.withColumn("_on", F.coalesce(flag, F.lit(False))), keys, order, span).previous(_was=F.col("_on"))
    numbered = marked.derive(_new=(F.col("_on") & ~F.coalesce("_was", F.lit(False))).cast("int")).running(island=F.col("_new")).rows()
    more = [v.alias(k) for k, v in (measures or {}).items()]
    return numbered.filter("_on").groupBy(*keys, "island").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n"), *more)


def merged(windows: DataFrame, keys: list[str], low: str = "w0", high: str = "w1", span: float | None = None) -> DataFrame:
    """Windows (keys, low, high) with those that overlap or touch made one."""
    told = Scan(windows.select(*keys, low, high), keys, low, span).running(F.max, _reach=F.col(high)).previous(_before=F.col("_reach"))
    new = F.coalesce((F.col(low) > F.col("_before")).cast("int"), F.lit(1))
    numbered = told.derive(_new=new).running(_group=F.col("_new")).rows()
    return numbered.groupBy(*keys, "_group").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("_group")


def _runs_of(df: DataFrame, keys: list[str], order: str, value: Column, run: str, span: float | None) -> Scan:
    """df with `_v`, `_new` (whether a run of one value begins) and the number of its run."""
    told = Scan(df.withColumn("_v", value), keys, order, span).previous(_was=F.struct(F.col("_v").alias("v")))
    return told.derive(_new=(F.col("_was").isNull() | ~F.col("_v").eqNullSafe(F.col("_was.v"))).cast("int")).running(**{run: F.col("_new")})


def states(df: DataFrame, keys: list[str], order: str, state: Column, span: float | None = None) -> DataFrame:
    """Runs of one state (any value; rows with a null one break runs): keys, state, run (from 1), start, end and n samples."""
    numbered = _runs_of(df.withColumn("state", state), keys, order, F.col("state"), "run", span).rows().filter(F.col("state").isNotNull())
    return numbered.groupBy(*keys, "run", "state").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n"))


def long_runs(runs: DataFrame, least: float, rate: float = 1.0, strict: bool = False) -> DataFrame:
    """Runs with duration (end - start) / rate of at least (strict: more than) `least`."""
    duration = (F.col("end") - F.col("start")) / F.lit(float(rate))
    out = runs.withColumn("duration", duration)
    return out.filter(F.col("duration") > least if strict else F.col("duration") >= least)


def flag_runs(df: DataFrame, keys: list[str], order: str, flag: Column, name: str, least: float, rate: float, span: float | None = None) -> DataFrame:
    """df with the boolean `name`: whether the sample is in a run of flag that lasts at least `least`."""
    told = Scan(df.withColumn("_on", F.coalesce(flag, F.lit(False))), keys, order, span).previous(_was=F.col("_on")).following(_next=F.col("_on"))
    change = lambda other: ~F.col("_on").eqNullSafe(F.col(other))
    placed = told.held(_low=F.when(change("_was"), F.col(order))).awaited(_high=F.when(change("_next"), F.col(order))).rows()
    duration = (F.col("_high") - F.col("_low")) / F.lit(float(rate))
    return placed.withColumn(name, F.col("_on") & (duration >= least)).drop("_on", "_was", "_next", "_low", "_high")


def acceleration(df: DataFrame, keys: list[str], order: str, velocity: str, rate: float, name: str = "acceleration", span: float | None = None) -> DataFrame:
    """Mean of the differences to both neighbours, in m/s2 of a velocity in cm/s; the ends repeat their neighbour's."""
    v, per = F.col(velocity), rate / 100.0
    near = Scan(df, keys, order, span).previous(_b=v).following(_a=v).rows()
    before, after = v - F.col("_b"), F.col("_a") - v
    mean = (F.coalesce(before, after) + F.coalesce(after, before)) / 2
    return near.withColumn(name, mean * per).drop("_b", "_a")


def position(df: DataFrame, keys: list[str], order: str, velocity: str, rate: float, deadband: float = 0.1, blank: Column | None = None, name: str = "position", span: float | None = None) -> DataFrame:
    """Running sum of velocity / rate; samples within the deadband, blanked or null count 0."""
    v = F.coalesce(F.col(velocity), F.lit(0.0))
    kept = F.when((F.abs(v) < deadband) | (F.coalesce(blank, F.lit(False)) if blank is not None else F.lit(False)), 0.0).otherwise(v)
    return Scan(df, keys, order, span).running(_sum=kept).rows().withColumn(name, F.col("_sum") / F.lit(float(rate))).drop("_sum")


def motion(df: DataFrame, keys: list[str], order: str, speed: str, rate: float, slow: float = 1.0, calm: float = 0.5, least: float = 0.2, span: float | None = None) -> DataFrame:
    """df with acceleration and `moving`: all samples but those of runs of slow, calm samples that last at least `least`."""
    both = acceleration(df, keys, order, speed, rate, span=span)
    still = (F.col(speed) < slow) & (F.abs("acceleration") < calm)
    return flag_runs(both, keys, order, still, "_still", least, rate, span).withColumn("moving", ~F.col("_still")).drop("_still")


def bouts(df: DataFrame, keys: list[str], order: str, moving: Column, rate: float, window: Column | None = None, true_start: bool = True, span: float | None = None) -> DataFrame:
    """Runs of motion within the analysis window; with true_start only those whose sample before lies in the window too."""
    inside = F.coalesce(window, F.lit(False)) if window is not None else F.lit(True)
    marked = Scan(df, keys, order, span).previous(_before=inside).rows().withColumn("_before", F.coalesce("_before", F.lit(False)))
    out = islands(marked, keys, order, moving & inside, {"_real": F.min_by("_before", order)}, span)
    return long_runs(out.filter("_real") if true_start else out, float("-inf"), rate).drop("_real")


def sessions(df: DataFrame, keys: list[str], time: str, gap: float, span: float | None = None) -> DataFrame:
    """df with `session`, from 1: a new one begins after a gap of more than `gap`."""
    told = Scan(df, keys, time, span).previous(_before=F.col(time))
    new = F.coalesce(((F.col(time) - F.col("_before")) > gap).cast("int"), F.lit(0))
    return told.derive(_new=new).running(session=F.col("_new")).rows().withColumn("session", F.col("session") + 1).drop("_new", "_before")


def session_bounds(df: DataFrame, keys: list[str], time: str, gap: float, span: float | None = None) -> DataFrame:
    return sessions(df, keys, time, gap, span).groupBy(*keys, "session").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"))


def synchronized(samples: DataFrame, pulses: DataFrame, keys: list[str], gap: float = 2.0, stretch: float = 1.0) -> DataFrame:
    """samples (keys, session, sample_idx) with probe_t: sample i of n lies at start + i / (n - 1) * stretch * (end - start)
    of its burst of pulses (keys, time)."""
    bursts = session_bounds(pulses, keys, "time", gap)
    n = F.max("sample_idx").over(Window.partitionBy(*keys, "session"))
    placed = samples.withColumn("_last", n).join(bursts.select(*keys, "session", "start", "end"), [*keys, "session"], "left")
    share = F.when(F.col("_last") > 0, F.col("sample_idx") / F.col("_last")).otherwise(0.0)
    return placed.withColumn("probe_t", F.col("start") + share * stretch * (F.col("end") - F.col("start"))).drop("_last", "start", "end")


def trials(samples: DataFrame, keys: list[str], gate: str, rate: float, lead_protocols: list[str], whole_protocols: list[str], lead_s: float = 4.0) -> DataFrame:
    """Trial intervals (keys, protocol, trial_id, start_idx, end_idx) between falling edges of the gate.

    Protocols in lead_protocols begin lead_s before their edge; those in whole_protocols are one trial, the whole trace;
    others run from edge to edge.
    """
    length = samples.groupBy(*keys, "protocol").agg(F.min("sample_idx").alias("_low"), F.max("sample_idx").alias("_high"))
    falls = edges(samples, keys, "sample_idx", F.col(gate) > HIGH).filter("edge = -1").select(*keys, "sample_idx")
    w = _by(keys, "sample_idx")
    cut = falls.withColumn("_next", F.lead("sample_idx").over(w)).withColumn("trial_id", F.row_number().over(w)).join(length, keys)
    back = F.when(F.col("protocol").isin(lead_protocols), F.lit(int(lead_s * rate))).otherwise(F.lit(0))
    cut = cut.filter(~F.col("protocol").isin(whole_protocols)).select(
        *keys, "protocol", "trial_id", F.greatest("_low", F.col("sample_idx") - back).alias("start_idx"), F.coalesce(F.col("_next") - back - 1, "_high").alias("end_idx")
    )
    whole = length.filter(F.col("protocol").isin(whole_protocols)).select(*keys, "protocol", F.lit(1).alias("trial_id"), F.col("_low").alias("start_idx"), F.col("_high").alias("end_idx"))
    return cut.unionByName(whole)


def baseline_windows(samples: DataFrame, keys: list[str], gate: str, time: str, closed_loop: list[str]) -> DataFrame:
    """(keys, t0, t1): 3 to 1 s before the gate's first fall in closed loop, 2 to 4 s after its first rise otherwise."""
    found = edges(samples, keys, time, F.col(gate) > HIGH)
    closed = F.col("protocol").isin(closed_loop)
    first = found.filter(F.when(closed, F.col("edge") == -1).otherwise(F.col("edge") == 1)).groupBy(*keys, "protocol").agg(F.min(time).alias("_t"))
    return first.select(*keys, F.when(closed, F.col("_t") - 3).otherwise(F.col("_t") + 2).alias("t0"), F.when(closed, F.col("_t") - 1).otherwise(F.col("_t") + 4).alias("t1"))


def analysis_windows(facts: DataFrame, after_start: float = 0.2, before_end: float = 0.55, after_mismatch: float = 3.0) -> DataFrame:
    """Trial times that are analysed, baseline included: a row per interval (trial columns, w0, w1), none overlapping.

    facts: a row per trial with kind ('closed', 'mismatch' or 'replay'), gate_low and gate_high (s, when the gate falls
    and rises), mismatch_on (s, null without) and travel_end_t (s, when 98 % of a replay's way is done). Closed loop: 3 s
    before the fall, then from after_start behind it until before_end ahead of the rise. A mismatch: on until its onset,
    and again after_mismatch later. Replay: from after_start behind the rise until the way is done, and 2 to 4 s behind it.
    """
    window = lambda a, b: F.struct(a.alias("w0"), b.alias("w1"))
    low, high = F.col("gate_low"), F.col("gate_high")
    closed = F.array(window(low - 3, low), window(low + after_start, high - before_end))
    mismatch = F.array(window(low - 3, F.col("mismatch_on")), window(F.col("mismatch_on") + after_mismatch, high - before_end))
    done = F.col("travel_end_t")
    replay = F.when(done >= high + 2, F.array(window(high + after_start, F.greatest(done, high + 4)))).otherwise(F.array(window(high + after_start, done), window(high + 2, high + 4)))
    pieces = F.when(F.col("kind") == "replay", replay).when((F.col("kind") == "mismatch") & F.col("mismatch_on").isNotNull(), mismatch).otherwise(closed)
    return facts.withColumn("_w", F.explode(pieces)).select(*facts.columns, "_w.w0", "_w.w1").filter("w1 > w0")


def mismatches(samples: DataFrame, keys: list[str], gain: str, time: str, stage: str, treadmill: str, level: float = HIGH, span: float | None = None) -> DataFrame:
    """Runs of a raised gain channel: onset, offset, duration and saliency (greatest stage - treadmill within)."""
    gap = F.col(stage) - F.col(treadmill)
    out = islands(samples, keys, time, F.col(gain) > level, {"saliency": F.max(gap), "saliency_t": F.max_by(time, gap)}, span)
    return out.withColumn("duration", F.col("end") - F.col("start")).withColumnsRenamed({"start": "onset", "end": "offset"})


def change_points(df: DataFrame, keys: list[str], order: str, value: str, offset: float = 0.0, span: float | None = None) -> DataFrame:
    """Intervals of a constant value along order: keys, instance, value, lower (its first place), upper (the next one's first)."""
    placed = _runs_of(df, keys, order, F.col(value), "instance", span).awaited(_at=F.when(F.col("_new") == 1, F.col(order))).following(_ahead=F.col("_at")).rows()
    runs = placed.groupBy(*keys, "instance", value).agg(F.min(order).alias("lower"), F.max(order).alias("_last"), F.max("_ahead").alias("_next"))
    upper = F.coalesce("_next", "_last")
    return runs.withColumn("upper", upper + offset).withColumn("lower", F.col("lower") + offset).drop("_last", "_next")


def blank(samples: DataFrame, ranges: DataFrame, keys: list[str], order: str, channel: str, baseline: float, bucket: float = 10_000) -> DataFrame:
    """samples with the channel set to baseline within any of ranges (keys, low, high), ends included."""
    near = range_join(samples.select(*keys, order), ranges.select(*keys, "low", "high"), keys, order, "low", "high", bucket, "both")
    hit = near.select(*keys, order).distinct().withColumn("_hit", F.lit(True))
    return samples.join(hit, [*keys, order], "left").withColumn(channel, F.when(F.col("_hit"), F.lit(baseline)).otherwise(F.col(channel))).drop("_hit")


def trial_lengths(samples: DataFrame, keys: list[str], place: str, far: float = 90.0) -> DataFrame:
    return samples.groupBy(*keys).agg(F.max(place).alias("reach")).withColumn("length_class", F.when(F.col("reach") > far, "long").otherwise("short"))


def slices(samples: DataFrame, intervals: DataFrame, keys: list[str], order: str = "sample_idx", bucket: float = 10_000) -> DataFrame:
    """Samples of each interval (keys, trial columns, start_idx, end_idx), ends included, with `offset` from its start."""
    joined = range_join(samples, intervals, keys, order, "start_idx", "end_idx", bucket, "both")
    return joined.withColumn("offset", F.col(order) - F.col("start_idx"))


def _lag_correlations(o: np.ndarray, r: np.ndarray, low: int, high: int) -> np.ndarray:
    """Correlations of o[i] with r[i + lag] over the i where both are numbers, for lag = low..high, by FFT; nan without any spread."""
    size = 1 << int(np.ceil(np.log2(len(o) + len(r))))
    shift = np.arange(low, high + 1)
    known = (shift > -len(o)) & (shift < len(r))
    both = lambda x, y: np.fft.irfft(np.conj(np.fft.rfft(x, size)) * np.fft.rfft(y, size), size)[shift[known] % size]
    parts = []
    for x in (o, r):
        told = np.isfinite(x)
        middle = x[told].mean() if told.any() else 0.0  # less to cancel
        parts.append((told.astype(float), np.where(told, x - middle, 0.0)))
    (mo, vo), (mr, vr) = parts
    n = np.rint(both(mo, mr))
    so, sr, oo, rr, cross = both(vo, mr), both(mo, vr), both(vo * vo, mr), both(mo, vr * vr), both(vo, vr)
    with np.errstate(invalid="ignore", divide="ignore"):
        spread_o, spread_r = oo - so * so / n, rr - sr * sr / n
        found = (cross - so * sr / n) / np.sqrt(spread_o * spread_r)
    least_o, least_r = 1e-12 * max(1e-300, (vo * vo).sum()), 1e-12 * max(1e-300, (vr * vr).sum())
    out = np.full(len(shift), np.nan)
    out[known] = np.where((n > 1) & (spread_o > least_o) & (spread_r > least_r), np.clip(found, -1, 1), np.nan)
    return out


def _lag_groups(original: DataFrame, replay: DataFrame, keys: list[str], order: str, value: str, choose) -> DataFrame:
    """(keys, lag, r) that `choose` takes from a key's two traces on one grid of whole steps; a group is one trial's pair."""
    schema = ", ".join(f"`{k}` {original.schema[k].dataType.simpleString()}" for k in keys) + ", lag int, r double"
    slim = lambda df, side: df.select(*keys, F.col(order).cast("long").alias("_at"), F.col(value).cast("double").alias("_v"), F.lit(side).alias("_side"))

    def dense(rows: pd.DataFrame, start: int) -> np.ndarray:
        out = np.full(int(rows["_at"].max()) - start + 1, np.nan)
        out[rows["_at"].to_numpy() - start] = rows["_v"].to_numpy(float)
        return out

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        o, r = (rows[rows["_side"] == side] for side in (0, 1))
        if not len(o) or not len(r):
            return pd.DataFrame(columns=[*keys, "lag", "r"])
        low, high = int(o["_at"].min()), int(r["_at"].min())
        lag, found = choose(dense(o, low), dense(r, high), low - high)
        return pd.DataFrame([(*(o[k].iloc[0] for k in keys), lag, None if np.isnan(found) else found)], columns=[*keys, "lag", "r"])

    return slim(original, 0).unionByName(slim(replay, 1)).groupBy(*keys).applyInPandas(one, schema)


def best_lag(original: DataFrame, replay: DataFrame, keys: list[str], order: str, value: str, lags: list[int], digits: int = 9) -> DataFrame:
    """Per keys the lag with the greatest correlation of replay (shifted back by it) with original, to `digits`; of equals
    the least. All lags come from a few Fourier transforms of a trial, whatever their number. order counts whole steps."""
    wanted = np.array(sorted(lags))

    def choose(o, r, shift):  # replay's sample lag steps ahead of o[i] is r[i + lag + shift]
        found = np.round(_lag_correlations(o, r, int(wanted[0]) + shift, int(wanted[-1]) + shift)[wanted - wanted[0]], digits)
        best = int(np.argmax(np.where(np.isnan(found), -2.0, found)))
        return int(wanted[best]), found[best]

    return _lag_groups(original, replay, keys, order, value, choose)


def matched_offset(original: DataFrame, replay: DataFrame, keys: list[str], order: str, value: str, coarse: int = 1000, digits: int = 9) -> DataFrame:
    """Per keys how many samples (0 or more) the replay's trace begins before the original's: the best of every `coarse`-th
    lag, then the best of those up to half as far from it, both traces counted from their first samples."""

    def choose(o, r, _shift):
        last = max(len(o), len(r)) - 1
        found = np.round(_lag_correlations(o, r, 0, last), digits)
        found = np.where(np.isnan(found), -2.0, found)
        rough = coarse * int(np.argmax(found[::coarse]))
        low = max(0, rough - coarse // 2)
        best = low + int(np.argmax(found[low : min(last + 1, rough + coarse - coarse // 2)]))
        return best, found[best] if found[best] >= -1 else np.nan

    return _lag_groups(original, replay, keys, order, value, choose)


def aligned(replay: DataFrame, original: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    """Replay samples beside the original's at offset - sample_offset; what has no partner is cut off."""
    shifted = replay.join(offsets, keys).withColumn("offset", F.col("offset") - F.col("sample_offset"))
    other = original.select(*[F.col(c) if c in keys or c == "offset" else F.col(c).alias(f"original_{c}") for c in original.columns])
    return shifted.join(other, [*keys, "offset"])
