"""Raw signals: zero-phase filters, band power, moving averages, stimulus onsets, template matches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.operators.intervals import interpolated
from trialspark.operators.scan import STRETCH, Scan


def butterworth_sections(order: int, cutoff: float, rate: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sections (b, a) of a low-pass Butterworth filter by the bilinear transform."""
    warp = math.tan(math.pi * cutoff / rate)
    out = []
    for k in range(order // 2):
        q = 2 * math.sin(math.pi * (2 * k + 1) / (2 * order))
        norm = 1 + q * warp + warp * warp
        out.append((np.array([warp**2, 2 * warp**2, warp**2]) / norm, np.array([1, 2 * (warp**2 - 1) / norm, (1 - q * warp + warp**2) / norm])))
    if order % 2:
        out.append((np.array([warp, warp]) / (1 + warp), np.array([1, (warp - 1) / (1 + warp)])))
    return out


def _section_states(b: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """A, B, C and D of a section; a pair of complex poles turns and shrinks its two states, which keeps powers exact."""
    rest = b[1:] - a[1:] * b[0]
    if len(a) == 2:
        return np.array([[-a[1]]]), np.ones(1), rest, float(b[0])
    real, turn = -a[1] / 2, math.sqrt(a[2] - a[1] ** 2 / 4)
    return np.array([[real, -turn], [turn, real]]), np.array([1.0, 0.0]), np.array([rest[0], (rest[1] + rest[0] * real) / turn]), float(b[0])


class Recurrence:
    """A recursive filter as steps of a state: y = C z + D x, then z = A z + B x. Stretches are linear in what enters them,
    so they can be run from a zero state and corrected once the state that enters is known."""

    CHUNK = 64

    def __init__(self, sections: list[tuple[np.ndarray, np.ndarray]]):
        a, b, c, d = np.empty((0, 0)), np.empty(0), np.empty(0), 1.0
        for section in sections:  # one after the other
            a2, b2, c2, d2 = _section_states(*section)
            a = np.block([[a, np.zeros((len(a), len(a2)))], [np.outer(b2, c), a2]])
            b, c, d = np.r_[b, b2 * d], np.r_[d2 * c, c2], d * d2
        self.step, self.input, self.out, self.direct, self.order = a, b, c, d, len(a)
        k = self.CHUNK
        powers = [np.eye(self.order)]
        for _ in range(k):
            powers.append(a @ powers[-1])
        self.powers = powers
        self.free = np.stack([c @ p for p in powers[:k]])  # y of a chunk from its first state
        self.push = np.stack([p @ b for p in powers[:k]])[::-1].T  # last state from a chunk's x
        echo = np.r_[d, self.free[:-1] @ b]
        self.response = np.array([[echo[i - j] if i >= j else 0.0 for j in range(k)] for i in range(k)])

    def run(self, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """y of x from a state, and the state behind."""
        z = np.zeros(self.order) if state is None else np.asarray(state, float)
        k, m = self.CHUNK, len(x) // self.CHUNK
        whole, rest = np.asarray(x[: m * k], float).reshape(m, k), np.asarray(x[m * k :], float)
        pushed, states = whole @ self.push.T, np.empty((m, self.order))
        for j in range(m):
            states[j] = z
            z = self.powers[k] @ z + pushed[j]
        r = len(rest)
        tail = self.response[:r, :r] @ rest + self.free[:r] @ z
        y = np.r_[(whole @ self.response.T + states @ self.free.T).ravel(), tail]
        return y, self.powers[r] @ z + self.push[:, k - r :] @ rest

    def after(self, n: int) -> np.ndarray:
        """The matrix that takes a state over n steps without input."""
        return np.linalg.matrix_power(self.step, n)

    def alone(self, n: int) -> np.ndarray:
        """y of n steps without input, a row for each entry of the first state."""
        return np.stack([self.run(np.zeros(n), e)[0] for e in np.eye(self.order)])


def low_pass_recurrence(poles: int, cutoff: float, rate: float) -> Recurrence:
    return Recurrence(butterworth_sections(poles, cutoff, rate))


def low_pass(samples: DataFrame, keys: list[str], order: str, value: str, rate: float, cutoff: float = 50.0, poles: int = 3, name: str = "filtered", span: float | None = None) -> DataFrame:
    """samples with value filtered forward, then reversed, each from a zero state and without padding.

    Without a span a group is one trial, whose samples follow each other. With one, sessions of any length are cut to
    stretches of `span` of order: each stretch is run from zero states in both directions, the states at its ends are
    carried over the stretches' summary, and each stretch is run again from those. Nulls count as not a number.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema) + f", `{name}` double"
    filt = low_pass_recurrence(poles, cutoff, rate)
    p = filt.order

    def both(rows: pd.DataFrame, enter=None, back=None) -> pd.DataFrame:
        rows = rows.sort_values(order)
        y, _ = filt.run(rows[value].to_numpy(float), enter)
        return rows.assign(**{name: filt.run(y[::-1], back)[0][::-1]})

    if span is None:
        return samples.groupBy(*keys).applyInPandas(lambda rows: both(rows), schema)

    cut = Scan(samples, keys, order, span).df
    shape = f"_stretch {cut.schema[STRETCH].dataType.simpleString()}"
    ends = f"{shape}, _n long, _ahead array<double>, _back array<double>, _turned array<double>"

    def summary(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values(order)[value].to_numpy(float)
        y, ahead = filt.run(x)
        _, back = filt.run(y[::-1])
        turned = np.stack([filt.run(free[::-1])[1] for free in filt.alone(len(x))], 1)
        return pd.DataFrame({STRETCH: [rows[STRETCH].iloc[0]], "_n": [len(x)], "_ahead": [ahead], "_back": [back], "_turned": [turned.ravel()]})

    def carried(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.iloc[np.argsort([s["_cell"] for s in rows[STRETCH]])]
        over = [filt.after(int(n)) for n in rows["_n"]]
        enter, z = [], np.zeros(p)
        for m, ahead in zip(over, rows["_ahead"], strict=True):
            enter.append(z)
            z = m @ z + ahead
        back, z = [], np.zeros(p)
        for m, from_end, turned, s in reversed(list(zip(over, rows["_back"], rows["_turned"], enter, strict=True))):
            back.append(z)
            z = m @ z + from_end + np.asarray(turned).reshape(p, p) @ s
        return pd.DataFrame({STRETCH: rows[STRETCH].to_numpy(), "_enter": enter, "_exit": back[::-1]})

    told = cut.select(STRETCH, order, value).groupBy(STRETCH).applyInPandas(summary, ends)
    states = told.groupBy(*(F.col(f"{STRETCH}.{k}") for k in keys)).applyInPandas(carried, f"{shape}, _enter array<double>, _exit array<double>")
    names = [*samples.columns, name]

    def again(rows: pd.DataFrame) -> pd.DataFrame:
        return both(rows, rows["_enter"].iloc[0], rows["_exit"].iloc[0])[names]

    return cut.join(states, STRETCH).groupBy(STRETCH).applyInPandas(again, schema)


def batch_starts(duration: Column, first: float = 60.0, every: float = 300.0, length: float = 10.0) -> Column:
    """Starts of the batches that fit in a recording of a duration, as an array."""
    last = duration - length
    n = F.floor((last - first) / every).cast("int")
    return F.when(last >= first, F.transform(F.sequence(F.lit(0), n), lambda k: k * every + first)).otherwise(F.array().cast("array<double>"))


def band_power(samples: DataFrame, keys: list[str], order: str, value: str, rate: float, low: float = 500.0, high: float = 5000.0) -> DataFrame:
    """Power of value within a band by keys (a channel and batch), from a Hamming-windowed periodogram."""
    key_schema = ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in keys)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values(order)[value].to_numpy(float)
        return pd.DataFrame([(*(rows[k].iloc[0] for k in keys), _power_within(x, rate, low, high))], columns=[*keys, "power"])

    return samples.groupBy(*keys).applyInPandas(one, f"{key_schema}, power double")


def _power_within(x: np.ndarray, rate: float, low: float, high: float) -> float:
    window = np.hamming(len(x))
    power = np.abs(np.fft.rfft(x * window)) ** 2 / (rate * (window**2).sum())
    power[1 : -1 if len(x) % 2 == 0 else None] *= 2
    at = np.fft.rfftfreq(len(x), 1 / rate)
    return float(power[(at >= low) & (at <= high)].sum() * rate / len(x))


def recording_band_power(batches: DataFrame, rate: float, low: float = 500.0, high: float = 5000.0, channels: list[int] | None = None) -> DataFrame:
    """Power within a band by file, range (a batch) and channel, of samples (file, range, sample_idx, values by channel).

    Samples are shuffled as arrays of a channel's stretch, so a group is one channel's batch, whatever a recording's length.
    `channels` names the entries of values; by default they are numbered from 0.
    """
    pieces = "file string, range int, entry int, first long, data binary"

    def stretches(tables):
        for t in tables:
            rows = t.to_pandas()
            for (file, part), some in rows.groupby(["file", "range"], sort=False):
                some = some.sort_values("sample_idx")
                idx, data = some["sample_idx"].to_numpy(), np.stack(some["values"].to_numpy())
                for run in np.split(np.arange(len(idx)), np.flatnonzero(np.diff(idx) != 1) + 1):
                    yield pd.DataFrame([(file, part, c, idx[run[0]], data[run, c].astype("<i2").tobytes()) for c in range(data.shape[1])], columns=["file", "range", "entry", "first", "data"])

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.concatenate([np.frombuffer(d, "<i2") for d in rows.sort_values("first")["data"]]).astype(float)
        return pd.DataFrame([(*rows[["file", "range", "entry"]].iloc[0], _power_within(x, rate, low, high))], columns=["file", "range", "entry", "power"])

    def to_arrow(tables):
        for frame in stretches(tables):
            yield pa.RecordBatch.from_pandas(frame, pa.schema([("file", pa.string()), ("range", pa.int32()), ("entry", pa.int32()), ("first", pa.int64()), ("data", pa.binary())]), preserve_index=False)

    out = batches.select("file", "range", "sample_idx", "values").mapInArrow(to_arrow, pieces)
    out = out.groupBy("file", "range", "entry").applyInPandas(one, "file string, range int, entry int, power double")
    channel = F.col("entry") if channels is None else F.get(F.lit(channels), F.col("entry"))
    return out.select("file", "range", channel.cast("int").alias("channel"), "power")


def moving_average(df: DataFrame, keys: list[str], order: str, value: str, half: int, name: str = "smooth") -> DataFrame:
    """Mean over half rows to either side; near an end as many on both sides as there are."""
    w = Window.partitionBy(*keys).orderBy(order)
    place, count = F.row_number().over(w), F.count("*").over(Window.partitionBy(*keys))
    reach = F.least(F.lit(half), F.col("_i") - 1, F.col("_n") - F.col("_i"))
    out = df.withColumns({"_i": place, "_n": count, "_sum": F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    options = F.lit(None).cast("double")
    for k in range(half, -1, -1):
        mean = (F.lead("_sum", k).over(w) - F.coalesce(F.lag("_sum", k + 1).over(w), F.lit(0.0))) / (2 * k + 1)
        options = F.when(reach == k, mean).otherwise(options)
    return out.withColumn(name, options).drop("_i", "_n", "_sum")


def column_profiles(profile: DataFrame, keys: list[str], column: str, depth: str, power: str, step: float = 1.0, smooth: int = 25) -> DataFrame:
    """Power along each electrode column (keys, column) on a grid of depths `step` apart between its ends, linear between
    electrodes, and its mean over `smooth` grid places to either side."""
    ends = profile.groupBy(*keys, column).agg(F.min(depth).alias("_low"), F.max(depth).alias("_high"))
    places = F.sequence(F.lit(0), F.floor((F.col("_high") - F.col("_low")) / step).cast("int"))
    grid = ends.withColumn("_k", F.explode(places)).select(*keys, column, (F.col("_low") + F.col("_k") * F.lit(float(step))).alias(depth))
    filled = interpolated(grid, profile.select(*keys, column, F.col(depth).cast("double").alias(depth), power), [*keys, column], depth, power, power)
    return moving_average(filled, [*keys, column], depth, power, smooth)


def peak_depth(profile: DataFrame, keys: list[str], depth: str, power: str, low: float, high: float) -> DataFrame:
    """Depth of the greatest mean power within a range, of equals the lowest."""
    mean = profile.filter(F.col(depth).between(low, high)).groupBy(*keys, depth).agg(F.avg(power).alias("_p"))
    return mean.groupBy(*keys).agg(F.max_by(depth, F.struct("_p", -F.col(depth))).alias("peak_depth"), F.max("_p").alias("peak_power"))


def stimulus_onsets(samples: DataFrame, keys: list[str], order: str, value: str, low: float, high: float, dead: float) -> DataFrame:
    """Alternating crossings of a photodiode: above high, then below low and so on, each at least `dead` after the one before.

    A crossing depends on the one before it, so a session is one group.
    """
    key_schema = ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in keys)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        at, v = rows[order].to_numpy(float), rows[value].to_numpy(float)
        up, down = np.flatnonzero(v > high), np.flatnonzero(v < low)
        out, i, rising = [], 0, True
        while True:
            found = (up if rising else down)[np.searchsorted(up if rising else down, i) :]
            if not len(found):
                break
            out.append((float(at[found[0]]), 1 if rising else -1))
            i = int(np.searchsorted(at, at[found[0]] + dead))
            rising = not rising
        return pd.DataFrame([(*(rows[k].iloc[0] for k in keys), *x) for x in out], columns=[*keys, "onset", "edge"])

    return samples.groupBy(*keys).applyInPandas(one, f"{key_schema}, onset double, edge int")


def template_matches(trace: DataFrame, template: DataFrame, starts: DataFrame, keys: list[str], best: int) -> DataFrame:
    """Per keys the `best` starts whose stretch of the trace (keys, at, v) is nearest the template (k, m) by squared error."""
    n = template.count()
    pieces = starts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("at", F.col("start") + F.col("k"))
    errors = pieces.join(trace, [*keys, "at"]).join(template, "k").groupBy(*keys, "start").agg(F.sum((F.col("v") - F.col("m")) ** 2).alias("error"), F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("error", "start")
    return errors.filter(F.col("_n") == n).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= best).drop("_n")
