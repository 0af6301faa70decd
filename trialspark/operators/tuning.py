"""Tuning curves: equal-population bins, rates by bin, fits with shuffle nulls, model selection, classes."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.operators.rates import REACH, SIGMA, smoothed_means
from trialspark.operators.segment import islands
from trialspark.operators.stats import count_up_to, hazen

POLYNOMIALS = ("linear", "quadratic", "cubic")
MODELS = (*POLYNOMIALS, "gaussian", "asymmetric", "sigmoid")
#: Draws that are held at once, and fits of one numpy step.
_INDICES, _FITS = 1 << 22, 1 << 17


def equal_population_bins(samples: DataFrame, keys: list[str], value: str, n_bins: int = 20) -> DataFrame:
    """(keys, bin, lo, hi, center) of n_bins bins with as many samples each, by Hazen percentiles."""
    edges = hazen(samples, keys, value, [100.0 * k / n_bins for k in range(n_bins + 1)], "lo")
    w = Window.partitionBy(*keys).orderBy("prc")
    out = edges.withColumns({"bin": F.row_number().over(w), "hi": F.lead("lo").over(w)}).filter(F.col("bin") <= n_bins)
    return out.select(*keys, "bin", "lo", "hi", ((F.col("lo") + F.col("hi")) / 2).alias("center"))


def signed_bins(samples: DataFrame, keys: list[str], value: str, n_bins: int = 20) -> DataFrame:
    """Bins of all values, of those above 0 and of those below, told by `mode`: all, acc or dec."""
    return equal_population_bins(by_mode(samples, value), [*keys, "mode"], value, n_bins)


def by_mode(samples: DataFrame, value: str) -> DataFrame:
    """Each sample under mode all, and under acc (above 0) or dec (below)."""
    modes = F.array(*(F.when(c, F.lit(m)) for m, c in (("all", F.lit(True)), ("acc", F.col(value) > 0), ("dec", F.col(value) < 0))))
    return samples.withColumn("mode", F.explode(F.array_compact(modes)))


def tagged(curves: DataFrame, tests: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Tuning curves (or records) with columns of the tests (significance, direction) of their keys."""
    return curves.join(tests.select(*keys, *columns), keys)


def scaled_by_gain(samples: DataFrame, gains: DataFrame, keys: list[str], speed: str, name: str = "tf") -> DataFrame:
    """samples of trials with a known gain (keys, gain), with speed * gain."""
    return samples.join(gains, keys).withColumn(name, F.col(speed) * F.col("gain"))


def binned(samples: DataFrame, bins: DataFrame, keys: list[str], value: str) -> DataFrame:
    """samples with the bin whose [lo, hi) holds value; those below the first or at and above the last edge are left out.

    A key's edges are gathered to one short array, in which a sample is placed by bisection (of up to 63 bins compiled),
    without a range join. Bins of a key don't overlap.
    """
    arrays = bins.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("lo", "bin", "hi"))).alias("_bins")).withColumn("_lo", F.col("_bins.lo"))
    placed = samples.join(arrays, keys).withColumn("_value", F.col(value).cast("double"))
    count = f"CASE WHEN size(_lo) < 64 THEN {count_up_to('_lo', '<=', '_value', 0, 63)} ELSE size(filter(_lo, x -> x <= _value)) END"
    placed = placed.withColumn("_hit", F.get("_bins", F.expr(count) - 1))
    return placed.withColumn("bin", F.when(F.col("_value") < F.col("_hit.hi"), F.col("_hit.bin"))).filter("bin IS NOT NULL").drop("_bins", "_lo", "_value", "_hit")


def mean_by_bin(rows: DataFrame, bins: DataFrame, keys: list[str], by: list[str], axis: str, value: str) -> DataFrame:
    """Mean of value and number of rows in each bin of axis, by keys and by (a trial, say)."""
    return binned(rows, bins, keys, axis).groupBy(*keys, *by, "bin").agg(F.avg(value).alias("rate"), F.count("*").alias("n"))


def tuning_curve(spikes: DataFrame, samples: DataFrame, bins: DataFrame, keys: list[str], trial: str, axis: str, order: str, time: str, dt: float, bucket: float, moving: Column, sigma: float = SIGMA, reach: float = REACH) -> DataFrame:
    """Smoothed rate and time by bin and trial: runs of samples in one bin are intervals, whose kernel masses are summed.

    spikes: keys, t, on the clock of time; samples: keys, trial, order, time, axis.
    """
    placed = binned(samples.filter(moving), bins, keys, axis)
    runs = islands(placed.withColumn("_gap", F.col(order) - F.row_number().over(Window.partitionBy(*keys, trial, "bin").orderBy(order))), [*keys, trial, "bin", "_gap"], order, F.lit(True), {"w0": F.min(time), "w1": F.max(time) + dt})
    return smoothed_means(spikes, runs.select(*keys, trial, "bin", "w0", "w1"), keys, [trial, "bin"], bucket, sigma, reach)


def records(curve: DataFrame, bins: DataFrame, keys: list[str], trial: str) -> DataFrame:
    """A row per keys with the curve (bin, trial, rate, dt), edges and centers as nested arrays."""
    cells = curve.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin", trial, "rate", "dt"))).alias("tuning"))
    edges = bins.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin", "lo", "hi", "center"))).alias("bins"))
    return cells.join(edges, keys)


def shuffled_fits(cells: DataFrame, keys: list[str], x: str, y: str, reps: int = 1000, seed: int = 1, strict: bool = True) -> DataFrame:
    """r2 of y on x by keys, and p: the share of reps whose redrawn y (with replacement) fits better (strict) or as well.

    The draws of a repetition and cell are a hash, so reruns agree. A key's cells are one row of two arrays, and its redrawn
    fits stay in the task that made them: keys spread, and no draw is a row.
    """
    cell = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    # The number of parts is given, since their rows are few and cost much.
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = cells.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, x))).repartition(parts, *keys)
    real = known.groupBy(*keys).agg(F.regr_r2(y, x).alias("r2"), F.regr_slope(y, x).alias("slope"), F.count("*").alias("n"), F.sort_array(F.collect_list(cell)).alias("_cells"))
    arrays = real.select(*keys, "r2", "slope", "n", F.col("_cells.x").alias("_x"), F.col("_cells.y").alias("_y"))
    schema = "".join(f"{c} {cells.schema[c].dataType.simpleString()}, " for c in keys) + "r2 double, slope double, n long, p double"
    return arrays.mapInArrow(lambda batches: _shares_of_better_fits(batches, reps, seed, strict), schema)


def _shares_of_better_fits(batches: Iterator[pa.RecordBatch], reps: int, seed: int, strict: bool) -> Iterator[pa.RecordBatch]:
    """Rows of keys (n, _x, _y: their cells) with p; fits are held against one made the same way from the cells in order."""
    for batch in batches:
        n, lists = np.asarray(batch.column("n")), [batch.column(c).flatten() for c in ("_x", "_y")]
        null = np.asarray(lists[1].is_null().to_numpy(zero_copy_only=False))
        xs, ys = (np.where(gone, 0.0, v.to_numpy(zero_copy_only=False)) for v, gone in zip(lists, (False, null), strict=True))
        start, better, told = np.cumsum(n) - n, np.zeros(len(n), np.int64), np.zeros(len(n), bool)
        # Keys with as many cells have the same draws.
        for size in map(int, np.unique(n)):
            places, cell = np.flatnonzero(n == size), np.arange(size)
            at_once = max(1, min(reps, _INDICES // size))
            many = max(1, _FITS // at_once)
            for first in range(0, reps, at_once):
                drawn = draw_indices(np.arange(first, min(first + at_once, reps))[None, :], cell[:, None], size, seed)
                for k in range(0, len(places), many):
                    own = places[k : k + many]
                    at = start[own][:, None] + cell
                    x, y, held = xs[at], ys[at], None if not null[at].any() else ~null[at]
                    fit, no_fit = _r2((x[:, [i]], y[:, [i]], None if held is None else held[:, [i]]) for i in cell)
                    redrawn, none = _r2((x[:, [i]], y[:, drawn[i]], None if held is None else held[:, drawn[i]]) for i in cell)
                    more = (redrawn > fit) | (np.isnan(redrawn) & ~np.isnan(fit))  # as Spark and SQL order them
                    if not strict:
                        more |= (redrawn == fit) | (np.isnan(redrawn) & np.isnan(fit))
                    compared = np.broadcast_to(~none & ~no_fit, more.shape)
                    better[own] += (more & compared).sum(1)
                    told[own] |= compared.any(1)
        out = [c for c in batch.schema.names if c not in ("_x", "_y")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), pa.array(better / reps, mask=~told)], names=[*out, "p"])


def _r2(pairs: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray]:
    """r2 over pairs (x, y, which are known; None: all) and where there is none, with sums updated pair by pair as Spark does."""
    n = mean_x = mean_y = xy = xx = yy = 0.0
    for x, y, known in pairs:
        of = (lambda v: v) if known is None else (lambda v, k=known: np.where(k, v, 0.0))
        n = n + (1.0 if known is None else known)
        count = np.maximum(n, 1.0)
        dx, dy = of(x - mean_x), of(y - mean_y)
        mean_x, mean_y = mean_x + dx / count, mean_y + dy / count
        rest = of(y - mean_y)
        xy, xx, yy = xy + dx * rest, xx + dx * of(x - mean_x), yy + dy * rest
    with np.errstate(invalid="ignore", divide="ignore"):
        r = xy / np.sqrt(xx * yy)
        return np.where(yy == 0, 1.0, r * r), xx == 0


def draw_indices(rep: np.ndarray, cell: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """`draw_index` of arrays."""
    prime = 2_147_483_647
    a = (rep.astype(np.int64) * 48_271 + cell * 69_621 + (16_807 * seed + 12_345)) % prime
    b = (a * 39_373 + (a % 65_536) * 7 + 1) % prime
    return np.floor((b * 16_807 % prime) * n / float(prime)).astype(np.int64)


def draw_index(rep: Column, cell: Column, n: Column, seed: int = 1) -> Column:
    """A number from 0 to n - 1 by repetition and cell: multiplications modulo a prime, so any engine can repeat it."""
    prime = 2_147_483_647
    a = (rep.cast("long") * 48_271 + cell.cast("long") * 69_621 + F.lit(16_807 * seed + 12_345)) % prime
    b = (a * 39_373 + (a % 65_536) * 7 + 1) % prime
    return F.floor((b * 16_807 % prime) * n / F.lit(float(prime))).cast("long")


def hashed_uniform(*parts: Column, seed: int = 1) -> Column:
    """A number in [0, 1) of 32 bits of the MD5 of the parts, joined by colons: independent however the parts run."""
    text = F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def shuffle_envelope(cells: DataFrame, keys: list[str], bin_: str, y: str, reps: int = 1000, seed: int = 1) -> DataFrame:
    """Mean, deviation and count of redrawn values by bin and repetition, as their means over repetitions."""
    numbered = cells.withColumns({"_i": F.row_number().over(Window.partitionBy(*keys).orderBy(bin_, y)) - 1, "_n": F.count("*").over(Window.partitionBy(*keys))})
    spread = numbered.select(*keys, bin_, "_i", "_n").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    draw = spread.withColumn("_j", draw_index(F.col("rep"), F.col("_i"), F.col("_n"), seed)).drop("_i", "_n")
    by = draw.join(numbered.select(*keys, F.col("_i").alias("_j"), F.col(y).alias("_y")), [*keys, "_j"]).groupBy(*keys, bin_, "rep").agg(F.avg("_y").alias("m"), F.stddev_samp("_y").alias("s"), F.count("_y").alias("c"))
    return by.groupBy(*keys, bin_).agg(F.avg("m").alias("mean"), F.avg("s").alias("sd"), F.avg("c").alias("n"))


def _shape(model: str, p: np.ndarray, x: np.ndarray) -> np.ndarray:
    if model in POLYNOMIALS:
        return np.polyval(p, x)
    if model == "gaussian":
        return p[3] + p[0] * np.exp(-((x - p[1]) ** 2) / (2 * p[2] ** 2 + 1e-12))
    if model == "asymmetric":  # divided by the width itself, not by twice its square
        return p[4] + p[0] * np.exp(-((x - p[1]) ** 2) / (np.where(x < p[1], np.abs(p[2]), np.abs(p[3])) + 1e-12))
    return p[3] + p[0] / (1 + np.exp(-np.clip((x - p[1]) / np.where(np.abs(p[2]) > 1e-9, p[2], 1e-9), -60, 60)))


def _fit(model: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least squares: polynomials directly, the others by damped Gauss-Newton steps with numeric derivatives."""
    if model in POLYNOMIALS:
        return np.polyfit(x, y, POLYNOMIALS.index(model) + 1)
    span, high = max(np.ptp(x), 1e-9), y.max() - y.min()
    peak = x[int(y.argmax())]
    p = np.array({"gaussian": [high, peak, span / 4, y.min()], "asymmetric": [high, peak, span, span, y.min()], "sigmoid": [high, np.median(x), span / 8 * np.sign(np.corrcoef(x, y)[0, 1] or 1), y.min()]}[model], float)
    damping, error = 1e-2, ((y - _shape(model, p, x)) ** 2).sum()
    for _ in range(200):
        base = _shape(model, p, x)
        steps = 1e-6 * np.maximum(np.abs(p), 1e-3)
        jacobian = np.stack([(_shape(model, p + np.eye(len(p))[k] * s, x) - base) / s for k, s in enumerate(steps)], 1)
        normal = jacobian.T @ jacobian
        try:
            new = p + np.linalg.solve(normal + damping * np.diag(np.diag(normal) + 1e-9), jacobian.T @ (y - base))
        except np.linalg.LinAlgError:
            break
        fresh = ((y - _shape(model, new, x)) ** 2).sum()
        if np.isfinite(fresh) and fresh < error:
            done = error - fresh < 1e-10 * max(error, 1e-12)
            p, error, damping = new, fresh, damping / 3
            if done:
                break
        else:
            damping *= 4
            if damping > 1e12:
                break
    return p


def _fit_rows(model: str, x: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """The sum of squares that `_fit` leaves of each row of ys, the steps of all rows being made together."""
    if model in POLYNOMIALS:
        base, _ = np.linalg.qr(np.vander((x - x.mean()) / max(np.ptp(x), 1e-300), POLYNOMIALS.index(model) + 2))
        return ((ys - ys @ base @ base.T) ** 2).sum(1)
    high, low, peak = np.ptp(ys, axis=1), ys.min(1), x[ys.argmax(1)]
    span = np.full(len(ys), max(np.ptp(x), 1e-9))
    side = np.sign((ys - ys.mean(1, keepdims=True)) @ (x - x.mean()))
    start = {"gaussian": (high, peak, span / 4, low), "asymmetric": (high, peak, span, span, low), "sigmoid": (high, np.full(len(ys), np.median(x)), span / 8 * np.where(side == 0, 1, side), low)}
    p = np.stack(start[model], 1).astype(float)
    shape = lambda q: _shape(model, q.T[:, :, None], x)
    damping, error, active = np.full(len(ys), 1e-2), ((ys - shape(p)) ** 2).sum(1), np.ones(len(ys), bool)
    for _ in range(200):
        if not len(i := np.flatnonzero(active)):
            break
        q, y = p[i], ys[i]
        base, steps = shape(q), 1e-6 * np.maximum(np.abs(q), 1e-3)
        jacobian = np.stack([(shape(q + np.eye(q.shape[1])[k] * steps) - base) / steps[:, k, None] for k in range(q.shape[1])], 2)
        normal = jacobian.transpose(0, 2, 1) @ jacobian
        slack = damping[i, None] * (np.diagonal(normal, axis1=1, axis2=2) + 1e-9)
        normal += slack[:, :, None] * np.eye(q.shape[1])
        right = (jacobian.transpose(0, 2, 1) @ (y - base)[:, :, None])[:, :, 0]
        ok = np.isfinite(normal).all((1, 2)) & (np.linalg.det(np.where(np.isfinite(normal), normal, 0.0)) != 0)
        new = q.copy()
        new[ok] += np.linalg.solve(normal[ok], right[ok][:, :, None])[:, :, 0]
        fresh = ((y - shape(new)) ** 2).sum(1)
        better = ok & np.isfinite(fresh) & (fresh < error[i])
        done = ~ok | (better & (error[i] - fresh < 1e-10 * np.maximum(error[i], 1e-12)))
        p[i[better]], error[i[better]] = new[better], fresh[better]
        damping[i] = np.where(better, damping[i] / 3, damping[i] * 4)
        active[i] = ~(done | (~better & (damping[i] > 1e12)))
    return error


def fit_statistics(sse: float, total: float, n: int, k: int) -> tuple[float, float, float]:
    """r2, Gaussian log-likelihood and BIC of a fit with k parameters."""
    r2 = 1 - sse / total if total > 0 else math.nan
    log_likelihood = -n / 2 * (math.log(2 * math.pi * max(sse, 1e-300) / n) + 1)
    return r2, log_likelihood, k * math.log(n) - 2 * log_likelihood


def _by_place(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct x and the mean of y at each."""
    places, at = np.unique(x, return_inverse=True)
    return places, np.bincount(at, y) / np.bincount(at)


def selected_models(cells: DataFrame, keys: list[str], x: str, y: str, models: tuple[str, ...] = MODELS) -> DataFrame:
    """A row per keys and model with parameters, r2, log-likelihood and BIC of the fit to all cells (a row per bin and
    trial, or per bin), mean_r2 of the same curve against the mean of each x, and whether it is the best of its keys
    (greatest mean_r2). Keys with fewer than 4 known cells have none."""
    key_schema = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in keys)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=[x, y]).sort_values([x, y])
        out = []
        if len(rows) >= 4:
            a, b = rows[x].to_numpy(float), rows[y].to_numpy(float)
            places, means = _by_place(a, b)
            spread = float(((means - means.mean()) ** 2).sum())
            for m in models:
                p = _fit(m, a, b)
                sse = float(((b - _shape(m, p, a)) ** 2).sum())
                mean_r2 = 1 - float(((means - _shape(m, p, places)) ** 2).sum()) / spread if spread > 0 else math.nan
                out.append((*(rows[k].iloc[0] for k in keys), m, p.tolist(), mean_r2, *fit_statistics(sse, float(((b - b.mean()) ** 2).sum()), len(a), len(p))))
            best = max(range(len(out)), key=lambda i: (-1e9 if math.isnan(out[i][-4]) else round(out[i][-4], 12), -i))
            out = [(*r, i == best) for i, r in enumerate(out)]
        return pd.DataFrame(out, columns=[*keys, "model", "parameters", "mean_r2", "r2", "log_likelihood", "bic", "best"])

    return cells.groupBy(*keys).applyInPandas(one, f"{key_schema}, model string, parameters array<double>, mean_r2 double, r2 double, log_likelihood double, bic double, best boolean")


def asymmetric_fits(curve: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """The asymmetric Gaussian by keys with its root mean square error; of keys with four known bins or more."""
    fits = selected_models(curve, keys, x, y, ("asymmetric",)).drop("best", "model", "mean_r2")
    known = curve.dropna(subset=[x, y]).groupBy(*keys).agg(F.var_pop(y).alias("_var"))
    return fits.join(known, keys).withColumn("rmse", F.sqrt(F.greatest((1 - F.col("r2")) * F.col("_var"), F.lit(0.0)))).drop("_var")


def asymmetric_p(cells: DataFrame, keys: list[str], bin_: str, x: str, y: str, reps: int = 1000, blocks: int = 20, seed: int = 1) -> DataFrame:
    """The asymmetric Gaussian's fit to cells with rmse and p, the share of redrawn cells that it fits as well or better."""
    fits = selected_models(cells, keys, x, y, ("asymmetric",))
    return asymmetric_fits(cells, keys, x, y).join(model_p(cells, fits, keys, bin_, x, y, reps, blocks, seed), keys)


def model_p(cells: DataFrame, best: DataFrame, keys: list[str], bin_: str, x: str, y: str, reps: int = 1000, blocks: int = 20, seed: int = 1) -> DataFrame:
    """p of the best model: the share of redrawn cells, each value drawn from all of the key's, that it fits as well or
    better; repetitions spread over blocks, and a block's are fitted together."""
    key_schema = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in keys)
    spread = cells.join(best.filter("best").select(*keys, "model", "r2"), keys).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=[x, y]).sort_values([bin_, y])
        values, places, model, least = rows[y].to_numpy(float), rows[x].to_numpy(float), rows["model"].iloc[0], rows["r2"].iloc[0]
        rng, n = np.random.default_rng([seed, int(rows["block"].iloc[0])]), reps // blocks
        drawn = values[rng.integers(0, len(values), (n, len(values)))]
        total = ((drawn - drawn.mean(1, keepdims=True)) ** 2).sum(1)
        rest = _fit_rows(model, places, drawn)
        hits = int(((total > 0) & (1 - rest / np.where(total > 0, total, 1) >= least)).sum())
        return pd.DataFrame([(*(rows[k].iloc[0] for k in keys), hits, n)], columns=[*keys, "hits", "n"])

    parts = spread.groupBy(*keys, "block").applyInPandas(one, f"{key_schema}, hits long, n long")
    return parts.groupBy(*keys).agg((F.sum("hits") / F.sum("n")).alias("p"))


def tuned_classes(fits: DataFrame, rate: str, rest: str) -> DataFrame:
    """fits (p, slope, mean rate, resting rate) with `class`: untuned, or excited/suppressed with the slope's sign."""
    side = F.when(F.col(rate) > F.col(rest), "excited").otherwise("suppressed")
    slope = F.when(F.col("slope") > 0, "up").otherwise("down")
    return fits.withColumn("class", F.when(F.col("p") < 0.05, F.concat_ws("_", side, slope)).otherwise("untuned"))


def compared_conditions(fits: DataFrame, keys: list[str], least_r2: float = 0.65, apart: float = 0.5) -> DataFrame:
    """V against VT per keys: neither, V_only, VT_only, both_similar, both_different_params or both_different_model.

    fits: keys, condition, model, p, r2, parameters, a row per keys and condition. Parameters are apart by their greatest
    relative difference.
    """
    good = (F.col("p") < 0.05) & (F.col("r2") > least_r2)
    marked = fits.withColumn("_ok", good)
    take = lambda c, v: F.max(F.when(F.col("condition") == v, F.col(c)))
    one = lambda c, v: F.first(F.when(F.col("condition") == v, F.col(c)), ignorenulls=True)
    out = marked.groupBy(*keys).agg(*(take("_ok", v).alias(f"_ok{v}") for v in ("V", "VT")), *(take("model", v).alias(f"_m{v}") for v in ("V", "VT")), *(one("parameters", v).alias(f"_p{v}") for v in ("V", "VT")))
    far = F.array_max(F.zip_with("_pV", "_pVT", lambda a, b: F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-12))))
    v, vt = F.coalesce("_okV", F.lit(False)), F.coalesce("_okVT", F.lit(False))
    label = F.when(~v & ~vt, "neither").when(v & ~vt, "V_only").when(~v & vt, "VT_only").when(F.col("_mV") != F.col("_mVT"), "both_different_model").when(far > apart, "both_different_params").otherwise("both_similar")
    return out.select(*keys, label.alias("comparison"))


def population_curve(curves: DataFrame, by: list[str], value: str = "rate") -> DataFrame:
    """Mean and standard error over units by bin."""
    return curves.groupBy(*by, "bin").agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"), F.count(value).alias("n"))
