"""Encoding models: time bins, folds, Poisson regression per unit, selection of terms, predicted curves.

A unit's bins (some thousands) are one group; units and models spread over tasks. `fitted_in_steps` makes the same fits
where a unit's bins are too many for one task.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.operators.ordered import stored
from trialspark.operators.stats import joined, medians, one_tailed, signed_rank

CLAMP, LEAST_GAIN, FOLDS, CAP_HZ = 20.0, 0.005, 5, 400.0


def category(tests: DataFrame, keys: list[str]) -> DataFrame:
    """The prefilter: from whether T, V and VT differ from rest (tests: keys, condition, p) a category and whether to fit."""
    wide = tests.groupBy(*keys).pivot("condition", ["T", "V", "VT"]).agg(F.min("p"))
    t, v, vt = (F.coalesce(F.col(c) < 0.05, F.lit(False)) for c in ("T", "V", "VT"))
    label = F.when(t & v, "T_and_V").when(t, "T_only").when(v, "V_only").when(vt, "VT_only").otherwise("none")
    return wide.select(*keys, label.alias("category"), (t | v | vt).alias("fit"))


def time_bins(samples: DataFrame, onsets: DataFrame, spikes: DataFrame, keys: list[str], trial: str, unit: str, width: float = 0.1) -> DataFrame:
    """Bins of a trial from its motion onset with at least half their samples in motion: mean speed and spikes per unit.

    samples: keys, trial, t, speed, moving; onsets: keys, trial, onset; spikes: keys, trial, unit, t.
    """
    number = F.floor((F.col("t") - F.col("onset")) / width).cast("int")
    by = samples.join(onsets, [*keys, trial]).filter("t >= onset").groupBy(*keys, trial, number.alias("bin"))
    bins = by.agg(F.avg("speed").alias("speed"), F.avg(F.col("moving").cast("double")).alias("_share")).filter("_share >= 0.5").drop("_share")
    fired = spikes.join(onsets, [*keys, trial]).filter("t >= onset").groupBy(*keys, trial, unit, number.alias("bin")).agg(F.count("*").alias("spike_count"))
    every = bins.join(spikes.select(*keys, unit).distinct(), keys)
    out = every.join(fired, [*keys, trial, unit, "bin"], "left").withColumn("spike_count", F.coalesce("spike_count", F.lit(0)))
    return out.withColumn("time_since_onset", (F.col("bin") + 0.5) * width)


def folds(rows: DataFrame, keys: list[str], trial: str, condition: str, n: int = FOLDS, seed: int = 1, by_trial: bool = False) -> DataFrame:
    """rows with `fold`: trials of a condition dealt in turn, in the order of a hash. by_trial: one fold for all of a
    trial's conditions."""
    unit = [trial] if by_trial else [trial, condition]
    within = [*keys] if by_trial else [*keys, condition]
    w = Window.partitionBy(*within).orderBy(mixed_number(F.col(trial), seed), trial)
    dealt = rows.select(*keys, *unit).distinct().withColumn("fold", ((F.row_number().over(w) - 1) % n).cast("int"))
    return rows.join(dealt, [*keys, *unit])


def mixed_number(x: Column, seed: int = 1) -> Column:
    """A pseudo-random order of integers that any engine can repeat."""
    prime = 2_147_483_647
    a = (x.cast("long") % prime * 48_271 + 16_807 * seed) % prime
    return a * 39_373 % prime


class Fit:
    """A ridge Poisson regression by iteratively reweighted least squares."""

    def __init__(self, x: np.ndarray, y: np.ndarray, offset: np.ndarray, ridge: float = 1e-3, steps: int = 60):
        n, k = x.shape
        penalty = np.full(k, ridge)
        penalty[0] = 0  # the intercept
        beta = np.zeros(k)
        beta[0] = math.log((y.sum() + 0.1) / np.exp(offset).sum())
        for _ in range(steps):
            eta = np.clip(x @ beta + offset, -CLAMP, CLAMP)
            mu = np.exp(eta)
            information = x.T @ (x * mu[:, None]) + np.diag(penalty) + 1e-9 * np.eye(k)
            new = np.linalg.solve(information, x.T @ (mu * (eta - offset) + y - mu))
            done = np.abs(new - beta).max() < 1e-8
            beta = new
            if done:
                break
        mu = np.exp(np.clip(x @ beta + offset, -CLAMP, CLAMP))
        self.beta, self.se = beta, np.sqrt(np.diag(np.linalg.inv(information)))
        self.log_likelihood = log_likelihood(y, mu)
        self.aic, self.bic = 2 * k - 2 * self.log_likelihood, k * math.log(max(n, 1)) - 2 * self.log_likelihood
        self.deviance = float(2 * (np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0) - (y - mu)).sum())
        self.dispersion = float(((y - mu) ** 2 / mu).sum() / max(1, n - k))


def log_likelihood(y: np.ndarray, mu: np.ndarray) -> float:
    return float((y * np.log(np.maximum(mu, 1e-300)) - mu - np.array([math.lgamma(v + 1) for v in y])).sum())


def _matrix(rows: pd.DataFrame, terms: list[str]) -> np.ndarray:
    blocks = [np.ones((len(rows), 1))]
    for t in terms:
        first = rows[t].iloc[0]
        blocks.append(np.stack(rows[t].to_numpy()) if isinstance(first, (list, np.ndarray)) else rows[[t]].to_numpy(float))
    return np.concatenate(blocks, 1)


def _held_out(rows: pd.DataFrame, terms: list[str], ridge: float) -> tuple[float, np.ndarray]:
    """Log-likelihood per spike in bits of each fold under the others' fit, and the predicted counts."""
    x, y, o, f = _matrix(rows, terms), rows["spike_count"].to_numpy(float), np.log(rows["dt"].to_numpy(float)), rows["fold"].to_numpy()
    mu = np.zeros(len(y))
    for k in np.unique(f):
        train = f != k
        if train.any():
            mu[~train] = np.exp(np.clip(x[~train] @ Fit(x[train], y[train], o[train], ridge).beta + o[~train], -CLAMP, CLAMP))
    return log_likelihood(y, np.maximum(mu, 1e-300)) / max(1.0, y.sum()) / math.log(2), mu


def _groups(bins: DataFrame, keys: list[str], order: list[str], work, schema: str) -> DataFrame:
    key_schema = ", ".join(f"{k} {bins.schema[k].dataType.simpleString()}" for k in keys)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order).reset_index(drop=True)
        head = {k: rows[k].iloc[0] for k in keys}
        found = work(rows)
        return pd.DataFrame([{**head, **r} for r in found], columns=[*keys, *(c.strip().split()[0] for c in schema.split(", "))])

    return bins.groupBy(*keys).applyInPandas(one, f"{key_schema}, {schema}")


def fitted(bins: DataFrame, keys: list[str], order: list[str], models: dict[str, list[str]], ridge: float = 1e-3) -> DataFrame:
    """Fits of models (name: columns, numbers or arrays) to spike_count, dt and fold, by keys, with held-out bits per spike."""

    def work(rows):
        for name, terms in models.items():
            fit = Fit(_matrix(rows, terms), rows["spike_count"].to_numpy(float), np.log(rows["dt"].to_numpy(float)), ridge)
            score, _ = _held_out(rows, terms, ridge)
            yield {"model": name, "beta": fit.beta.tolist(), "se": fit.se.tolist(), "log_likelihood": fit.log_likelihood, "aic": fit.aic, "bic": fit.bic, "deviance": fit.deviance, "dispersion": fit.dispersion, "cv_bits": score}

    schema = "model string, beta array<double>, se array<double>, log_likelihood double, aic double, bic double, deviance double, dispersion double, cv_bits double"
    return _groups(bins, keys, order, work, schema)


def _pooled(batches, keys: list[str], fold, width: int, flush: int = 256):
    """Sums of fold(rows) over all rows of a key that a task holds, a row a key; `flush` keys are held at once."""
    held: dict = {}

    def told():
        values = pa.array([list(v) for v in held.values()], pa.list_(pa.float64()))
        columns = [pa.array([k[i] for k in held], t) for i, t in enumerate(types)]
        return pa.RecordBatch.from_arrays([*columns, values], [*keys, "sums"])

    for batch in batches:
        types = [batch.schema.field(k).type for k in keys]
        rows = batch.to_pandas()
        for key, some in rows.groupby(keys, sort=False, dropna=False):
            key = tuple(None if isinstance(k, float) and math.isnan(k) else k for k in key)
            held[key] = held.get(key, np.zeros(width)) + fold(some)
        if len(held) >= flush:
            yield told()
            held = {}
    if held:
        yield told()


def _design(terms: list[str], bins: DataFrame):
    """The array of a row's regressors, the intercept first."""
    parts = [F.col(t).cast("array<double>") if bins.schema[t].dataType.typeName() == "array" else F.array(F.col(t).cast("double")) for t in terms]
    return F.concat(F.array(F.lit(1.0)), *parts)


def _rates(some: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x, y, offset = np.stack(some["_x"].to_numpy()), some["_y"].to_numpy(float), some["_o"].to_numpy(float)
    eta = np.clip(np.einsum("ij,ij->i", x, np.stack(some["_beta"].to_numpy())) + offset, -CLAMP, CLAMP)
    return x, y, eta, np.exp(eta)


def newton_steps(rows: DataFrame, keys: list[str], k: int, ridge: float = 1e-3, steps: int = 60, tolerance: float = 1e-8) -> DataFrame:
    """(keys, beta, se) of ridge Poisson regressions of rows (keys, _x of k entries, _y, _o the log of time), by steps over
    all keys at once.

    A step sums X'WX and X'Wz per key within tasks, adds the tasks' sums and solves; so a key may have any number of rows,
    and what is shuffled is k * k numbers a key and task. Between steps the coefficients are a small stored table.
    """
    key_schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)

    def fold(some):
        x, y, eta, mu = _rates(some)
        return np.r_[(x.T @ (x * mu[:, None])).ravel(), x.T @ (mu * (eta - some["_o"].to_numpy(float)) + y - mu)]

    def solve(parts: pd.DataFrame) -> pd.DataFrame:
        sums = np.sum(np.stack(parts["sums"].to_numpy()), 0)
        penalty = np.r_[0.0, np.full(k - 1, ridge)]
        information = sums[: k * k].reshape(k, k) + np.diag(penalty) + 1e-9 * np.eye(k)
        beta = np.linalg.solve(information, sums[k * k :])
        return pd.DataFrame([(*(parts[c].iloc[0] for c in keys), beta, np.sqrt(np.diag(np.linalg.inv(information))))], columns=[*keys, "beta", "se"])

    start = F.log((F.sum("_y") + 0.1) / F.sum(F.exp("_o")))
    state = rows.groupBy(*keys).agg(F.concat(F.array(start), F.array_repeat(F.lit(0.0), k - 1)).alias("beta"))
    state = stored(state.withColumn("se", F.lit(None).cast("array<double>")))
    for _ in range(steps):
        told = joined(rows, state.select(*keys, F.col("beta").alias("_beta")), keys)
        sums = told.mapInArrow(lambda b: _pooled(b, keys, fold, k * k + k), f"{key_schema}, sums array<double>")
        new = stored(sums.groupBy(*keys).applyInPandas(solve, f"{key_schema}, beta array<double>, se array<double>"))
        change = F.array_max(F.zip_with("beta", "_old", lambda a, b: F.abs(a - b)))
        moved = joined(new, state.select(*keys, F.col("beta").alias("_old")), keys).agg(F.max(change)).first()[0]
        state = new
        if moved is None or moved < tolerance:
            break
    return state


def fitted_in_steps(bins: DataFrame, keys: list[str], models: dict[str, list[str]], ridge: float = 1e-3) -> DataFrame:
    """As `fitted`, by steps over the whole table: a unit's rows needn't fit one task. Full fits and those without a fold
    are all made at once, as units of their own."""
    out = None
    for name, terms in models.items():
        rows = bins.select(*keys, F.col("fold").cast("int").alias("_fold"), _design(terms, bins).alias("_x"), F.col("spike_count").cast("double").alias("_y"), F.log(F.col("dt").cast("double")).alias("_o"))
        rows = stored(rows)
        first = rows.select(F.size("_x")).first()
        k = first[0] if first else len(terms) + 1
        folds = rows.select(*keys, F.col("_fold").alias("_held")).distinct()
        theirs = folds.withColumnsRenamed({c: f"_k_{c}" for c in keys})
        match = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys), F.col("_fold") != F.col("_held"))
        training = rows.join(theirs, match).select(*keys, "_held", "_x", "_y", "_o").unionByName(rows.select(*keys, F.lit(-1).alias("_held"), "_x", "_y", "_o"))
        fits = newton_steps(training, [*keys, "_held"], k, ridge)
        full = fits.filter("_held = -1").drop("_held")

        def score(some):
            _, y, _, mu = _rates(some)
            deviance = 2 * (np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0) - (y - mu)).sum()
            return np.array([len(y), y.sum(), log_likelihood(y, mu), deviance, ((y - mu) ** 2 / mu).sum()])

        def held_score(some):
            told = some["_beta"].notna().to_numpy()
            mu = np.full(len(some), 1e-300)
            if told.any():
                mu[told] = np.maximum(_rates(some[told])[3], 1e-300)
            return np.array([log_likelihood(some["_y"].to_numpy(float), mu)])

        key_schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)
        total = lambda i: F.sum(F.col("sums")[i])
        sums = joined(rows, full.select(*keys, F.col("beta").alias("_beta")), keys).mapInArrow(lambda b, f=score: _pooled(b, keys, f, 5), f"{key_schema}, sums array<double>")
        sums = sums.groupBy(*keys).agg(*(total(i).alias(n) for i, n in enumerate(("_n", "_spikes", "log_likelihood", "deviance", "_pearson"))))
        others = fits.filter("_held >= 0").select(*keys, F.col("_held").alias("_fold"), F.col("beta").alias("_beta"))
        held = joined(rows, others, [*keys, "_fold"]).mapInArrow(lambda b, f=held_score: _pooled(b, keys, f, 1), f"{key_schema}, sums array<double>")
        held = held.groupBy(*keys).agg(total(0).alias("_held_ll"))
        told = joined(joined(full, sums, keys), held, keys)
        ll = F.col("log_likelihood")
        told = told.select(
            *keys, F.lit(name).alias("model"), "beta", "se", "log_likelihood", (2 * k - 2 * ll).alias("aic"), (k * F.log(F.greatest("_n", F.lit(1.0))) - 2 * ll).alias("bic"), "deviance",
            (F.col("_pearson") / F.greatest(F.col("_n") - k, F.lit(1.0))).alias("dispersion"), (F.col("_held_ll") / F.greatest("_spikes", F.lit(1.0)) / math.log(2)).alias("cv_bits"),
        )
        out = told if out is None else out.unionByName(told)
    return out


def forward_selected(bins: DataFrame, keys: list[str], order: list[str], mains: list[str], interactions: dict[str, tuple[str, str]], least: float = LEAST_GAIN, ridge: float = 1e-3) -> DataFrame:
    """Terms added one by one while the best adds more than `least` held-out bits per spike: first main effects, then
    interactions (name: its two main effects) of chosen ones. A row per step."""

    def work(rows):
        chosen: list[str] = []
        score, _ = _held_out(rows, chosen, ridge)
        yield {"step": 0, "term": None, "cv_bits": score, "gain": 0.0}
        step = 0
        for stage in (mains, list(interactions)):
            left = [t for t in stage if t not in interactions or all(p in chosen for p in interactions[t])]
            while left:
                best, term = max((_held_out(rows, [*chosen, t], ridge)[0], t) for t in left)
                if best - score <= least:
                    break
                step += 1
                yield {"step": step, "term": term, "cv_bits": best, "gain": best - score}
                chosen.append(term)
                left.remove(term)
                score = best

    return _groups(bins, keys, order, lambda rows: list(work(rows)), "step int, term string, cv_bits double, gain double")


def held_out_predictions(bins: DataFrame, keys: list[str], order: list[str], terms: list[str], ridge: float = 1e-3) -> DataFrame:
    """Observed and held-out predicted rates of every bin (order columns are returned)."""
    kinds = ", ".join(f"{c} {bins.schema[c].dataType.simpleString()}" for c in order)

    def work(rows):
        _, mu = _held_out(rows, terms, ridge)
        dt = rows["dt"].to_numpy(float)
        return [{**{c: r[c] for c in order}, "observed": r["spike_count"] / d, "predicted": m / d} for (_, r), m, d in zip(rows.iterrows(), mu, dt, strict=True)]

    return _groups(bins, keys, order, work, f"{kinds}, observed double, predicted double")


def profile_generalisation(bins: DataFrame, keys: list[str], trial: str) -> DataFrame:
    """bins with fold 0 for trials up to the middle one of their keys and 1 for later ones."""
    middle = (F.min(trial).over(Window.partitionBy(*keys)) + F.max(trial).over(Window.partitionBy(*keys))) / 2
    return bins.withColumn("fold", (F.col(trial) > middle).cast("int"))


def observed_predicted(predictions: DataFrame, keys: list[str], bin_: str) -> DataFrame:
    """Correlation and r2 over bins of the mean observed and predicted rates."""
    means = predictions.groupBy(*keys, bin_).agg(F.avg("observed").alias("o"), F.avg("predicted").alias("p"))
    return means.groupBy(*keys).agg(F.corr("o", "p").alias("r"), F.regr_r2("o", "p").alias("r2"), F.count("*").alias("n_bins"))


def model_curve(fits: DataFrame, keys: list[str], basis: Column, grid: list[float], first: int = 1) -> DataFrame:
    """Rates (Hz, at most 400) of a fitted model over a grid of x: the intercept and `basis` (an array of x's values,
    its weights from beta's place `first` on)."""
    points = fits.withColumn("x", F.explode(F.array(*map(F.lit, map(float, grid))))).withColumn("_b", basis)
    dot = F.aggregate(F.zip_with("_b", F.slice("beta", first + 1, F.size("_b")), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return points.select(*keys, "model", "x", F.least(F.lit(CAP_HZ), F.exp(F.get("beta", F.lit(0)) + dot)).alias("rate"))


def compared_models(bins: DataFrame, keys: list[str], order: list[str], mains: list[str], interactions: dict[str, tuple[str, str]], least: float = LEAST_GAIN, ridge: float = 1e-3) -> DataFrame:
    """(keys, model, cv_bits) of four models: Null (none of the terms), Selected (those that forward selection takes),
    Additive (all main effects) and FullInteraction (all main effects and interactions)."""
    whole = {"Null": [], "Additive": mains, "FullInteraction": [*mains, *interactions]}
    fits = fitted(bins, keys, order, whole, ridge).select(*keys, "model", "cv_bits")
    steps = forward_selected(bins, keys, order, mains, interactions, least, ridge)
    chosen = steps.groupBy(*keys).agg(F.max_by("cv_bits", "step").alias("cv_bits"))
    return fits.unionByName(chosen.withColumn("model", F.lit("Selected")))


def generalised(scores: DataFrame, keys: list[str], standard: str, profile: str, p_values: bool = True) -> DataFrame:
    """How well models generalise across speed profiles, by keys, over units: the median gain under trial folds and under
    profile folds, what share of the first the second retains (median over units that gain under trial folds), and a
    one-tailed signed-rank test that profile gains are above 0."""
    ratio = F.when(F.col(standard) > 0, F.col(profile) / F.col(standard))
    told = medians(scores.withColumn("_ratio", ratio), keys, standard=standard, profile=profile, retained="_ratio")
    tests = signed_rank(scores.withColumn("_none", F.when(F.col(profile).isNotNull(), 0.0)), keys, profile, "_none", p_values=p_values)
    tests = one_tailed(tests) if p_values else tests
    return joined(told, tests.select(*keys, "n", "w_plus", "w_minus", *(["p_greater"] if p_values else [])), keys)


def model_deltas(fits: DataFrame, keys: list[str], score: str = "cv_bits", base: str = "Null") -> DataFrame:
    """Per unit the score of each fitted model less that of the base model, a column delta_<model> for each."""
    names = [r[0] for r in fits.select("model").distinct().orderBy("model").collect() if r[0] != base]  # a handful of models
    take = lambda m: F.max(F.when(F.col("model") == m, F.col(score)))
    return fits.groupBy(*keys).agg(*((take(m) - take(base)).alias(f"delta_{m}") for m in names))


def compared_predictions(predictions: DataFrame, keys: list[str], bin_: str, models: tuple[str, str] = ("Selected", "Additive")) -> DataFrame:
    """Correlation and r2 of two models' predicted tuning with the observed one, side by side (predictions: keys, model, bin, observed, predicted)."""
    each = observed_predicted(predictions.filter(F.col("model").isin(*models)), [*keys, "model"], bin_)
    take = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c))).alias(f"{m}_{c}")
    return each.groupBy(*keys).agg(*(take(m, c) for m in models for c in ("r", "r2")))


def categories(classified: DataFrame, by: list[str]) -> DataFrame:
    """How many units are in each category, and their share of all, by columns (a group, a spiking class)."""
    n = classified.groupBy(*by, "category").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def tuning_facts(curves: DataFrame, stimuli: DataFrame, keys: list[str]) -> DataFrame:
    """Tuning by bin beside the stimulus's attributes (stimuli: keys, sf, orientation, gain), speed as tf where there is a gain."""
    return curves.join(stimuli, keys, "left").withColumn("tf", F.col("center") * F.col("gain"))


def trial_rates(predictions: DataFrame, keys: list[str], trial: str) -> DataFrame:
    """Mean observed and predicted rate of every trial."""
    return predictions.groupBy(*keys, trial).agg(F.avg("observed").alias("observed"), F.avg("predicted").alias("predicted"), F.count("*").alias("n_bins"))


def best_units(scores: DataFrame, selection: DataFrame, keys: list[str], by: list[str], score: str = "cv_bits", least_terms: int = 2, most: int = 4) -> DataFrame:
    """The `most` units of each group with the greatest score among those that encode least_terms variables or more."""
    many = selection.filter("term IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n_terms")).filter(F.col("n_terms") >= least_terms)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), *keys))
    return scores.join(many, keys).withColumn("place", place).filter(F.col("place") <= most)


def save_results(tables: dict[str, DataFrame], path: str, overwrite: bool = False) -> None:
    """Coefficients, comparisons, selection history and bins, each as a CSV below path."""
    from trialspark.sources.writers import save_csv

    for name, table in tables.items():
        save_csv(table, f"{path.rstrip('/')}/{name}", overwrite=overwrite)


def encoded_counts(selection: DataFrame, keys: list[str]) -> DataFrame:
    """How many units encode each variable, of all."""
    total = F.count_distinct(F.struct(*keys))
    chosen = selection.filter("term IS NOT NULL").groupBy("term").agg(total.alias("n_units"))
    return chosen.orderBy(F.desc("n_units"), "term")


def grouped_parameters(coefficients: DataFrame, pattern: str = r"^([a-z_]+)") -> DataFrame:
    """Mean and standard error of coefficients (name, value) by the label in front of their names."""
    by = coefficients.groupBy(F.regexp_extract("name", pattern, 1).alias("label"))
    return by.agg(F.avg("value").alias("mean"), (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("sem"), F.count("value").alias("n"))
