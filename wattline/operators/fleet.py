"""Coupling between units, reserves, forecasts with ablations, virtual sensors, injected faults, segments.

Matrices of units by units come from grouped aggregates of the long panel; linear algebra on them is the
driver's, behind a check of the number of units.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline import constants as C
from wattline.functions import scalars as S
from wattline.operators import evaluate as E
from wattline.operators.panel import diff, lag
from wattline.operators.ranked import quantile_row, quantiles_by
from wattline.scratch import keep

MOST_UNITS = 2000


def unit_names(df: DataFrame) -> list[str] | None:
    """The units in order; None if they are more than a matrix on the driver may have."""
    names = sorted(r.unit for r in df.select("unit").distinct().limit(MOST_UNITS + 1).collect())
    return names if len(names) <= MOST_UNITS else None


def _block_steps(units: int) -> int:
    """Steps that one dense block of all units holds: about a million readings."""
    return max(16, (1 << 20) // max(1, units))


def cross_sums(df: DataFrame, x: str, names: Sequence[str], part: Column | None = None) -> DataFrame:
    """Sums over the steps that two units share, for each pair i <= j of places in `names`: part, i, j, n, sx, sy, sxx, syy, sxy.

    Steps are cut into blocks; a block becomes a matrix whose products give all its pairs at once, so what moves is one
    row per pair and block and not one per pair and step."""
    block, place = _block_steps(len(names)), {u: k for k, u in enumerate(names)}
    rows = df.select("unit", F.col("step").cast("long").alias("step"), F.col(x).cast("double").alias("x"), (F.lit(0) if part is None else part.cast("int")).alias("part")).where("x IS NOT NULL")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        steps, at = np.unique(pdf["step"].to_numpy(), return_inverse=True)
        there, values = np.zeros((len(steps), len(names))), np.zeros((len(steps), len(names)))
        unit = pdf["unit"].map(place).to_numpy()
        there[at, unit], values[at, unit] = 1.0, pdf["x"].to_numpy()
        i, j = np.triu_indices(len(names))
        pick = lambda m: m[i, j]
        out = pd.DataFrame({
            "part": int(pdf["part"].iloc[0]), "i": i, "j": j, "n": pick(there.T @ there), "sx": pick(values.T @ there), "sy": pick(there.T @ values),
            "sxx": pick((values**2).T @ there), "syy": pick(there.T @ values**2), "sxy": pick(values.T @ values),
        })
        return out[out["n"] > 0]

    blocks = rows.groupBy("part", F.floor(F.col("step") / block).alias("_block")).applyInPandas(run, "part int, i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
    return blocks.groupBy("part", "i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")))


def pairwise_corr(df: DataFrame, x: str) -> DataFrame:
    """Correlation of each pair a < b over their common steps. More units than a block may have are joined by step."""
    names = unit_names(df)
    if names is None:
        a = df.select("step", F.col("unit").alias("a"), F.col(x).alias("x"))
        pairs = a.join(df.select("step", F.col("unit").alias("b"), F.col(x).alias("y")), "step").where("a < b")
        return pairs.groupBy("a", "b").agg(F.corr("x", "y").alias("corr"))
    name = lambda c: F.element_at(F.array(*map(F.lit, names)), F.col(c) + 1)
    spread = lambda s, ss: F.greatest(F.col("n") * F.col(ss) - F.col(s) * F.col(s), F.lit(0.0))
    corr = S.ratio(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.sqrt(spread("sx", "sxx")) * F.sqrt(spread("sy", "syy")))
    return cross_sums(df, x, names).where("i < j").select(name("i").alias("a"), name("j").alias("b"), corr.alias("corr"))


def increments(df: DataFrame, x: str, k: int = 1) -> DataFrame:
    return df.select("unit", "step", diff(x, k).alias(x)).where(F.col(x).isNotNull())


def effective_units(df: DataFrame, x: str) -> DataFrame:
    """n units, their participation ratio and mean pair correlation. The eigenvalues of a correlation
    matrix sum to n and their squares to its squared entries, so no decomposition is needed."""
    n = df.agg(F.count_distinct("unit").cast("double").alias("n_units"))
    pairs = pairwise_corr(df, x).agg(F.sum(F.col("corr") * F.col("corr")).alias("sq"), F.avg("corr").alias("mean_corr"))
    return n.join(F.broadcast(pairs)).select("n_units", (F.col("n_units") * F.col("n_units") / (F.col("n_units") + 2 * F.col("sq"))).alias("n_eff"), "mean_corr")


def spectrum(df: DataFrame, x: str) -> np.ndarray:
    """Eigenvalues of the correlation matrix, largest first."""
    names = unit_names(df) or _too_many()
    found = pairwise_corr(df, x).toArrow()
    place, m = {u: i for i, u in enumerate(names)}, np.eye(len(names))
    i, j = ([place[u] for u in found.column(c).to_pylist()] for c in ("a", "b"))
    m[i, j] = m[j, i] = np.nan_to_num(found.column("corr").to_numpy())
    return np.clip(np.sort(np.linalg.eigvalsh(m))[::-1], 0, None)


def components_for(values: np.ndarray, share: float = 0.9) -> tuple[float, int]:
    """Share of the first component, and how many explain `share` of the variance."""
    cum = np.cumsum(values) / values.sum()
    return float(cum[0]), int(np.searchsorted(cum, share) + 1)


def _too_many():
    raise ValueError(f"more than {MOST_UNITS} units: their matrix does not belong on the driver")


def fleet_mean(df: DataFrame, x: str) -> DataFrame:
    return df.groupBy("step").agg(F.avg(x).alias(x))


def diversity_factor(df: DataFrame, x: str) -> DataFrame:
    """Peak of the fleet's mean over the mean of the units' peaks."""
    peaks = df.groupBy("unit").agg(F.max(x).alias("m")).agg(F.avg("m").alias("units"))
    return fleet_mean(df, x).agg(F.max(x).alias("fleet")).join(F.broadcast(peaks)).select(S.ratio("fleet", "units").alias("diversity_factor"))


def reserve_inflation(df: DataFrame, x: str, k: int) -> DataFrame:
    """Deviation of the fleet's ramps against what independent units would give, and ramp percentiles."""
    d = increments(df, x, k)
    mean = fleet_mean(d, x)
    fleet = mean.agg(F.stddev_samp(x).alias("act")).join(F.broadcast(quantile_row(mean, x, {"fleet_p999": 0.999})))
    units = d.groupBy("unit").agg(F.var_samp(x).alias("v")).agg(F.sqrt(F.sum("v")).alias("s"), F.count(F.lit(1)).alias("n"))
    top = quantiles_by(d, ["unit"], x, {"q": 0.999}).agg(F.avg("q").alias("unit_p999"))
    return fleet.join(F.broadcast(units)).join(F.broadcast(top)).select((F.col("act") / (F.col("s") / F.col("n"))).alias("reserve_inflation"), F.col("act").alias("fleet_ramp_sd"), "unit_p999", "fleet_p999")


def share_up(df: DataFrame, x: str, top: float = 0.99) -> DataFrame:
    """Share of units that rise when the fleet's mean makes a top move, and always."""
    steps = increments(df, x).groupBy("step").agg(F.avg(x).alias("d"), F.avg((F.col(x) > 0).cast("double")).alias("up"))
    cut = quantile_row(steps, "d", {"cut": top})
    return steps.join(F.broadcast(cut)).agg(F.avg(F.when(F.col("d") >= F.col("cut"), F.col("up"))).alias("share_up_on_ramp"), F.avg("up").alias("share_up"))


def engine_conversion(df: DataFrame, x: str, horizons: Sequence[int] = C.FLEET_HORIZONS, per_day: int = C.DAY, site_mw: float = C.SITE_MW, engine_mw: float = C.ENGINE_MW) -> DataFrame:
    """Site ramps in megawatts and engines, and how often non-overlapping windows exceed one or two engines, a row for each
    horizon. One row per step reaches the ordered window, once for all horizons."""
    w = Window.partitionBy("g").orderBy("step")
    site = fleet_mean(df, x).withColumn("g", F.lit(1)).withColumns({f"_{k}": F.col(x) - F.lag(x, k).over(w) for k in horizons})
    ramps = site.select("step", F.explode(F.array(*(F.struct(F.lit(k).alias("h"), (F.col(f"_{k}") * site_mw).alias("mw")) for k in horizons))).alias("r")).select("step", "r.*").where("mw IS NOT NULL")
    block = F.col("step") % F.col("h") == 0
    many = lambda e: F.sum(F.when(block & (F.col("mw") >= e * engine_mw), 1).otherwise(0)) / (F.sum(F.when(block, 1).otherwise(0)) * F.col("h") / per_day)
    sums = ramps.groupBy("h").agg(F.stddev_samp("mw").alias("sd_mw"), F.max("mw").alias("max_mw"), (F.max("mw") / engine_mw).alias("max_engines"), many(1).alias("one_per_day"), (many(2) * 7).alias("two_per_week"))
    return E.joined_on(sums, quantiles_by(ramps.where("mw > 0"), ["h"], "mw", {"p99_mw": 0.99, "p999_mw": 0.999}), ["h"])


def with_target(features: DataFrame, h: int, target: str = "u") -> DataFrame:
    """y: the target h steps ahead; rows without it or with a null feature are dropped."""
    return features.withColumn("y", lag(target, -h)).na.drop()


def _ridge(x: np.ndarray, dy: np.ndarray, tr: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Closed-form ridge on features scaled by the training rows: fitted values of all rows."""
    mean, sd = x[tr].mean(axis=0), x[tr].std(axis=0)
    z = (x - mean) / np.where(sd > 0, sd, 1.0)
    beta = np.linalg.solve(z[tr].T @ z[tr] + alpha * np.eye(z.shape[1]), z[tr].T @ (dy[tr] - dy[tr].mean()))
    return dy[tr].mean() + z @ beta


def _boost(x: np.ndarray, dy: np.ndarray, tr: np.ndarray, rounds: int = 60, rate: float = 0.1, bins: int = 32, least: int = 20) -> np.ndarray:
    """Boosted trees of depth 2: fitted values of all rows."""
    cuts = [np.unique(np.quantile(x[tr, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    place = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    guess = np.full(len(dy), dy[tr].mean())

    width, many = max(map(len, cuts), default=0) + 1, x.shape[1]
    cell = place + width * np.arange(many)  # one histogram holds the bins of all features
    is_cut = np.arange(width - 1) < np.array([len(c) for c in cuts])[:, None]

    def best(rows: np.ndarray, r: np.ndarray) -> tuple[int, int] | None:
        if width < 2:
            return None
        own, at = r[rows], cell[rows].ravel()
        n = np.cumsum(np.bincount(at, minlength=many * width).reshape(many, width), axis=1)[:, :-1]
        s = np.cumsum(np.bincount(at, np.repeat(own, many), many * width).reshape(many, width), axis=1)[:, :-1]
        total, size = own.sum(), len(own)
        gain = np.where(is_cut & (n >= least) & (size - n >= least), s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(size - n, 1), 0.0)
        top = int(gain.argmax())  # of equals the first feature's first cut
        return divmod(top, width - 1) if gain.flat[top] > 0 else None

    for _ in range(rounds):
        r, leaves = dy - guess, []
        root = best(tr, r)
        if root is None:
            break
        for side in (place[:, root[0]] <= root[1], place[:, root[0]] > root[1]):
            inner = best(side & tr, r)
            leaves += [side] if inner is None else [side & (place[:, inner[0]] <= inner[1]), side & (place[:, inner[0]] > inner[1])]
        for leaf in leaves:
            if (leaf & tr).any():
                guess = guess + rate * r[leaf & tr].mean() * leaf
    return guess


FITS = {"ridge": _ridge, "boost": _boost}


def leads(features: DataFrame, horizons: Sequence[int], *columns: str) -> DataFrame:
    """unit, step, `columns`, h and y, the level h steps ahead: a row for each lead that has one."""
    ahead = F.array(*(F.struct(F.lit(h).alias("h"), lag("u", -h).alias("y")) for h in horizons))
    kept = ["unit", "step", *columns]
    return features.select(*kept, ahead.alias("_ahead")).select(*kept, F.explode("_ahead").alias("_a")).select(*kept, "_a.*").where("y IS NOT NULL")


def ablation_forecasts(features: DataFrame, models: dict[str, tuple[str, Sequence[str]]], horizons: Sequence[int], split: int) -> DataFrame:
    """Forecasts of the test rows by several models at several leads, one fit for each unit, model and lead, a task's work
    being a unit and lead of one feature frame: h, model, unit, step, y, u, pred. models: name -> (ridge, boost or persistence, columns).
    Units without training rows forecast no change."""
    columns = list(dict.fromkeys(["u", *(c for _, cs in models.values() for c in cs)]))
    d = leads(features, horizons, *columns).na.drop(subset=columns)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, parts = pdf.sort_values("step"), []
        tr, y, u = (x["step"] < split).to_numpy(), x["y"].to_numpy(float), x["u"].to_numpy(float)
        for name, (kind, cs) in models.items():
            dy = np.zeros(len(y)) if kind == "persistence" or not tr.any() else FITS[kind](x[list(cs)].to_numpy(float), y - u, tr)
            parts.append(pd.DataFrame({"h": x["h"], "model": name, "unit": x["unit"], "step": x["step"], "y": y, "u": u, "pred": u + dy})[~tr])
        return pd.concat(parts)

    return d.groupBy("unit", "h").applyInPandas(run, "h int, model string, unit string, step long, y double, u double, pred double")


def skill_table(fc: DataFrame, base: str = "persistence") -> DataFrame:
    """Errors for each lead and model of ablation_forecasts(), and the share of the base model's mean error that is saved."""
    e = E.errors(fc, "y", "pred", ["h", "model"])
    ref = e.where(F.col("model") == base).select("h", F.col("mae").alias("_base"))
    return e.join(F.broadcast(ref), "h").withColumn("skill", 1 - S.ratio("mae", "_base")).drop("_base")


def ridge_per_unit(features: DataFrame, columns: Sequence[str], h: int, split: int) -> DataFrame:
    """Ridge of the increment, one fit per unit; test rows: unit, step, y, u, pred."""
    return ablation_forecasts(features, {"ridge": ("ridge", columns)}, (h,), split).drop("h", "model")


def gbt_forecast(features: DataFrame, columns: Sequence[str], h: int, split: int, trees: int = 20, depth: int = 4, seed: int = 0) -> tuple[DataFrame, list[tuple[str, float]]]:
    """One boosted model of the increment over all units (distributed learner): test predictions, importances."""
    d = VectorAssembler(inputCols=list(columns), outputCol="x").transform(with_target(features, h)).withColumn("dy", F.col("y") - F.col("u"))
    model = GBTRegressor(featuresCol="x", labelCol="dy", maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed).fit(d.where(F.col("step") < split))
    test = model.transform(d.where(F.col("step") >= split)).select("unit", "step", "y", "u", (F.col("u") + F.col("prediction")).alias("pred"))
    return test, sorted(zip(columns, model.featureImportances.toArray().tolist(), strict=True), key=lambda t: -t[1])


def ramp_thresholds(features: DataFrame, horizons: Sequence[int], split: int, q: float = 0.99) -> DataFrame:
    """h, threshold: the training half's quantile of rises within each lead, over all units."""
    rises = leads(features, horizons, "u").where(F.col("step") < split).select("h", (F.col("y") - F.col("u")).alias("rise"))
    return quantiles_by(rises, ["h"], "rise", {"threshold": q})


def ramp_scores(pred: DataFrame, features: DataFrame, thresholds: DataFrame, detectors: dict[str, str], volatility: str | None = None) -> DataFrame:
    """h, detector, unit, step, event, score: test rows of ablation_forecasts() that rise by the threshold, and the rise that each
    detector (name -> model) foresees; with `volatility`, a feature of recent movement as one more detector."""
    d = pred.join(F.broadcast(thresholds), "h").withColumn("event", (F.col("y") - F.col("u") >= F.col("threshold")).cast("int"))
    name = F.element_at(F.create_map(*(F.lit(v) for k, m in detectors.items() for v in (m, k))), F.col("model"))
    out = d.where(F.col("model").isin(*detectors.values())).select("h", name.alias("detector"), "unit", "step", "event", (F.col("pred") - F.col("u")).alias("score"))
    if volatility is None:
        return out
    once = d.where(F.col("model") == next(iter(detectors.values()))).select("h", "unit", "step", "event").join(features.select("unit", "step", F.col(volatility).alias("score")), ["unit", "step"])
    return out.unionByName(once.select("h", F.lit("volatility_persistence").alias("detector"), "unit", "step", "event", "score"))


def paired_comparison(pred: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """For each lead and pair (better, vs) of models: the median gain of the units' mean absolute errors in per cent, units
    improved, and the signed-rank test over units. Only a row for each unit, lead and model is compared."""
    mae = keep(pred.groupBy("h", "model", "unit").agg(F.avg(F.abs(F.col("y") - F.col("pred"))).alias("mae")), "unit-errors")
    both = mae.sparkSession.createDataFrame(list(pairs), "better string, vs string")
    a, b = mae.select("h", "unit", F.col("model").alias("better"), F.col("mae").alias("mae_a")), mae.select("h", "unit", F.col("model").alias("vs"), F.col("mae").alias("mae_b"))
    keys = ["h", "better", "vs"]
    d = F.broadcast(both).join(a, "better").join(b, ["h", "unit", "vs"]).withColumn("gain", F.col("mae_b") - F.col("mae_a"))
    gain = d.groupBy(*keys).agg((F.percentile(S.ratio("gain", "mae_b"), 0.5) * 100).alias("median_gain_pct"), F.sum((F.col("gain") > 0).cast("long")).alias("units_improved"), F.count(F.lit(1)).alias("n_units"))  # of units
    return E.joined_on(gain, E.wilcoxon_by(d, "gain", keys), keys)


def leave_one_out(gram: np.ndarray, alpha: float) -> np.ndarray:
    """Ridge weights of every unit on all others, a column for each: with P the inverse of gram + alpha I, those of unit i
    are -P[:, i] / P[i, i], by the block form of an inverse. A unit has no weight on itself."""
    p = np.linalg.inv(gram + alpha * np.eye(len(gram)))
    w = -p / np.diag(p)[None, :]
    np.fill_diagonal(w, 0.0)
    return w


def virtual_sensors(df: DataFrame, x: str, split: int, alphas: Sequence[float] = tuple(10.0 ** (k / 2) for k in range(-6, 7)), bad: str | None = "bad_measurement_data") -> DataFrame:
    """Each unit rebuilt from all others by ridge: unit, step, y, pred.

    The units' cross products are aggregated once; all leave-one-out fits of a penalty come from one inverse of that matrix.
    The penalty is chosen per unit on the last quarter of the training half. Steps with any flagged unit are not trained on."""
    names = unit_names(df) or _too_many()
    d = df.select("unit", F.col("step").cast("long").alias("step"), F.col(x).cast("double").alias("x"))
    train = df.where(F.col("step") < split)
    if bad:
        train = train.join(train.groupBy("step").agg(F.max(bad).alias("_b")).where("NOT _b").select("step"), "step", "left_semi")
    k = len(names)
    gram, total, rows = np.zeros((2, k, k)), np.zeros((2, k)), np.zeros(2)
    found = cross_sums(train, x, names, F.col("step") >= split * 3 // 4).select("part", "i", "j", "n", "sx", "sxy").toArrow()  # units squared, as columns
    part, i, j, n, sx, sxy = (found.column(c).to_numpy() for c in ("part", "i", "j", "n", "sx", "sxy"))
    gram[part, i, j] = gram[part, j, i] = sxy
    own = i == j
    total[part[own], i[own]] = sx[own]
    np.maximum.at(rows, part[own], n[own])

    def centred(parts: Sequence[int]) -> tuple[np.ndarray, np.ndarray, float]:
        n = max(1.0, sum(rows[p] for p in parts))
        mean = sum(total[p] for p in parts) / n
        return sum(gram[p] for p in parts) - n * np.outer(mean, mean), mean, n

    early, early_mean, _ = centred([0])
    whole, mean, _ = centred([0, 1])
    shift = early_mean[:, None]
    judge = gram[1] - shift @ total[1][None, :] - total[1][:, None] @ shift.T + rows[1] * shift @ shift.T
    # One inverse a penalty serves all units, each on the last quarter's errors; then one for each penalty that won.
    fits = [leave_one_out(early, alpha) for alpha in alphas]
    best = np.argmin([np.diag(judge) - 2 * (b * judge).sum(axis=0) + (b * (judge @ b)).sum(axis=0) for b in fits], axis=0)
    weights = np.zeros((k, k))  # a column for each unit that is rebuilt
    for i in np.unique(best):
        weights[:, best == i] = leave_one_out(whole, alphas[i])[:, best == i]
    base = mean - mean @ weights
    shared = df.sparkSession.sparkContext.broadcast((weights, base, {u: n for n, u in enumerate(names)}))  # units are checked

    def rebuild(pdf: pd.DataFrame) -> pd.DataFrame:
        w, b, place = shared.value
        steps, at = np.unique(pdf["step"].to_numpy(), return_inverse=True)
        unit = pdf["unit"].map(place).to_numpy()
        values, there = np.zeros((len(steps), len(b))), np.zeros((len(steps), len(b)), bool)
        values[at, unit], there[at, unit] = np.nan_to_num(pdf["x"].to_numpy()), True
        out = pd.DataFrame({"unit": pdf["unit"], "step": pdf["step"], "y": pdf["x"], "pred": (values @ w + b)[at, unit]})
        return out[there.sum(axis=1)[at] > 1]  # a step without peers can't be rebuilt

    blocks = d.groupBy(F.floor(F.col("step") / _block_steps(k)).alias("_block"))
    return blocks.applyInPandas(rebuild, "unit string, step long, y double, pred double")


def residual_scores(rebuilt: DataFrame, split: int) -> DataFrame:
    """Residuals, and their distance from the training half's in its deviations: unit, step, y, resid, z, mu, sd."""
    r = rebuilt.withColumn("resid", F.col("y") - F.col("pred"))
    fit = r.where(F.col("step") < split).groupBy("unit").agg(F.avg("resid").alias("mu"), F.stddev_samp("resid").alias("sd"))
    return r.join(fit, "unit").withColumn("z", F.abs(S.ratio(F.col("resid") - F.col("mu"), F.col("sd"))))


def peer_mean_sensors(df: DataFrame, x: str) -> DataFrame:
    """Each unit rebuilt as the mean of all others at its step: unit, step, y, pred. Steps without peers are left out."""
    at = df.groupBy("step").agg(F.sum(x).alias("_sum"), F.count(x).alias("_n"))
    return df.where(F.col(x).isNotNull()).join(at, "step").where("_n > 1").select("unit", F.col("step").cast("long").alias("step"), F.col(x).alias("y"), ((F.col("_sum") - F.col(x)) / (F.col("_n") - 1)).alias("pred"))


def trial_windows(test: DataFrame, starts: DataFrame, span: int) -> DataFrame:
    """test's rows in the trials that hold them: a trial has `span` steps from its start `t` on; i counts them from 0.

    Steps and trials meet by equality on the stretch of `span` steps they lie in (a trial reaches into two), then by exact bounds:
    an ordinary join on a key, whose work is the rows that it returns and at most as many again."""
    buckets = F.array_distinct(F.array(F.floor(F.col("t") / span), F.floor((F.col("t") + span - 1) / span)))
    met = test.withColumn("_bucket", F.floor(F.col("step") / span)).join(starts.withColumn("_bucket", F.explode(buckets)), "_bucket")
    return met.where((F.col("step") >= F.col("t")) & (F.col("step") < F.col("t") + span)).withColumn("i", F.col("step") - F.col("t")).drop("_bucket")


def inject_faults(scores: DataFrame, split: int, steps: int, onsets: Sequence[int], magnitudes: Sequence[float] = (0.0, *C.FAULT_MAGNITUDES), span: int = C.FAULT_STEPS, alarms: float = 1 / C.DAY, least_r2: float | None = 0.5, per_day: int = C.DAY) -> DataFrame:
    """Detection rate and lag of bias, drift and stuck faults put on clean test residuals (no refit: the
    reconstruction does not use the faulted unit), and the false alarms a unit and day of the clean ones.
    Magnitude 0 is the floor that chance crossings give. onsets: steps after the split; trials that would run past the `steps` of
    the panel are left out. Units whose reconstruction explains
    too little are not tested. `scores` is read several times: write it first if it is dear."""
    spark = scores.sparkSession
    test = scores.where(F.col("step") >= split)
    if least_r2 is not None:
        good = E.errors(test, "y", "pred", ["unit"]).where(F.col("r2") > least_r2).select("unit")
        test = test.join(good, "unit", "left_semi")
    tau = quantiles_by(test, ["unit"], "z", {"tau": 1 - alarms})
    false = test.join(tau, "unit").groupBy("unit").agg(F.avg((F.col("z") > F.col("tau")).cast("double")).alias("rate")).agg((F.avg("rate") * per_day).alias("false_alarms_per_unit_day"), F.count(F.lit(1)).alias("units_tested"))
    kinds = [(k, float(m)) for k in ("bias", "drift") for m in magnitudes] + [("stuck", None)]
    config = spark.createDataFrame(kinds, "fault string, magnitude double")
    starts = spark.createDataFrame([(int(t) + split,) for t in onsets if t + split + span <= steps], "t long")
    window = trial_windows(test, starts, span).join(tau, "unit")
    window = window.withColumn("y0", F.max(F.when(F.col("i") == 0, F.col("y"))).over(Window.partitionBy("unit", "t")))  # of one trial
    bump = F.when(F.col("fault") == "bias", F.col("magnitude")).when(F.col("fault") == "drift", F.col("magnitude") * F.col("i") / (span - 1)).otherwise(F.col("y0") - F.col("y"))
    fired = F.abs((F.col("resid") + bump - F.col("mu")) / F.col("sd")) > F.col("tau")
    trial = window.join(F.broadcast(config)).groupBy("fault", "magnitude", "unit", "t").agg(F.min(F.when(fired, F.col("i"))).alias("first"))
    rates = trial.groupBy("fault", "magnitude").agg(F.avg(F.col("first").isNotNull().cast("double")).alias("detection_rate"), F.percentile("first", 0.5).alias("median_lag"), F.count(F.lit(1)).alias("trials"))  # of at most span lags
    return rates.join(F.broadcast(false))


def signature(df: DataFrame, u: str = "measured_power_util", p: str = "production_power_util", bad: str = "bad_production_power_data", tod: str = "tod") -> DataFrame:
    """Eleven behavioural features per unit."""
    fleet = Window.partitionBy("step")
    d = df.withColumns({"_d": diff(u), "_fleet": F.avg(u).over(fleet)}).withColumn("_d1", lag("_d", 1))
    hours = d.groupBy("unit", tod).agg(F.avg(u).alias("m"))
    day = hours.groupBy("unit").agg((F.max("m") - F.min("m")).alias("diurnal_amp"), F.max_by(tod, "m").cast("double").alias("diurnal_peak"))
    spread = d.join(hours, ["unit", tod]).groupBy("unit").agg(F.stddev_samp(F.col(u) - F.col("m")).alias("resid_sd"))
    ends = quantiles_by(d, ["unit"], u, {"_low": 0.01, "_high": 0.99}).select("unit", (F.col("_high") - F.col("_low")).alias("range"))
    ramps = quantiles_by(d.select("unit", F.abs("_d").alias("_a")), ["unit"], "_a", {"ramp_p99": 0.99})
    own = d.groupBy("unit").agg(
        F.avg(u).alias("mean"), F.stddev_samp(u).alias("sd"), F.corr("_d", "_d1").alias("d_autocorr1"),
        F.corr(u, "_fleet").alias("corr_fleet"), F.avg(F.col(u) - F.col(p)).alias("headroom"), F.avg(F.col(bad).cast("double")).alias("badp_rate"),
    )
    return own.join(ends, "unit").join(ramps, "unit", "left").join(day, "unit").join(spread, "unit")


def standardized(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns to mean 0 and population deviation 1 (constant columns to 0), as one array column `v`."""
    stats = df.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns))
    scaled = [F.coalesce(S.ratio(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")), F.lit(0.0)) for c in columns]
    return df.join(F.broadcast(stats)).withColumn("v", F.array(*scaled)).select(*df.columns, "v")


def kmeans_scan(points: DataFrame, vector: str, key: str, truth: str, ks: Sequence[int] = range(2, 11), seed: int = 0) -> DataFrame:
    """Silhouette and agreement with a known grouping for each k."""
    d = points.select(key, truth, F.col(vector).alias("v"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    labelled = d
    for k in ks:
        labelled = KMeans(k=k, seed=seed, maxIter=20, predictionCol=f"k{k}").fit(d).transform(labelled)
    return _groupings(keep(labelled.drop("features"), "labelled"), truth, ks)


def _groupings(labelled: DataFrame, truth: str, ks: Sequence[int]) -> DataFrame:
    """k, silhouette and adjusted_rand of the groupings k2, k3 and so on of a written table; all silhouettes from one pass over the distances."""
    scores = keep(E.silhouettes(labelled, "v", [f"k{k}" for k in ks]), "scores")
    rows = [E.adjusted_rand(labelled, truth, f"k{k}").join(scores).select(F.lit(k).alias("k"), F.col(f"k{k}").alias("silhouette"), "adjusted_rand") for k in ks]
    return reduce(DataFrame.unionByName, rows)


def permutation_level(labels: Sequence[object], truth: Sequence[object], draws: int = 2000, q: float = 0.95, seed: int = 0) -> float:
    """Chance level of the adjusted Rand index for these groupings of a small set."""
    a, b = (np.unique(np.asarray(x), return_inverse=True)[1] for x in (labels, truth))
    rng, n = np.random.default_rng(seed), len(a)
    pairs = lambda c: (c * (c - 1) / 2).sum()
    pa, pb = pairs(np.bincount(a)), pairs(np.bincount(b))
    expected = pa * pb / (n * (n - 1) / 2)
    score = lambda x: (pairs(np.bincount(x * (b.max() + 1) + b)) - expected) / (((pa + pb) / 2 - expected) or 1.0)
    return float(np.quantile([score(rng.permutation(a)) for _ in range(draws)], q))


def _kmeans(x: np.ndarray, k: int, seed: int, steps: int = 100) -> tuple[float, np.ndarray]:
    """One start of k-means from distant points: inertia and labels."""
    rng = np.random.default_rng(seed)
    centers = x[rng.integers(len(x))][None, :]
    while len(centers) < k:
        gap = ((x[:, None] - centers[None]) ** 2).sum(axis=2).min(axis=1)
        centers = np.vstack([centers, x[rng.choice(len(x), p=gap / gap.sum()) if gap.sum() > 0 else rng.integers(len(x))]])
    label = np.zeros(len(x), int)
    for _ in range(steps):
        label = ((x[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.stack([x[label == i].mean(axis=0) if (label == i).any() else centers[i] for i in range(k)])
        if np.array_equal(new, centers):
            break
        centers = new
    return float(((x - centers[label]) ** 2).sum()), label


def segment_scan(points: DataFrame, vector: str, key: str, truth: str, ks: Sequence[int] = range(2, 11), starts: int = 20, draws: int = 2000) -> DataFrame:
    """k-means of a small set of units for each k, the best of several starts: k, inertia, silhouette, agreement with a known
    grouping and its chance level. The set's size is checked; every start is a task's work."""
    rows = points.select(F.col(key).cast("string").alias("key"), F.col(truth).cast("string").alias("truth"), F.col(vector).alias("v")).limit(MOST_UNITS + 1).collect()
    if len(rows) > MOST_UNITS:
        _too_many()
    rows.sort(key=lambda r: r["key"])
    spark = points.sparkSession
    shared = spark.sparkContext.broadcast((np.array([r.v for r in rows], float), [r.truth for r in rows]))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        k, start = int(pdf["k"].iloc[0]), int(pdf["start"].iloc[0])
        x = shared.value[0]
        inertia, label = _kmeans(x, min(k, len(x)), start)
        return pd.DataFrame({"k": [k], "start": [start], "inertia": [inertia], "labels": [label.tolist()]})

    def level(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": pdf["k"], "chance_p95": [permutation_level(labels, shared.value[1], draws) for labels in pdf["labels"]]})

    settings = spark.range(starts).selectExpr("CAST(id AS int) AS start", f"explode(array({', '.join(map(str, ks))})) AS k")
    tried = settings.groupBy("k", "start").applyInPandas(one, "k int, start int, inertia double, labels array<int>")
    best = keep(tried.groupBy("k").agg(F.min("inertia").alias("inertia"), F.min_by("labels", F.struct("inertia", "start")).alias("labels")), "starts")
    chance = best.groupBy("k").applyInPandas(level, "k int, chance_p95 double")
    units = spark.createDataFrame([(i, r["key"], r.truth, [float(e) for e in r.v]) for i, r in enumerate(rows)], "i int, key string, truth string, v array<double>")
    each = best.select(F.concat(F.lit("k"), "k").alias("k"), F.posexplode("labels").alias("i", "label")).groupBy("i").pivot("k", [f"k{k}" for k in ks]).agg(F.first("label"))
    scores = _groupings(keep(each.join(F.broadcast(units), "i"), "labelled"), "truth", ks)
    return best.select("k", "inertia").join(F.broadcast(scores), "k").join(F.broadcast(chance), "k")


def wide_panel(df: DataFrame, x: str, units: Sequence[str]) -> DataFrame:
    """One row per step, one column per (named) unit."""
    return df.groupBy("step").pivot("unit", list(units)).agg(F.first(x))


def boost_per_unit(features: DataFrame, columns: Sequence[str], h: int, split: int) -> DataFrame:
    """Boosted trees of depth 2 of the increment, one model per unit: test rows as in ridge_per_unit()."""
    return ablation_forecasts(features, {"boost": ("boost", columns)}, (h,), split).drop("h", "model")


def reserve_shortfall(df: DataFrame, x: str, k: int, sigmas: float = 3.0, site_mw: float = C.SITE_MW, engine_mw: float = C.ENGINE_MW) -> DataFrame:
    """Following capability in megawatts as measured and as independent units would need it, and the gap in engines."""
    r = reserve_inflation(df, x, k)
    actual = F.col("fleet_ramp_sd") * site_mw * sigmas
    return r.select(F.lit(k).alias("h"), actual.alias("actual_mw"), (actual / F.col("reserve_inflation")).alias("independent_mw"), ((actual - actual / F.col("reserve_inflation")) / engine_mw).alias("short_engines"))
