"""Tail-quantile forecasts: rolling order statistics, filtered historical simulation, calibration.

Lags, increments and volatilities are native windows. Only the rolling order statistic, which no
built-in window expresses with its rank rule, is a grouped map. A unit's series is cut into blocks that carry
the history that all of a forecast's windows reach back to (panel.in_blocks()), so long series spread over tasks.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline import constants as C
from wattline.functions import scalars as S
from wattline.operators.panel import ar1_slope, in_blocks, lag, thinned, trailing
from wattline.scratch import keep


def rank_in_window(alpha: float, window: int) -> int:
    """Zero-based rank of the quantile: no interpolation."""
    return math.ceil(alpha * window) - 1


def tail_kernel(x: np.ndarray, alpha: float, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Order statistic and mean above it of each trailing window; NaN sorts last, so it can spoil the mean alone."""
    q, es = tail_kernels(x, (alpha,), window)
    return q[0], es[0]


#: A window parted anew costs about as much as so many of its elements' steps of a sliding window.
STEP_COST = 400


def tail_kernels(x: np.ndarray, alphas: Sequence[float], window: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """tail_kernel() for several levels at once, a row for each; NaN where `wanted` (a mask of rows) is false.

    Where most windows are wanted, one ordered window slides along: a value enters and one leaves by binary search, and ranks are read
    off it. Where few are, those are parted at their ranks and the rest is never looked at."""
    n, ranks = len(x), [rank_in_window(a, window) for a in alphas]
    q, es = (np.full((len(alphas), n), np.nan) for _ in range(2))
    rows = np.arange(window - 1, n) if wanted is None else np.flatnonzero(wanted[window - 1 :]) + window - 1
    if len(rows) * window < n * STEP_COST:
        _parted(x, ranks, window, rows, q, es)
    else:
        _slid(x, ranks, window, rows, q, es)
    return q, es


def _parted(x: np.ndarray, ranks: Sequence[int], window: int, rows: np.ndarray, q: np.ndarray, es: np.ndarray, at_once: int = 2048) -> None:
    for at in range(0, len(rows), at_once):
        out = rows[at : at + at_once]
        part = np.partition(sliding_window_view(x, window)[out - window + 1], sorted(set(ranks)), axis=1)
        for i, k in enumerate(ranks):
            q[i, out] = part[:, k]
            es[i, out] = part[:, k + 1 :].mean(axis=1) if k + 1 < window else part[:, k]


def _slid(x: np.ndarray, ranks: Sequence[int], window: int, rows: np.ndarray, q: np.ndarray, es: np.ndarray) -> None:
    """The ordered window is a list of the values that are numbers (its moves are memory copies), and a count of those that are none."""
    values = x.tolist()
    held = sorted(v for v in values[: window - 1] if v == v)
    at = window - 1
    for t in rows.tolist():
        while at <= t:
            if at >= window and (old := values[at - window]) == old:
                del held[bisect_left(held, old)]
            if (new := values[at]) == new:
                insort(held, new)
            at += 1
        whole = len(held) == window
        for i, k in enumerate(ranks):
            if k < len(held):
                q[i, t] = held[k]
                if k + 1 == window:
                    es[i, t] = held[k]
                elif whole:
                    es[i, t] = sum(held[k + 1 :]) / (window - k - 1)


def rolling_tail(df: DataFrame, x: str, alpha: float, window: int, keys: Sequence[str] = ("unit",), order: str = "step", block: int | None = None) -> DataFrame:
    """df with q and es over the `window` rows that end at each row (shift x first to use the past only).
    NaN outside full windows. `order` must count a unit's rows without gaps."""
    return rolling_tails(df, x, (alpha,), window, keys, order, block).drop("alpha")


def rolling_tails(df: DataFrame, x: str, alphas: Sequence[float], window: int, keys: Sequence[str] = ("unit",), order: str = "step", block: int | None = None) -> DataFrame:
    """rolling_tail() for several levels: a row for each row of df and level, with alpha."""
    return in_blocks(df, window - 1, lambda d: _tails(d, x, alphas, window, keys, order), block if block is None else block and max(block, window))


def _tails(df: DataFrame, x: str, alphas: Sequence[float], window: int, keys: Sequence[str], order: str) -> DataFrame:
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        q, es = tail_kernels(pdf[x].to_numpy(dtype=float, na_value=np.nan), alphas, window)
        return pd.concat([pdf.assign(alpha=a, q=q[i], es=es[i]) for i, a in enumerate(alphas)])

    return df.groupBy(*keys).applyInPandas(run, f"{kind}, alpha double, q double, es double")


def _forecast(df: DataFrame, keep: list[str], center: str, sigma: str | None, alpha: float, window: int, h: int) -> DataFrame:
    """var and es around a centre: the tail of what the past held, scaled."""
    tail = rolling_tail(df.withColumn("_past", lag("_x", h)), "_past", alpha, window, block=0)
    scale = (lambda c: F.col(center) + F.col(sigma) * F.col(c)) if sigma else (lambda c: F.col(c))
    return tail.select(*keep, scale("q").alias("var"), scale("es").alias("es"))


def empirical(df: DataFrame, y: str, alpha: float, window: int = C.WINDOW, vol_window: int = C.VOL_WINDOW, block: int | None = None) -> DataFrame:
    """History of the level: unit, step, y, anchor, var, es."""

    def f(d: DataFrame) -> DataFrame:
        return _forecast(d.withColumns({"_x": F.col("y"), "anchor": lag("y", 1)}), ["unit", "step", "y", "anchor"], "anchor", None, alpha, window, 1)

    return in_blocks(df.select("unit", "step", F.col(y).alias("y")), window + 1, f, block)


def fhs_horizon(df: DataFrame, y: str, alpha: float, h: int = 1, window: int = C.WINDOW, vol_window: int = C.VOL_WINDOW, block: int | None = None) -> DataFrame:
    """Level h steps ago plus volatility times the tail of standardised h-step increments."""

    def f(d: DataFrame) -> DataFrame:
        d = d.withColumn("anchor", lag("y", h)).withColumn("_d", F.col("y") - F.col("anchor"))
        d = d.withColumn("_sigma", trailing("stddev_samp", "_d", vol_window, h)).withColumn("_x", S.ratio("_d", "_sigma"))
        return _forecast(d, ["unit", "step", "y", "anchor"], "anchor", "_sigma", alpha, window, h)

    return in_blocks(df.select("unit", "step", F.col(y).alias("y")), 3 * h + vol_window + window, f, block)


def fhs(df: DataFrame, y: str, alpha: float, window: int = C.WINDOW, vol_window: int = C.VOL_WINDOW, block: int | None = None) -> DataFrame:
    return fhs_horizon(df, y, alpha, 1, window, vol_window, block)


def fhs_ar(df: DataFrame, y: str, alpha: float, window: int = C.WINDOW, vol_window: int = C.VOL_WINDOW, block: int | None = None) -> DataFrame:
    """With a trailing AR(1) term on the increment."""
    return in_blocks(df.select("unit", "step", F.col(y).alias("y")), 2 * window + vol_window + 5, lambda d: _fhs_ar(d, alpha, window, vol_window), block)


def _fhs_ar(df: DataFrame, alpha: float, window: int, vol_window: int) -> DataFrame:
    d = ar1_slope(df, "y", window, block=0)
    d = d.withColumn("anchor", lag("y", 1)).withColumn("_center", F.col("anchor") + F.col("phi") * F.col("d1")).withColumn("_resid", F.col("d") - F.col("phi") * F.col("d1"))
    d = d.withColumn("_sigma", trailing("stddev_samp", "_resid", vol_window)).withColumn("_x", S.ratio("_resid", "_sigma"))
    return _forecast(d, ["unit", "step", "y", "anchor"], "_center", "_sigma", alpha, window, 1)


MODELS: dict[str, Callable[..., DataFrame]] = {"empirical": empirical, "fhs": fhs, "fhs_ar": fhs_ar}


def forecast_panel(df: DataFrame, y: str, model: str, alpha: float, window: int = C.WINDOW, vol_window: int = C.VOL_WINDOW, block: int | None = None) -> DataFrame:
    return MODELS[model](df, y, alpha, window, vol_window, block)


def apply_multiplier(fc: DataFrame, m: float) -> DataFrame:
    """Widen or narrow the band around its anchor."""
    return fc.withColumns({c: F.col("anchor") + m * (F.col(c) - F.col("anchor")) for c in ("var", "es")})


def forecast_horizon(df: DataFrame, y: str, alpha: float, h: int, m: float = 1.0, window: int = C.WINDOW, vol_window: int = C.VOL_WINDOW, block: int | None = None) -> DataFrame:
    """Every h-th forecast at a lead of h steps."""
    return thinned(apply_multiplier(fhs_horizon(df, y, alpha, h, window, vol_window, block), m), h)


def usable(fc: DataFrame, *columns: str) -> DataFrame:
    """Rows without null or NaN in these columns."""
    return fc.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in columns))


def calibrate(fc: DataFrame, alpha: float, split: int, low: float = 0.5, high: float = 4.0) -> DataFrame:
    """One multiplier for the whole panel, fitted before the split and judged after it: one row.

    With non-negative spreads the breach rate falls as the multiplier grows, so the smallest one whose rate is
    at most 1 - alpha is an order statistic of (y - anchor) / (var - anchor): no search over the data."""
    return calibrate_by(fc.withColumn("alpha", F.lit(float(alpha))), ("alpha",), split, low, high).drop("alpha")


def calibrate_by(fc: DataFrame, keys: Sequence[str], split: int, low: float = 0.5, high: float = 4.0) -> DataFrame:
    """calibrate() for each group of `keys`, of which `alpha` is one: a row for each, all in one plan."""
    d = usable(fc, "var", "anchor").withColumn("_spread", F.col("var") - F.col("anchor"))
    d = d.withColumn("_r", F.when(F.col("_spread") > 0, (F.col("y") - F.col("anchor")) / F.col("_spread")).when(F.col("y") > F.col("anchor"), F.lit(float("inf"))).otherwise(F.lit(float("-inf"))))
    train, test = d.where(F.col("step") < split), d.where(F.col("step") >= split)
    m = _smallest_enough(train, keys, low, high).select(*keys, "n_train", S.clip("m", low, high).alias("m"))
    over = lambda k: (F.col("y") > F.col("anchor") + k * F.col("_spread")).cast("double")
    t = test.join(F.broadcast(m), list(keys)).groupBy(*keys).agg(F.max("m").alias("m"), F.max("n_train").alias("n_train"), F.count(F.lit(1)).alias("n_test"), F.avg(over(F.lit(1.0))).alias("raw_test"), F.avg(over(F.col("m"))).alias("cal_test"), F.count_distinct("unit").alias("_units"))
    p = 1.0 - F.col("alpha")
    t = t.withColumn("breaches_per_unit", F.col("raw_test") * F.col("n_test") / F.greatest(F.col("_units"), F.lit(1))).withColumn("rel_error", F.abs(F.col("cal_test") - p) / p)
    verdict = F.lit("underpowered")
    for least, most, label in reversed(C.VERDICTS):
        verdict = F.when((F.col("breaches_per_unit") >= least) & (F.col("rel_error") <= most), label).otherwise(verdict)
    return t.withColumn("verdict", verdict).drop("_units")


def _smallest_enough(d: DataFrame, keys: Sequence[str], low: float, high: float, bins: int = 4096) -> DataFrame:
    """The order statistic of _r at rank n - floor((1 - alpha) n), exact within [low, high]: keys, m, n_train.
    A histogram finds the bin that holds the rank; that bin's distinct values are then counted in order."""
    width = (high - low) / bins
    place = F.when(F.col("_r") < low, -1).when(F.col("_r") >= high, bins).otherwise(F.floor((F.col("_r") - low) / width)).cast("int")
    binned = d.select(*keys, "_r", place.alias("_bin"))
    counts = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)  # rows are bins
    bin_of = counts.select(*keys, "_bin", "_n", F.sum("_n").over(upto).alias("_upto"), F.sum("_n").over(Window.partitionBy(*keys)).alias("n_train"))
    bin_of = bin_of.withColumn("_k", F.greatest(F.lit(1), F.col("n_train") - F.floor((1.0 - F.col("alpha")) * F.col("n_train") + 1e-9)))
    bin_of = bin_of.where((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_n") < F.col("_k"))).select(*keys, "_bin", "n_train", (F.col("_k") - F.col("_upto") + F.col("_n")).alias("_rest"))
    inside = binned.where(F.col("_bin").between(0, bins - 1)).join(F.broadcast(bin_of), [*keys, "_bin"]).groupBy(*keys, "_rest", "_r").agg(F.count(F.lit(1)).alias("_c"))
    within = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)  # distinct values of one bin
    exact = inside.withColumn("_i", F.sum("_c").over(within)).where("_i >= _rest AND _i - _c < _rest").select(*keys, "_r")
    ends = F.when(F.col("_bin") < 0, F.lit(low)).otherwise(F.lit(high))
    return bin_of.join(F.broadcast(exact), list(keys), "left").select(*keys, "n_train", F.coalesce("_r", ends).alias("m"))


def horizon_forecasts(df: DataFrame, y: str, horizons: Sequence[int], alphas: Sequence[float], window: int = C.WINDOW, vol_window: int = C.VOL_WINDOW, block: int | None = None) -> DataFrame:
    """forecast_horizon() for each lead and level as rows: h, alpha, unit, step, y, anchor, var, es. The windows of all leads
    share one pass over the panel and one grouped map, which looks at the windows of every h-th step alone."""

    def f(d: DataFrame) -> DataFrame:
        d = d.withColumns({f"_a{h}": lag("y", h) for h in horizons}).withColumns({f"_d{h}": F.col("y") - F.col(f"_a{h}") for h in horizons})
        d = d.withColumns({f"_s{h}": trailing("stddev_samp", f"_d{h}", vol_window, h) for h in horizons})
        d = d.withColumns({f"_x{h}": S.ratio(f"_d{h}", f"_s{h}") for h in horizons}).withColumns({f"_p{h}": lag(f"_x{h}", h) for h in horizons})
        return d.select("unit", "step", "y", *(f"_{k}{h}" for h in horizons for k in "asp")).groupBy("unit").applyInPandas(run, "h int, alpha double, unit string, step long, y double, anchor double, var double, es double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, parts = pdf.sort_values("step"), []
        step = pdf["step"].to_numpy()
        for h in horizons:
            mine = step % h == 0
            anchor, sigma, past = (pdf[f"_{k}{h}"].to_numpy(dtype=float, na_value=np.nan) for k in "asp")
            q, es = tail_kernels(past, alphas, window, mine)
            for i, a in enumerate(alphas):
                parts.append(pd.DataFrame({"h": h, "alpha": a, "unit": pdf["unit"].to_numpy()[mine], "step": step[mine], "y": pdf["y"].to_numpy()[mine], "anchor": anchor[mine], "var": (anchor + sigma * q[i])[mine], "es": (anchor + sigma * es[i])[mine]}))
        return pd.concat(parts)

    return in_blocks(df.select("unit", F.col("step").cast("long").alias("step"), F.col(y).alias("y")), 3 * max(horizons) + vol_window + window, f, block)


def limit_curve(df: DataFrame, y: str, horizons: Sequence[int] = C.LIMIT_HORIZONS, alphas: Sequence[float] = C.LIMIT_ALPHAS, split: int = C.FLEET_SPLIT, window: int = C.WINDOW, vol_window: int = C.VOL_WINDOW, start: int = 0, block: int | None = None) -> DataFrame:
    """Calibrated limits over lead times and risk levels, one row for each. Steps before `start` are left out. Forecasts and
    multipliers are written once: fitting, judging and limits all read them."""
    keys = ["h", "alpha"]
    fc = keep(usable(horizon_forecasts(df, y, horizons, alphas, window, vol_window, block), "var", "anchor").where(F.col("step") >= start), "forecasts")
    cal = keep(calibrate_by(fc, keys, split), "multipliers")  # a row for each lead and level
    lim = fc.join(F.broadcast(cal.select(*keys, "m")), keys).groupBy(*keys, "unit").agg((1 / F.avg(F.col("anchor") + F.col("m") * (F.col("var") - F.col("anchor"))) - 1).alias("lim"))
    pct = lim.groupBy(*keys).agg(F.percentile("lim", 0.1).alias("p10"), F.percentile("lim", 0.5).alias("median"), F.percentile("lim", 0.9).alias("p90"), F.min("lim").alias("worst"))  # of units
    return cal.join(F.broadcast(pct), keys)
