"""Causal windows over a regular panel in long form: one row per unit and step.

Every window is partitioned by unit and ordered by step, or partitioned by step for the
cross-section; trailing statistics are null until their window is full. A unit is cut into blocks of steps that carry
the history their windows reach back to, so that one long unit is the work of many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wattline.functions import scalars as S

UNIT, STEP = ("unit",), "step"


def along(keys: Sequence[str] = UNIT, order: str = STEP) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def lag(x: str | Column, k: int, w: WindowSpec | None = None) -> Column:
    return F.lag(x, k).over(w or along()) if k >= 0 else F.lead(x, -k).over(w or along())


def diff(x: str, k: int = 1, w: WindowSpec | None = None) -> Column:
    return F.col(x) - lag(x, k, w)


def trailing(fn: str, x: str, size: int, ends: int = 1, w: WindowSpec | None = None) -> Column:
    """fn ('avg', 'stddev_samp', 'max', 'sum') over the `size` rows that end `ends` rows before; null until all are there."""
    frame = (w or along()).rowsBetween(-(ends + size - 1), -ends)
    return F.when(F.count(x).over(frame) == size, getattr(F, fn)(x).over(frame))


#: Steps of a block for each step that its windows reach back: history adds a sixteenth of the rows.
BLOCK_REACH = 16
#: Between a unit's name and its block.
SEP = "\x01"


def in_blocks(df: DataFrame, reach: int, f: Callable[[DataFrame], DataFrame], block: int | None = None) -> DataFrame:
    """f(df) for an f whose windows run along `unit` and reach at most `reach` steps back, with each unit in blocks of `block` steps.

    While f works, `unit` is the unit and its block, and a row also stands in the later blocks that reach back to it; afterwards
    each row is its own block's, once. Nothing but `unit` and `step` need be in f's result. Steps must count a unit's rows
    without gaps (see require_dense()). `block` 0: df is in blocks already, or is to be left whole."""
    if block == 0:
        return f(df)
    block = block or BLOCK_REACH * max(1, reach)
    at = lambda step: F.floor(step / block)
    blocks = F.transform(F.sequence(at(F.col(STEP)), at(F.col(STEP) + reach)), lambda b: F.concat(F.col("unit"), F.lit(SEP), b.cast("string")))
    out = f(df.withColumn("unit", F.explode(blocks)))
    own = at(F.col(STEP)).cast("string") == F.substring_index("unit", SEP, -1)
    return out.where(own).withColumn("unit", F.substring_index("unit", SEP, 1))


def require_dense(df: DataFrame, columns: Sequence[str], unit: str = "unit", order: str = STEP) -> None:
    """Fail if a panel has a gap: a null in these columns, a step that a unit lacks, or one that it has twice."""
    nulls = F.sum(F.when(F.expr(" OR ".join(f"{c} IS NULL" for c in columns)), 1).otherwise(0))
    units = df.groupBy(unit).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(order).alias("steps"), nulls.alias("nulls"))
    r = units.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("units"), F.min("steps").alias("least"), F.sum("nulls").alias("nulls")).first()
    if not r["rows"]:
        return
    if r["nulls"]:
        raise ValueError(f"null in one of {list(columns)}")
    steps = df.agg(F.count_distinct(order)).first()[0]
    if r["rows"] != r["units"] * steps or r["least"] != steps:
        raise ValueError(f"{r['rows']} rows are not {r['units']} units of {steps} steps each")


def lag_diff_features(df: DataFrame, y: str, lags: Sequence[int] = (1, 2, 3, 6, 12), diffs: Sequence[int] = (1, 3, 6), block: int | None = None) -> DataFrame:
    columns = [*(lag(y, k).alias(f"lag_{k}") for k in lags), *(diff(y, k).alias(f"d{k}") for k in diffs)]
    return in_blocks(df.select("unit", "step", y), max(*lags, *diffs), lambda d: d.select("unit", "step", *columns), block)


def trailing_stats(df: DataFrame, y: str, hour: int = 12, day: int = 288, block: int | None = None) -> DataFrame:
    columns = [trailing("avg", y, hour).alias("roll_mean_1h"), trailing("stddev_samp", y, hour).alias("roll_std_1h"), trailing("avg", y, day).alias("roll_mean_1d"),
        trailing("max", y, day).alias("roll_max_1d"), trailing("stddev_samp", y, day).alias("roll_std_1d")]
    stats = in_blocks(df.select("unit", "step", y), max(hour, day), lambda d: d.select("unit", "step", *columns), block)
    return stats.withColumn("vol_ratio", S.ratio("roll_std_1h", "roll_std_1d"))


def clock(ts: str = "ts", width_min: int = 5) -> dict[str, Column]:
    """Time of day in minutes and as a point on a circle, weekday (Monday 0) and weekend."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    angle = 2 * math.pi * minute / 1440
    return {"tod": F.floor(minute / width_min).cast("int"), "tod_sin": F.sin(angle), "tod_cos": F.cos(angle), "dow": F.weekday(ts), "weekend": (F.weekday(ts) >= 5).cast("int")}


def clock_features(df: DataFrame, ts: str = "ts", width_min: int = 5) -> DataFrame:
    return df.select("unit", "step", *(c.alias(n) for n, c in clock(ts, width_min).items()))


def unit_features(df: DataFrame, y: str, p: str, hour: int = 12, day: int = 288, ts: str = "ts", block: int | None = None) -> DataFrame:
    """The single-unit feature frame: lags, trailing statistics, second channel, clock. Row t uses nothing after t - 1."""
    c = clock(ts)
    out = df.withColumn("_head", F.col(y) - F.col(p))
    base = [F.col("unit"), F.col("step"), F.col(y).alias("y")] + [lag(y, k).alias(f"lag_{k}") for k in (1, 2, 3, 6, 12)]
    base += [lag(y, day).alias("lag_day"), lag(y, 7 * day).alias("lag_week"), trailing("avg", y, hour).alias("roll_mean_1h"), trailing("stddev_samp", y, hour).alias("roll_std_1h")]
    base += [trailing("avg", y, day).alias("roll_mean_1d"), trailing("max", y, day).alias("roll_max_1d"), trailing("stddev_samp", y, day).alias("roll_std_1d")]
    base += [lag(p, 1).alias("prod_lag_1"), lag("_head", 1).alias("headroom_lag_1"), c["tod_sin"].alias("tod_sin"), c["tod_cos"].alias("tod_cos"), c["dow"].alias("dow")]
    out = in_blocks(out.select("unit", "step", y, p, "_head", ts), 7 * day, lambda d: d.select(*base), block)
    return out.withColumn("vol_ratio", S.ratio("roll_std_1h", "roll_std_1d"))


#: The feature frame: each column's definition on the settings `k` (channels, window lengths, clock), by where it comes from.
FRAME = {
    "own": {
        "u": lambda k: F.col(k.y),
        **{f"d{n}": lambda k, n=n: F.col(k.y) - lag(k.y, n) for n in (1, 3, 6)},
        "lag12": lambda k: lag(k.y, 12),
        "lag_day": lambda k: lag(k.y, k.day),
        "roll_mean_h": lambda k: trailing("avg", k.y, k.hour),
        "roll_std_h": lambda k: trailing("stddev_samp", k.y, k.hour),
        "roll_std_day": lambda k: trailing("stddev_samp", k.y, k.day),
        "dev_from_day": lambda k: F.col(k.y) - trailing("avg", k.y, k.day),
    },
    "second": {"p": lambda k: F.col(k.p), "headroom": lambda k: F.col(k.y) - F.col(k.p), "p_d1": lambda k: F.col(k.p) - lag(k.p, 1), "badp": lambda k: F.col(k.bad).cast("double")},
    "clock": {name: lambda k, name=name: k.clock[name] for name in ("tod_sin", "tod_cos", "dow")},
    "others": {  # on the columns above
        **{f"fleet_{name}": lambda k, fn=fn, x=x: getattr(F, fn)(x).over(Window.partitionBy("step")) for name, fn, x in (("mean", "avg", "u"), ("std", "stddev_samp", "u"), ("d1", "avg", "d1"))},
        **{f"cell_{name}": lambda k, x=x: F.avg(x).over(Window.partitionBy("step", "cell")) for name, x in (("mean", "u"), ("d1", "d1"))},
        "rel_to_fleet": lambda k: F.col("u") - F.avg("u").over(Window.partitionBy("step")),
    },
}


def feature_names(*parts: str) -> list[str]:
    return [name for part in parts for name in FRAME[part]]


OWN, FLEET, METER_ONLY = feature_names("own", "second", "clock"), feature_names("own", "second", "clock", "others"), feature_names("own", "clock", "others")


def fleet_features(df: DataFrame, y: str = "measured_power_util", p: str = "production_power_util", bad: str = "bad_production_power_data", hour: int = 12, day: int = 288, ts: str = "ts", block: int | None = None) -> DataFrame:
    """Own history, second channel, the other units at the same step, and the clock: known at t.
    The cross-section is a window by step, not a join."""
    k = SimpleNamespace(y=y, p=p, bad=bad, hour=hour, day=day, clock=clock(ts))
    columns = [define(k).alias(name) for part in ("own", "second", "clock") for name, define in FRAME[part].items()]
    own = in_blocks(df.select("unit", "cell", "step", y, p, bad, ts), max(12, hour, day), lambda d: d.select("unit", "cell", "step", *columns), block)
    return own.withColumns({name: define(k) for name, define in FRAME["others"].items()})


def with_trailing_sums(df: DataFrame, columns: dict[str, str], size: int) -> DataFrame:
    """trailing('sum', ..) for long windows, as named: differences of running sums, so a row costs the same at any length.
    Over a stretch of zeros the difference is exactly 0."""
    upto = along().rowsBetween(Window.unboundedPreceding, -1)
    run = df.withColumns({f"_{k}_{x}": f(x).over(upto) for x in columns.values() for k, f in (("s", F.sum), ("n", F.count))})
    past = lambda c: F.coalesce(lag(c, size), F.lit(0))
    full = {name: F.when(F.col(f"_n_{x}") - past(f"_n_{x}") == size, F.col(f"_s_{x}") - past(f"_s_{x}")) for name, x in columns.items()}
    return run.withColumns(full).drop(*(f"_{k}_{x}" for x in columns.values() for k in "sn"))


def ar1_slope(df: DataFrame, y: str, window: int, bound: float = 0.99, block: int | None = None) -> DataFrame:
    """Trailing least-squares slope of increments on the increment before, through the origin; 0 in warm-up."""
    return in_blocks(df, window + 3, lambda d: _ar1_slope(d, y, window, bound), block)


def _ar1_slope(df: DataFrame, y: str, window: int, bound: float) -> DataFrame:
    d = df.withColumn("_d", diff(y)).withColumn("_d1", lag("_d", 1))
    d = d.withColumns({"_num": F.col("_d") * F.col("_d1"), "_den": F.col("_d1") * F.col("_d1")})
    d = with_trailing_sums(d, {"_nums": "_num", "_dens": "_den"}, window)
    slope = F.coalesce(S.ratio("_nums", "_dens"), F.lit(0.0))
    return d.withColumn("phi", S.clip(slope, -bound, bound)).drop("_num", "_den", "_nums", "_dens").withColumnsRenamed({"_d": "d", "_d1": "d1"})


def episodes(df: DataFrame, flag: str, keys: Sequence[str] = ("cell", "pdu"), order: str = "step", ts: str = "ts") -> DataFrame:
    """Runs of a true flag: start, end and length. Islands by a running count of flips."""
    w = along(keys, order)
    flips = df.withColumn("_flip", (F.col(flag) != F.lag(flag, 1, False).over(w)).cast("int"))
    runs = flips.withColumn("_run", F.sum("_flip").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(flag)
    return runs.groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("n_intervals"), F.min(ts).alias("start"), F.max(ts).alias("end")).drop("_run")


def global_episodes(df: DataFrame, flag: str, order: str = "step", ts: str = "ts") -> DataFrame:
    """Runs in which any unit is flagged; one row per step reaches the single window."""
    any_unit = df.groupBy(order, ts).agg(F.max(flag).alias(flag)).withColumn("all", F.lit("all"))
    return episodes(any_unit, flag, ["all"], order, ts).drop("all")


def thinned(df: DataFrame, h: int, order: str = "step") -> DataFrame:
    """Every h-th row: non-overlapping horizons."""
    return df.where(F.col(order) % h == 0) if h > 1 else df


def smoothed_rates(df: DataFrame, hit: str, key: str, bins: int, prior: float | None = None, strength: float = 20.0) -> DataFrame:
    """Hit rate per bin, shrunk to the overall rate; bins without rows have the prior."""
    spark = df.sparkSession
    total = df.agg(F.avg(F.col(hit).cast("double")).alias("prior")) if prior is None else spark.range(1).select(F.lit(float(prior)).alias("prior"))
    counted = df.groupBy(key).agg(F.sum(F.col(hit).cast("double")).alias("hits"), F.count(F.lit(1)).alias("n"))
    every = spark.range(bins).select(F.col("id").cast("int").alias(key)).join(counted, key, "left").fillna(0, ["hits", "n"]).join(F.broadcast(total))
    return every.select(key, "n", S.smoothed_rate("hits", "n", "prior", strength).alias("rate"))


def tod_profile(df: DataFrame, y: str, split: int, key: str = "tod") -> DataFrame:
    """Per unit and time of day: the mean before the split, as the prediction after it."""
    fit = df.where(F.col("step") < split).groupBy("unit", key).agg(F.avg(y).alias("profile"))
    return df.where(F.col("step") >= split).join(fit, ["unit", key], "left").select("unit", "step", F.col(y).alias("y"), "profile")


def event_after_event(df: DataFrame, event: str) -> DataFrame:
    """P(event), and given an event or none one step before (the first row counts as after none)."""
    e = df.select(F.col(event).alias("e"), F.lag(event, 1, False).over(along()).alias("before"))
    x = F.col("e").cast("double")
    return e.agg(F.avg(x).alias("p_event"), F.avg(F.when(F.col("before"), x)).alias("p_after_event"), F.avg(F.when(~F.col("before"), x)).alias("p_after_calm"))
