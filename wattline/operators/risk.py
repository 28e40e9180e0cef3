"""Trust in instruments, sheddable load and oversubscription limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions import scalars as S
from wattline.operators.panel import along
from wattline.operators.tail import usable

M, P, FLAG = "measured_power_util", "production_power_util", "bad_production_power_data"


def observability(df: DataFrame, flag: str = FLAG) -> DataFrame:
    """Share of readings that are not flagged."""
    return df.groupBy("unit").agg((1.0 - F.avg(F.col(flag).cast("double"))).alias("obs_score"), F.count(F.lit(1)).alias("n"))


def cappable_share(df: DataFrame, flag: str = FLAG) -> DataFrame:
    """Sheddable share of load on trusted readings; units without any are absent."""
    share = S.clip(S.ratio(F.col(M) - F.col(P), F.col(M)), 0.0)
    return df.where(~F.col(flag)).withColumn("_s", share).groupBy("unit").agg(F.avg("_s").alias("cappable_share"), F.stddev_samp("_s").alias("cappable_sd"), F.count(F.lit(1)).alias("n_trusted"))


def attribution_bound(df: DataFrame) -> DataFrame:
    """One row: the larger spread of cappable shares among clean and among mostly flagged units."""
    cs = cappable_share(df).join(observability(df).select("unit", "obs_score"), "unit")
    spread = lambda cond: F.coalesce(F.stddev_pop(F.when(cond, F.col("cappable_share"))), F.lit(0.0))
    return cs.agg(F.greatest(spread(F.col("obs_score") >= 0.999), spread(F.col("obs_score") < 0.5)).alias("lambda"))


def risk_table(df: DataFrame, fc: DataFrame) -> DataFrame:
    """Per unit: tail risk, trust, credit for sheddable load, limits and posture (blind, tight, degraded, ok)."""
    risk = usable(fc, "var", "es").groupBy("unit").agg(F.avg("var").alias("par_99"), F.avg("es").alias("cvar_99"), F.max("y").alias("peak_util"), F.avg("y").alias("mean_util"))
    t = risk.join(observability(df), "unit").join(cappable_share(df).select("unit", "cappable_share", "n_trusted"), "unit", "left").join(F.broadcast(attribution_bound(df)))
    credit = S.clip(F.coalesce("cappable_share", F.lit(0.0)) * F.col("obs_score") - F.col("lambda") * (1 - F.col("obs_score")), 0.0)
    t = t.withColumn("capping_credit", credit).withColumn("limit_raw", 1 / F.col("par_99") - 1).withColumn("limit_adj", (1 + F.col("capping_credit")) / F.col("par_99") - 1)
    t = t.withColumn("margin_cost", F.col("limit_adj") - F.col("limit_raw"))
    tight = t.agg(F.percentile("limit_adj", 0.25).alias("_tight"))
    posture = F.when(F.col("cappable_share").isNull(), "blind").when(F.col("limit_adj") < F.col("_tight"), "tight").when(F.col("obs_score") < 0.5, "degraded").otherwise("ok")
    return t.join(F.broadcast(tight)).withColumn("posture", posture).drop("_tight")


def frozen_rates(df: DataFrame, flags: tuple[str, ...] = ("bad_measurement_data", FLAG)) -> DataFrame:
    """For each flag and value: shares of physically impossible and of unchanged readings."""
    w = along()
    d = df.select(*flags, (F.col(M) < F.col(P)).cast("double").alias("v"), F.coalesce(F.col(M) == F.lag(M).over(w), F.lit(False)).cast("double").alias("f"))
    long = d.select("v", "f", F.explode(F.array(*(F.struct(F.lit(k).alias("flag"), F.col(k).alias("value")) for k in flags))).alias("k"))
    return long.groupBy("k.flag", "k.value").agg(F.avg("v").alias("p_violation"), F.avg("f").alias("p_frozen"), F.count(F.lit(1)).alias("n"))
