"""Quantile sketches as data: one per group, stored like any column, and merged into those of larger groups.

A sketch of a cell's hour is a few kilobytes whatever it has seen. Days, weeks and cells are merges of hours, so a distribution over
any span is read from the sketches and never from the readings again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.operators.ranked import running

#: Size of a sketch: ranks are off by about a thousandth of the rows, merges included.
K = 2000


def sketched(df: DataFrame, keys: Sequence[str | Column], columns: Sequence[str], k: int = K) -> DataFrame:
    """A sketch of each column (double) for each group of `keys`, under the column's name. Nulls are left out; a column that is all
    null in a group has a sketch of nothing."""
    return df.groupBy(*keys).agg(*(F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(k)).alias(c) for c in columns))


def merged(sketches: DataFrame, keys: Sequence[str | Column], columns: Sequence[str], k: int = K) -> DataFrame:
    """The sketches of larger groups, from those of smaller ones."""
    return sketches.groupBy(*keys).agg(*(F.kll_merge_agg_double(F.col(c), F.lit(k)).alias(c) for c in columns))


def points(sketches: DataFrame, keys: Sequence[str], columns: Sequence[str], n: int = 100) -> DataFrame:
    """keys, label, i, y (rank share), x (value), size: n + 1 quantiles of each sketch that has seen something."""
    ranks = F.array(*(F.lit(i / n) for i in range(n + 1)))
    each = F.array(*(F.struct(F.lit(c).alias("label"), F.col(c).alias("s"), F.kll_sketch_get_n_double(c).alias("size")) for c in columns))
    rows = sketches.select(*keys, F.explode(each).alias("e")).select(*keys, "e.*").where("size > 0")
    return rows.select(*keys, "label", "size", F.posexplode(F.kll_sketch_get_quantile_double("s", ranks)).alias("i", "x")).select(*keys, "label", "i", (F.col("i") / n).alias("y"), "x", "size")


def rank_errors(quantiles: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """points() over all rows with `error`: how far the share of rows below the value, or up to and with it, is from y (0 if y lies
    between). A sketch's quantiles are values it has seen, so they meet the rows' counts by equality."""
    each = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.col(c).cast("double").alias("x")) for c in columns))).alias("e")).select("e.*").where("x IS NOT NULL")
    counts = running(each.groupBy("label", "x").agg(F.count(F.lit(1)).alias("c")), "x", {"upto": F.col("c")}, ["label"])
    share = lambda c: F.col(c) / F.col("size")
    met = quantiles.join(counts, ["label", "x"], "left").withColumn("below", F.col("upto") - F.col("c"))
    return met.withColumn("error", F.greatest(F.lit(0.0), F.col("y") - share("upto"), share("below") - F.col("y"))).drop("upto", "c", "below")
