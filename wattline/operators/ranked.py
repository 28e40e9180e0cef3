"""Running totals and exact quantiles over whole tables, without a window that one task would have to hold.

Rows are cut into ranges of the ordering value; a range's total is its offset, and only inside a range do rows meet
in an ordered window. The cuts come from a sketch: they decide how even the ranges are, never a result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def cuts(df: DataFrame, order: str, n: int = RANGES) -> list[float]:
    """At most n - 1 values that part `order` (numeric) about evenly."""
    found = df.agg(F.percentile_approx(order, [i / n for i in range(1, n)], 20 * n)).first()[0]
    return sorted({float(v) for v in found or [] if v == v})


def range_of(order: str, at: Sequence[float]) -> Column:
    """Number of cuts at or below the value: a comparison for each bit of the number."""
    x = F.col(order).cast("double")

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(x < at[mid], search(low, mid)).otherwise(search(mid + 1, high))

    return search(0, len(at))


def running(df: DataFrame, order: str, sums: Mapping[str, Column], keys: Sequence[str] = (), n: int = RANGES) -> DataFrame:
    """df with the sum of each column over the rows up to and with this one, in order of `order` (numeric, distinct within
    `keys`). Rows are to be pre-aggregated by `order`, so that a range holds no value twice."""
    d = df.withColumn("_range", range_of(order, cuts(df, order, n))).withColumns({f"_v_{k}": c for k, c in sums.items()})
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    totals = d.groupBy(*keys, "_range").agg(*(F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums))
    totals = totals.select(*(F.col(k).alias(f"_key_{i}") for i, k in enumerate([*keys, "_range"])), *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums))
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    same = [d[k].eqNullSafe(totals[f"_key_{i}"]) for i, k in enumerate([*keys, "_range"])]
    return d.join(totals, same).select(*df.columns, *((F.sum(f"_v_{k}").over(inside) + F.col(f"_o_{k}")).alias(k) for k in sums))


def quantiles(df: DataFrame, x: str, probs: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one row for each of `probs`: i (its place), value. Nulls are left out;
    no rows, no quantiles."""
    values = df.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    total = values.agg(F.sum("_n").alias("_total"))
    upto = running(values, "_x", {"_upto": F.col("_n")}).join(F.broadcast(total))
    wanted = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("_total") - 1)
        for side, rank in (("low", F.floor(at)), ("high", F.ceil(at))):
            here = (rank >= F.col("_upto") - F.col("_n")) & (rank < F.col("_upto"))
            wanted.append(F.when(here, F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), (at - F.floor(at)).alias("part"))))
    hits = upto.select("_x", F.explode(F.filter(F.array(*wanted), lambda w: w.isNotNull())).alias("w")).select("_x", "w.*")
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("_x")))
    return hits.groupBy("i").agg((side("low") + F.max("part") * (side("high") - side("low"))).alias("value"))


#: Rank error of the sketch behind quantiles_by(), as one over so many rows.
ACCURACY = 2000


def quantiles_by(df: DataFrame, keys: Sequence[str], x: str, named: Mapping[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """Exact quantiles with linear interpolation for each group of `keys`: a row for each, with a column for each name.

    A sketch of each group brackets the ranks that are wanted, within its error; one more pass counts what is below a bracket and
    the distinct values inside. So what is ordered is a few thousandths of a group, never the group, and the sketch
    decides how much that is, never a result (a rank outside its bracket is an error). Nulls are left out, and groups without
    values; null keys are a group. `df` is read twice: write it first if it is dear."""
    margin, probs = 2.0 / accuracy, list(named.values())
    d = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"))
    ends = F.percentile_approx("_x", [v for p in probs for v in (max(0.0, p - margin), min(1.0, p + margin))], accuracy)
    cut = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), ends.alias("_ends"), F.min("_x").alias("_min"), F.max("_x").alias("_max"))
    # The outermost brackets end at the extremes; in a group of no more than `accuracy` rows, all do: there a rank is more than the error.
    small = F.col("_n") <= accuracy
    low = lambda i, p: F.when(small | F.lit(p <= margin), F.col("_min")).otherwise(F.col("_ends")[2 * i])
    high = lambda i, p: F.when(small | F.lit(p >= 1 - margin), F.col("_max")).otherwise(F.col("_ends")[2 * i + 1])
    wanted = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"), low(i, p).alias("low"), high(i, p).alias("high")) for i, p in enumerate(probs)))
    cut = cut.select(*(F.col(k).alias(f"_key_{j}") for j, k in enumerate(keys)), "_n", wanted.alias("_w"))
    met = d.join(cut, [d[k].eqNullSafe(cut[f"_key_{j}"]) for j, k in enumerate(keys)]) if keys else d.crossJoin(F.broadcast(cut))
    inside = met.select(*keys, "_n", "_x", F.explode("_w").alias("w")).select(*keys, "_n", "_x", "w.*").where("_x <= high")
    values = inside.groupBy(*keys, "i", "p", "_n", F.when(F.col("_x") >= F.col("low"), F.col("_x")).alias("v")).agg(F.count(F.lit(1)).alias("c"))  # all that is below is one row
    upto = F.sum("c").over(Window.partitionBy(*keys, "i").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    at = F.col("p") * (F.col("_n") - 1)
    side = lambda rank: F.max(F.when((rank >= F.col("upto") - F.col("c")) & (rank < F.col("upto")) & F.col("v").isNotNull(), F.col("v")))
    part = F.max(at - F.floor(at))
    found = values.withColumn("upto", upto).groupBy(*keys, "i").agg(side(F.floor(at)).alias("low"), side(F.ceil(at)).alias("high"), part.alias("part"))
    value = F.when(F.col("low").isNull() | F.col("high").isNull(), F.raise_error("a rank lies outside its bracket").cast("double")).otherwise(F.col("low") + F.col("part") * (F.col("high") - F.col("low")))
    found = found.withColumn("value", value)
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("i") == i, F.col("value"))).alias(name) for i, name in enumerate(named)))


def quantile_row(df: DataFrame, x: str, named: Mapping[str, float]) -> DataFrame:
    """One row with a column for each named quantile; nulls for no rows."""
    q = quantiles(df, x, list(named.values()))
    return q.agg(*(F.max(F.when(F.col("i") == i, F.col("value"))).alias(k) for i, k in enumerate(named)))
