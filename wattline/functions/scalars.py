"""Scalar functions and small predicates of the trace queries, as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattline import constants as C

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tier(priority: ColumnOrName) -> Column:
    """Four bands; what no band holds, null included, is the last."""
    p, out = _c(priority), None
    for low, high, name in C.TIER_BANDS:
        out = F.when(p.between(low, high), name) if out is None else out.when(p.between(low, high), name)
    return out.otherwise(C.OTHER_TIER)


def two_way_tier(priority: ColumnOrName) -> Column:
    return F.when(_c(priority) < C.CAPPABLE_BELOW, "cappable").otherwise("production")


def top_level(alloc: ColumnOrName = "alloc_collection_id") -> Column:
    """Not in an alloc set: null or the sentinel."""
    return _c(alloc).isNull() | (_c(alloc) == C.NO_ALLOC)


def whole_sample(start: str = "start_time", end: str = "end_time") -> Column:
    return (F.col(end) - F.col(start)) >= C.MIN_SAMPLE_US


def bucket(time: ColumnOrName, width: int) -> Column:
    """Index of a time bucket, rounding down for negative times too."""
    return F.floor(_c(time) / F.lit(float(width))).cast("long")


def rounded_long(x: ColumnOrName) -> Column:
    """Float to integer by rounding half away from zero (a plain cast would cut)."""
    return F.round(_c(x)).cast("long")


def histogram_bin(x: ColumnOrName) -> Column:
    """Two roundings: to steps of 1e-4, then to three decimals."""
    return F.round(rounded_long(_c(x) / 0.0001) * F.lit(0.0001), 3)


def xlogx(x: ColumnOrName) -> Column:
    x = _c(x).cast("double")
    return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))


def finite(x: ColumnOrName) -> Column:
    """Null for NaN and infinities."""
    x = _c(x)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def ratio(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Null where the divisor is zero."""
    return F.try_divide(_c(a), _c(b))


def clip(x: ColumnOrName, low: float | None = None, high: float | None = None) -> Column:
    """Null stays null."""
    x = _c(x)
    if low is not None:
        x = F.when(x < low, F.lit(low)).otherwise(x)
    return F.when(x > high, F.lit(high)).otherwise(x) if high is not None else x


def smoothed_rate(hits: ColumnOrName, n: ColumnOrName, prior: ColumnOrName, strength: float = 20.0) -> Column:
    return (_c(hits) + strength * _c(prior)) / (_c(n) + strength)


def binom_cdf(x: ColumnOrName, n: ColumnOrName, p: float) -> Column:
    """P(X <= x), by the recurrence of the terms in logarithms."""
    x, n = _c(x), _c(n).cast("double")
    odds = math.log(p / (1 - p))
    first = F.struct((n * math.log1p(-p)).alias("term"), F.exp(n * math.log1p(-p)).alias("total"))

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] + F.log((n - k + 1) / k) + odds
        return F.struct(term.alias("term"), (acc["total"] + F.exp(term)).alias("total"))

    terms = F.when(x >= 1, F.sequence(F.lit(1).cast("long"), x.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.least(F.lit(1.0), F.aggregate(terms, first, add, lambda acc: acc["total"]))


def chi2_sf2(x: ColumnOrName) -> Column:
    return F.exp(-_c(x) / 2)


#: Chebyshev coefficients of the complementary error function (fractional error below 1.2e-7 everywhere): fixed values.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(z: ColumnOrName) -> Column:
    """Complementary error function of a number that is not negative."""
    z = _c(z).cast("double")
    t = 1 / (1 + z / 2)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-z * z + poly)


def chi2_sf1(x: ColumnOrName) -> Column:
    """Upper tail of chi-squared with one degree of freedom, and so the two-sided p of a normal z with x = z * z."""
    x = _c(x).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), F.least(F.lit(1.0), erfc(F.sqrt(F.greatest(x, F.lit(0.0)) / 2))))


def enum_name(code: ColumnOrName, kind: str) -> Column:
    """The name of a code; null for codes that the enumeration does not have."""
    names = C.ENUMS[kind]
    table = F.create_map(*(F.lit(v) for i, n in enumerate(names) for v in (i, n)))
    return F.try_element_at(table, _c(code).cast("int"))


def constraint_holds(relation: ColumnOrName, wanted: ColumnOrName, value: ColumnOrName, present: ColumnOrName) -> Column:
    """Equality compares text, order compares numbers (never true if either is none), presence ignores the value."""
    r, w, v, there = (_c(x) for x in (relation, wanted, value, present))
    a, b = v.try_cast("double"), w.try_cast("double")
    ordered = F.when(r == 2, a < b).when(r == 3, a > b).when(r == 4, a <= b).when(r == 5, a >= b)
    held = F.when(r == 0, there & v.eqNullSafe(w)).when(r == 1, ~(there & v.eqNullSafe(w))).when(r == 6, there).when(r == 7, ~there).otherwise(there & ordered)
    return F.coalesce(held, F.lit(False))


def quantile_points(column: ColumnOrName, n: int = 100, accuracy: int = 10_000) -> Column:
    """Approximate quantiles 0..n as an array of n + 1."""
    return F.percentile_approx(_c(column), [i / n for i in range(n + 1)], accuracy)


def exact_quantiles(column: ColumnOrName, points: Iterable[float]) -> Column:
    """Quantiles by linear interpolation, as an array."""
    return F.percentile(_c(column), [float(p) for p in points])
