"""Coverage and expected-shortfall backtests of forecasts: counts in one aggregation, statistics as columns.

A breach is y > var. Transitions follow the order of unit and step; a pooled row runs over unit borders. Series are summed up by
segments of steps, and the summaries are joined: of segments to units, and of units to the pooled row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions import scalars as S
from wattline.operators.tail import usable


def breaches(fc: DataFrame) -> DataFrame:
    """unit, step, y, var, es, exceed."""
    return usable(fc, "var", "es").select("unit", "step", "y", "var", "es", (F.col("y") > F.col("var")).alias("exceed"))


RECENT = 250
#: Steps of a segment: its flags are the most that one row holds.
SEGMENT = 4096
_PAIRS = [(i, j) for i in (0, 1) for j in (0, 1)]


def segments(b: DataFrame, recent: int = RECENT, steps: int = SEGMENT) -> DataFrame:
    """A summary of each unit's breaches in each stretch of `steps` steps: counts, transitions, sum of shortfall ratios, the first and
    last flag, and the newest flags, newest first. Summaries of neighbours add up (see joined()), so no unit is ever ordered whole."""
    e = b.select("unit", "step", F.floor(F.col("step") / steps).alias("part"), F.col("exceed").cast("int").alias("e"), F.when(F.col("exceed"), F.col("y") / F.col("es")).otherwise(0.0).alias("ratio"))
    flags = F.transform(F.sort_array(F.collect_list(F.struct("step", "e"))), lambda s: s["e"])
    s = e.groupBy("unit", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("x"), F.sum("ratio").alias("es_sum"), flags.alias("_e"))
    moves = F.zip_with(F.expr("slice(_e, 1, size(_e) - 1)"), F.expr("slice(_e, 2, size(_e) - 1)"), lambda i, j: 2 * i + j)
    s = s.withColumn("_m", moves)
    many = {f"n{i}{j}": F.expr(f"CAST(size(filter(_m, m -> m = {2 * i + j})) AS long)") for i, j in _PAIRS}
    newest = F.reverse(F.expr(f"slice(_e, -least(size(_e), {recent}), least(size(_e), {recent}))"))
    return s.withColumns(many | {"_first": F.col("_e")[0], "_last": F.element_at("_e", -1), "_newest": newest}).drop("_e", "_m")


def joined(parts: DataFrame, group: str, order: str, recent: int = RECENT) -> DataFrame:
    """The summary of each group whose parts follow each other in `order`: counts add up, a transition comes in at each border, and the
    newest flags are those of the last parts. An ordered window has a row for each part."""
    w, back = Window.partitionBy(group).orderBy(order), Window.partitionBy(group).orderBy(F.col(order).desc())
    newer = F.coalesce(F.sum("n").over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    p = parts.withColumns({"_before": F.lag("_last").over(w), "_take": F.greatest(F.lit(0), F.least(F.col("n"), F.lit(recent) - newer)).cast("int")})
    border = lambda i, j: F.when((F.col("_before") == i) & (F.col("_first") == j), 1).otherwise(0)
    last = F.sort_array(F.collect_list(F.when(F.col("_take") > 0, F.struct(F.col(order).alias("o"), F.expr("slice(_newest, 1, _take)").alias("f")))), asc=False)
    return p.groupBy(group).agg(
        F.sum("n").alias("n"), F.sum("x").alias("x"), *(F.sum(F.col(f"n{i}{j}") + border(i, j)).alias(f"n{i}{j}") for i, j in _PAIRS), F.sum("es_sum").alias("es_sum"),
        F.min_by("_first", order).alias("_first"), F.max_by("_last", order).alias("_last"), F.flatten(F.transform(last, lambda s: s["f"])).alias("_newest"),
    )


def _units(b: DataFrame, recent: int = RECENT, steps: int = SEGMENT) -> DataFrame:
    """Per unit: the counts, and what pooling needs of its ends: first and last breach flag, and the newest flags, newest first."""
    u = joined(segments(b, recent, steps), "unit", "part", recent)
    return u.withColumns({"recent_x": F.aggregate("_newest", F.lit(0).cast("long"), lambda a, x: a + x), "recent_n": F.size("_newest").cast("long")})


def counts(b: DataFrame, recent: int = RECENT, steps: int = SEGMENT) -> DataFrame:
    """Per unit: n, x, transitions n00..n11, breaches and size of the most recent window, and the ES sum."""
    return _units(b, recent, steps).drop("_first", "_last", "_newest")


COUNTS = ("n", "x", "n00", "n01", "n10", "n11", "recent_x", "recent_n", "es_sum")


def _with_pooled(b: DataFrame, by_unit_pool: bool = False, recent: int = RECENT, steps: int = SEGMENT) -> DataFrame:
    """counts() of each unit, and of all units as one series in order of unit and step: the units' own counts, and one
    transition for each border between units (or none with by_unit_pool). Only a row per unit meets in one window, and the
    series are read once."""
    u = _units(b, recent, steps).withColumn("_all", F.lit(1))
    w, back = Window.partitionBy("_all").orderBy("unit"), Window.partitionBy("_all").orderBy(F.col("unit").desc())
    newer = F.coalesce(F.sum("n").over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    u = u.withColumns({"_before": F.lag("_last").over(w), "_take": F.greatest(F.lit(0), F.least(F.col("n"), F.lit(recent) - newer)).cast("int")})
    share = {c: F.col(c) for c in COUNTS}
    if not by_unit_pool:
        border = lambda i, j: F.when((F.col("_before") == i) & (F.col("_first") == j), 1).otherwise(0)
        share |= {f"n{i}{j}": F.col(f"n{i}{j}") + border(i, j) for i in (0, 1) for j in (0, 1)}
        share |= {"recent_x": F.aggregate(F.slice("_newest", F.lit(1), F.col("_take")), F.lit(0), lambda a, x: a + x), "recent_n": F.col("_take")}
    row = lambda unit, of: F.struct(unit.alias("unit"), *(of[c].cast("double" if c == "es_sum" else "long").alias(c) for c in COUNTS))
    both = u.select(F.explode(F.array(row(F.col("unit"), {c: F.col(c) for c in COUNTS}), row(F.lit("ALL/POOLED"), share))).alias("r")).select("r.*")
    return both.groupBy("unit").agg(*(F.sum(c).alias(c) for c in COUNTS))


def pooled_counts(b: DataFrame, recent: int = RECENT) -> DataFrame:
    """counts() of all units as one series."""
    return _with_pooled(b, recent=recent).where("unit = 'ALL/POOLED'")


def kupiec(c: DataFrame, alpha: float) -> DataFrame:
    """Is the breach rate right? Likelihood ratio against 1 - alpha; null for no rows."""
    p, n, x = 1.0 - alpha, F.col("n"), F.col("x")
    lr = -2.0 * ((n - x) * math.log1p(-p) + x * math.log(p) - (S.xlogx(n - x) + S.xlogx(x) - S.xlogx(n)))
    return c.withColumns({"expected": n * p, "rate": S.ratio(x, n), "kupiec_lr": F.when(n > 0, lr)})


def christoffersen(c: DataFrame) -> DataFrame:
    """Do breaches cluster? First-order Markov chain against one rate; null for fewer than two rows."""
    a, b, d, e = (F.col(f"n{i}{j}") for i in (0, 1) for j in (0, 1))
    one = S.xlogx(a + d) + S.xlogx(b + e) - S.xlogx(a + b + d + e)
    two = S.xlogx(a) + S.xlogx(b) - S.xlogx(a + b) + S.xlogx(d) + S.xlogx(e) - S.xlogx(d + e)
    return c.withColumn("ind_lr", F.when(F.col("n") >= 2, F.greatest(F.lit(0.0), -2.0 * (one - two))))


def conditional_coverage(c: DataFrame, alpha: float) -> DataFrame:
    both = christoffersen(kupiec(c, alpha))
    return both.withColumn("cc_lr", F.col("kupiec_lr") + F.col("ind_lr")).withColumn("cc_p", S.chi2_sf2("cc_lr"))


def p_values(c: DataFrame) -> DataFrame:
    return c.withColumns({"kupiec_p": S.chi2_sf1("kupiec_lr"), "ind_p": S.chi2_sf1("ind_lr")})


def basel_zone(c: DataFrame, alpha: float) -> DataFrame:
    """Traffic light of the most recent window by its binomial probability."""
    cum = S.binom_cdf("recent_x", "recent_n", 1.0 - alpha)
    return c.withColumn("cum_prob", cum).withColumn("basel_zone", F.when(cum < 0.95, "green").when(cum < 0.9999, "yellow").otherwise("red"))


def es_z2(c: DataFrame, alpha: float) -> DataFrame:
    """Is the shortfall understated (above 0)? Null without breaches."""
    return c.withColumn("es_z2", F.when(F.col("x") > 0, F.col("es_sum") / (F.col("n") * (1.0 - alpha)) - 1.0))


#: Draws of the bootstrap.
DRAWS = 400


def poisson_cdf(mean: Column) -> Column:
    """Array of P(X <= k) for k = 0, 1, ... of a Poisson variable, as far as 32 bits can tell from 1."""
    last = F.ceil(mean + 10 * F.sqrt(mean) + 10).cast("int")
    start = F.struct(F.array(F.exp(-mean)).alias("cdf"), F.exp(-mean).alias("p"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        return F.struct(F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + p)).alias("cdf"), p.alias("p"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["cdf"])


def es_p_values(b: DataFrame, alpha: float, draws: int = DRAWS) -> DataFrame:
    """Bootstrap p-values of es_z2 per unit: how often a draw's is at least as large. Units without breaches have none.

    A Poisson bootstrap: in every draw a breach counts a Poisson number of times, whose mean makes the expected number of breaches
    n (1 - alpha); so the number of breaches varies as by chance and their ratios come from those seen. The number is read off a hash
    of unit, step and draw, which makes it one aggregation, the same wherever and however often it runs."""
    p = 1.0 - alpha
    hits = b.where("exceed").select("unit", "step", (F.col("y") / F.col("es")).alias("ratio"))
    sizes = b.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("exceed").cast("long")).alias("x"), F.sum(F.when(F.col("exceed"), F.col("y") / F.col("es"))).alias("seen")).where("x > 0")
    sizes = sizes.withColumn("cdf", poisson_cdf(F.col("n") * p / F.col("x")))
    drawn = hits.join(sizes.select("unit", "cdf"), "unit").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    part = F.conv(F.substring(F.md5(F.concat_ws("/", "unit", "step", "draw")), 1, 8), 16, 10).cast("double") / 4294967296.0
    times = F.size(F.filter("cdf", lambda c: F.col("_at") >= c))
    sums = drawn.withColumn("_at", part).groupBy("unit", "draw").agg(F.sum(times * F.col("ratio")).alias("sum"))
    z2 = lambda s: F.col(s) / (F.col("n") * p) - 1.0
    return sums.join(sizes.select("unit", "n", "seen"), "unit").groupBy("unit").agg(F.avg((z2("sum") >= z2("seen")).cast("double")).alias("es_p"))


def backtest_panel(fc: DataFrame, alpha: float, bootstrap: bool = False, by_unit_pool: bool = False, steps: int = SEGMENT) -> DataFrame:
    """Every test per unit, and a pooled row. The pooled row's transitions run over unit borders and its recent window is the
    last unit's (parity); by_unit_pool adds up the units' own transitions instead."""
    b = breaches(fc)
    out = es_z2(basel_zone(conditional_coverage(_with_pooled(b, by_unit_pool, steps=steps), alpha), alpha), alpha)
    return out.join(es_p_values(b, alpha), "unit", "left") if bootstrap else out


def clustering_stats(fc: DataFrame, alpha: float, steps: int = SEGMENT) -> DataFrame:
    """Breach probability after none and after one, over the pooled series; units whose coverage passes."""
    table = backtest_panel(fc, alpha, steps=steps)
    whole, units = table.where("unit = 'ALL/POOLED'"), table.where("unit != 'ALL/POOLED'")
    p01, p11 = F.col("n01") / F.greatest(F.lit(1), F.col("n00") + F.col("n01")), F.col("n11") / F.greatest(F.lit(1), F.col("n10") + F.col("n11"))
    passed = units.agg(F.sum((F.col("cc_p") > 0.05).cast("int")).alias("cc_pass"), F.count(F.lit(1)).alias("n_units"))
    return whole.select("rate", p01.alias("p01"), p11.alias("p11"), S.ratio(p11, p01).alias("ratio")).join(F.broadcast(passed))
