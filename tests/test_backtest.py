"""Backtests: closed forms, degenerate input, contrasts, Monte Carlo."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattline.functions import scalars as S
from wattline.operators import backtest as B


def counted(spark, exceed, unit="u"):
    e = np.asarray(exceed, bool)
    schema = "unit string, step long, y double, var double, es double, exceed boolean"
    pdf = pd.DataFrame({"unit": unit, "step": np.arange(len(e)), "y": np.where(e, 2.0, 0.5), "var": 1.0, "es": 1.5, "exceed": e})
    return B.counts(spark.createDataFrame(pdf, schema) if len(e) else spark.createDataFrame([], schema))


def test_exact_rate_has_no_likelihood_ratio(spark):
    r = B.kupiec(counted(spark, [i < 10 for i in range(1000)]), 0.99).first()
    assert abs(r.kupiec_lr) < 1e-6 and r.expected == pytest.approx(10)


def test_published_value(spark):
    c = B.p_values(B.conditional_coverage(counted(spark, [i % 25 == 0 for i in range(250)]), 0.99)).first()
    assert c.kupiec_lr == pytest.approx(12.9554911, abs=1e-5) and c.kupiec_p < 0.001
    assert c.cc_lr == pytest.approx(c.kupiec_lr + c.ind_lr)


def test_degenerate(spark):
    assert B.kupiec(counted(spark, []), 0.99).count() == 0
    none = B.es_z2(B.conditional_coverage(counted(spark, [False] * 500), 0.99), 0.99).first()
    assert np.isfinite(none.kupiec_lr) and none.es_z2 is None
    assert B.christoffersen(counted(spark, [True])).first().ind_lr is None


def test_clusters_show_in_order_only(spark):
    together, apart = [i < 50 for i in range(1000)], [i % 20 == 0 for i in range(1000)]
    a, b = (B.conditional_coverage(counted(spark, e), 0.95).first() for e in (together, apart))
    assert a.kupiec_lr == pytest.approx(b.kupiec_lr) and a.ind_lr > 100
    assert B.christoffersen(counted(spark, [0, 0, 1, 1] * 25)).first().ind_lr < 0.05


@pytest.mark.parametrize("hits, zone", [(0, "green"), (4, "green"), (5, "yellow"), (9, "yellow"), (10, "red"), (15, "red")])
def test_zones(spark, hits, zone):
    assert B.basel_zone(counted(spark, [i < hits for i in range(250)]), 0.99).first().basel_zone == zone


def test_zone_sees_the_last_window(spark):
    assert B.basel_zone(counted(spark, [True] * 50 + [False] * 250), 0.99).first().basel_zone == "green"


def test_shortfall_statistic(spark):
    rng = np.random.default_rng(1)
    loss, var, es = rng.standard_normal(50_000), 1.6448536, 2.0627128
    make = lambda e: spark.createDataFrame(pd.DataFrame({"unit": "u", "step": np.arange(len(loss)), "y": loss, "var": var, "es": e, "exceed": loss > var}))
    right, half = (B.es_z2(B.counts(make(e)), 0.95).first().es_z2 for e in (es, es / 2))
    assert abs(right) < 0.1 and half > 0.5
    p = B.es_p_values(make(es), 0.95, draws=200).first().es_p
    assert 0 <= p <= 1


def test_pools(spark):
    fc = spark.createDataFrame(pd.DataFrame({"unit": ["a"] * 4 + ["b"] * 4, "step": list(range(4)) * 2, "y": [0, 0, 0, 2.0, 2.0, 0, 0, 0], "var": 1.0, "es": 1.5, "anchor": 0.0}))
    whole = B.backtest_panel(fc, 0.9).where("unit = 'ALL/POOLED'").first()
    inside = B.backtest_panel(fc, 0.9, by_unit_pool=True).where("unit = 'ALL/POOLED'").first()
    assert whole.n11 == 1 and inside.n11 == 0  # only the pooled series runs over the units' border


def test_binomial(spark):
    df = spark.sql("SELECT 9L AS x, 250L AS n").select(S.binom_cdf("x", "n", 0.01).alias("p"))
    assert df.first().p == pytest.approx(0.99975, abs=1e-5)


@pytest.mark.parametrize("steps, recent", [(1, 250), (7, 5), (64, 250), (4096, 250)])
def test_segments_add_up_to_whole_series(spark, steps, recent):
    """Counts by segments of any length, with gaps in the steps, against plain series; and the pooled row."""
    rng = np.random.default_rng(5)
    plain, rows = {}, []
    for u, n in (("a", 300), ("b", 1), ("c", 4), ("d", 129)):
        at = np.sort(rng.choice(2 * n, n, replace=False))
        e = rng.random(n) < 0.4
        plain[u] = e
        rows += [(u, int(t), 1.0 if x else 0.0, 0.5, 0.8) for t, x in zip(at, e, strict=True)]
    b = B.breaches(spark.createDataFrame(rows, "unit string, step long, y double, var double, es double").repartition(5))

    def want(e):
        e = e.astype(int)
        pairs = list(zip(e[:-1], e[1:], strict=True))
        return (len(e), int(e.sum()), *(pairs.count((i, j)) for i in (0, 1) for j in (0, 1)), int(e[-recent:].sum()), min(recent, len(e)))

    cols = ("n", "x", "n00", "n01", "n10", "n11", "recent_x", "recent_n")
    got = {r.unit: r for r in B.counts(b, recent, steps).collect()}
    assert {u: tuple(r[c] for c in cols) for u, r in got.items()} == {u: want(e) for u, e in plain.items()}
    assert all(got[u].es_sum == pytest.approx(e.sum() / 0.8) for u, e in plain.items())
    pooled = B._with_pooled(b, recent=recent, steps=steps).where("unit = 'ALL/POOLED'").first()
    assert tuple(pooled[c] for c in cols) == want(np.concatenate([plain[u] for u in sorted(plain)]))


def test_no_window_orders_a_series(spark):
    """Windows run over segments and units: what is sorted for them has been grouped before."""
    rows = [("a", t, 1.0, 0.5, 0.8) for t in range(20)]
    b = B.breaches(spark.createDataFrame(rows, "unit string, step long, y double, var double, es double"))
    plan = B._with_pooled(b, steps=5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") >= 2 and plan.rindex("Window [") < plan.rindex("Aggregate [")


def test_poisson_table(spark):
    means = [0.01, 0.7, 3.0, 45.0, 300.0]
    got = {r.m: r.c for r in spark.createDataFrame([(m,) for m in means], "m double").select("m", B.poisson_cdf(F.col("m")).alias("c")).collect()}
    for m in means:
        p = np.exp([k * np.log(m) - m - math.lgamma(k + 1) for k in range(len(got[m]))])
        assert np.allclose(got[m], np.cumsum(p), rtol=1e-9, atol=1e-12) and got[m][-1] > 1 - 1e-9


def test_bootstrap_draws_by_hash(spark):
    """The whole draw by hand: hashes, Poisson weights, sums; the same in one partition and in many."""
    import hashlib

    rng = np.random.default_rng(3)
    rows = [(u, t, float(y), 1.0, 1.5) for u, n in (("a", 200), ("b", 90), ("none", 20)) for t, y in enumerate(np.where(rng.random(n) < (0.07 if u != "none" else 0), rng.uniform(1.0, 3.0, n) + 0.01, 0.5))]
    b = B.breaches(spark.createDataFrame(rows, "unit string, step long, y double, var double, es double"))
    got = {r.unit: r.es_p for r in B.es_p_values(b.repartition(6), 0.95, draws=60).collect()}
    assert got == {r.unit: r.es_p for r in B.es_p_values(b.coalesce(1), 0.95, draws=60).collect()}
    want = {}
    for u in ("a", "b"):
        mine = [r for r in rows if r[0] == u]
        hits = [(t, y / es) for _, t, y, var, es in mine if y > var]
        expected = len(mine) * (1 - 0.95)
        mean = expected / len(hits)
        cdf = np.cumsum(np.exp([k * np.log(mean) - mean - math.lgamma(k + 1) for k in range(60)]))
        null = [sum(ratio * (int(hashlib.md5(f"{u}/{t}/{d}".encode()).hexdigest()[:8], 16) / 2**32 >= cdf).sum() for t, ratio in hits) for d in range(1, 61)]
        want[u] = np.mean([s / expected - 1 >= sum(r for _, r in hits) / expected - 1 for s in null])
    assert got == pytest.approx(want)
