"""Rolling tails, forecasts, calibration: known values, causality by corruption, an independent numpy version."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattline.operators import panel as W
from wattline.operators import tail as T

WINDOW, VOL = 48, 12


def panel(spark, y, units=2):
    pdf = pd.DataFrame({"unit": np.repeat([f"a/pdu{u}" for u in range(units)], len(y)), "step": np.tile(np.arange(len(y)), units), "y": np.concatenate([np.roll(y, 7 * u) for u in range(units)])})
    return spark.createDataFrame(pdf)


def series(n=200, seed=7):
    return np.random.default_rng(seed).uniform(0.4, 0.9, n)


def collected(df, *cols):
    return df.orderBy("unit", "step").select("unit", "step", *cols).toPandas()


def test_rank_convention():
    assert [T.rank_in_window(a, 2016) for a in (0.95, 0.99, 0.999)] == [1915, 1995, 2013]


@pytest.mark.parametrize("alpha", [0.5, 0.95, 0.999])
@pytest.mark.parametrize("block", [None, 48, 64])
def test_rolling_tail_matches_sorting(spark, alpha, block):
    y = series()
    got = collected(T.rolling_tail(panel(spark, y, 1), "y", alpha, WINDOW, block=block), "q", "es")
    k = math.ceil(alpha * WINDOW) - 1
    assert len(got) == len(y)
    for t in range(len(y)):
        if t < WINDOW - 1:
            assert np.isnan(got.q[t])
            continue
        s = np.sort(y[t - WINDOW + 1 : t + 1])
        assert got.q[t] == s[k]
        assert got.es[t] == pytest.approx(s[k + 1 :].mean() if k + 1 < WINDOW else s[k], abs=1e-12)


def test_nan_sorts_last_and_spoils_only_the_mean():
    x = np.r_[np.arange(9.0), np.nan]
    q, es = T.tail_kernel(x, 0.5, 10)
    assert q[-1] == 4.0 and np.isnan(es[-1])
    q, es = T.tail_kernel(np.full(3, 1.0), 0.9, 10)
    assert np.isnan(q).all() and np.isnan(es).all()


@pytest.mark.parametrize("model", sorted(T.MODELS))
def test_forecasts_use_only_the_past(spark, model):
    y, k = series(160), 120
    bad = y.copy()
    bad[k] = 99.0
    a, b = (collected(T.forecast_panel(panel(spark, v, 1), "y", model, 0.9, WINDOW, VOL), "var", "es") for v in (y, bad))
    assert np.array_equal(a["var"][: k + 1], b["var"][: k + 1], equal_nan=True) and np.array_equal(a.es[: k + 1], b.es[: k + 1], equal_nan=True)
    assert not np.array_equal(a["var"][k + 1 :], b["var"][k + 1 :], equal_nan=True)


@pytest.mark.parametrize("h", [1, 3, 12])
def test_horizon_forecasts_look_h_steps_back(spark, h):
    y, k = series(200), 150
    bad = y.copy()
    bad[k] = 99.0
    a, b = (collected(T.fhs_horizon(panel(spark, v, 1), "y", 0.9, h, WINDOW, VOL), "var") for v in (y, bad))
    assert np.array_equal(a["var"][: k + h], b["var"][: k + h], equal_nan=True)
    assert a["var"][k + h] != b["var"][k + h]


def test_fhs_matches_a_plain_version(spark):
    y = series(160)
    got = collected(T.fhs(panel(spark, y, 1), "y", 0.9, WINDOW, VOL), "var", "es")
    s = pd.Series(y)
    d = s.diff()
    sigma = d.shift(1).rolling(VOL).std()
    z = (d / sigma).shift(1)
    k = math.ceil(0.9 * WINDOW) - 1
    for t in range(120, 160):
        w = np.sort(z[t - WINDOW + 1 : t + 1])
        assert got["var"][t] == pytest.approx(y[t - 1] + sigma[t] * w[k], abs=1e-9)
        assert got.es[t] == pytest.approx(y[t - 1] + sigma[t] * w[k + 1 :].mean(), abs=1e-9)


def test_horizon_one_is_fhs(spark):
    p = panel(spark, series(160))
    a, b = collected(T.fhs(p, "y", 0.9, WINDOW, VOL), "var"), collected(T.fhs_horizon(p, "y", 0.9, 1, WINDOW, VOL), "var")
    assert np.array_equal(a["var"], b["var"], equal_nan=True)


def test_stuck_readings_give_no_number(spark):
    y = np.r_[series(80), np.full(80, 0.5)]
    got = collected(T.fhs(panel(spark, y, 1), "y", 0.9, WINDOW, VOL), "var")
    assert not np.isinf(got["var"]).any()


def test_multiplier_scales_the_spread(spark):
    fc = T.usable(T.fhs(panel(spark, series(160)), "y", 0.9, WINDOW, VOL), "var")
    wide = collected(T.apply_multiplier(fc, 2.0), "var", "anchor")
    base = collected(fc, "var", "anchor")
    assert np.allclose(wide["var"] - wide.anchor, 2 * (base["var"] - base.anchor))
    assert np.allclose(collected(T.apply_multiplier(fc, 1.0), "var")["var"], base["var"])


def test_calibration_equals_bisection(spark):
    fc = T.usable(T.fhs(panel(spark, series(400), 3), "y", 0.8, WINDOW, VOL), "var", "anchor")
    fc = fc.withColumn("var", F.greatest("var", F.col("anchor") + 0.001))
    got = T.calibrate(fc, 0.8, 250).first()
    pdf = fc.toPandas()
    tr, te = pdf[pdf.step < 250], pdf[pdf.step >= 250]
    rate = lambda x, m: (x.y > x.anchor + m * (x["var"] - x.anchor)).mean()
    lo, hi = 0.5, 4.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if rate(tr, mid) > 0.2 + 1e-12 else (lo, mid)
    assert got.m == pytest.approx(hi, abs=1e-9)
    assert (got.n_train, got.n_test) == (len(tr), len(te)) and got.raw_test == pytest.approx(rate(te, 1.0))


def test_trailing_needs_a_full_window(spark):
    p = panel(spark, series(30), 1)
    got = collected(p.withColumn("m", W.trailing("avg", "y", 10)), "m")
    assert got.m[:10].isna().all() and got.m[10:].notna().all()


def test_features_do_not_see_the_present(spark):
    y = series(120)
    bad = y.copy()
    bad[90] = 99.0
    out = []
    for v in (y, bad):
        p = panel(spark, v, 1).withColumn("p", F.col("y") / 2).withColumn("ts", F.expr("timestampadd(MINUTE, CAST(step AS int) * 5, TIMESTAMP_NTZ'2019-05-01 00:00:00')"))
        out.append(collected(W.unit_features(p, "y", "p", 12, 24), "lag_1", "roll_mean_1h", "roll_std_1d", "prod_lag_1", "headroom_lag_1", "vol_ratio"))
    a, b = out
    assert a.iloc[:91].equals(b.iloc[:91]) and not a.iloc[91:].equals(b.iloc[91:])


def test_gap_is_an_error(spark):
    p = panel(spark, series(5), 1).withColumn("y", F.when(F.col("step") != 2, F.col("y")))
    with pytest.raises(ValueError):
        W.require_dense(p, ["y"])


@pytest.mark.parametrize("every", [1, 3, 50])
@pytest.mark.parametrize("window", [1, 2, 7, 40])
def test_kernels_match_sorting_with_ties_and_nan(window, every):
    """Both ways through a series, against sorting each window: NaN last, then the mean of what is above the rank."""
    rng = np.random.default_rng(window)
    x = rng.integers(0, 6, 300).astype(float)
    x[rng.random(300) < 0.05] = np.nan
    x[100:150] = 3.0
    x[200] = np.inf
    alphas, wanted = (0.05, 0.5, 0.9, 0.999, 1.0), np.arange(300) % every == 0
    q, es = T.tail_kernels(x, alphas, window, wanted)
    ways = []
    for way in (T._parted, T._slid):
        a, b = np.full((5, 300), np.nan), np.full((5, 300), np.nan)
        way(x, [T.rank_in_window(v, window) for v in alphas], window, np.flatnonzero(wanted[window - 1 :]) + window - 1, a, b)
        ways.append((a, b))
    for t in range(300):
        for i, alpha in enumerate(alphas):
            k = T.rank_in_window(alpha, window)
            want = (np.nan, np.nan)
            if wanted[t] and t >= window - 1:
                s = np.sort(x[t - window + 1 : t + 1])
                want = s[k], s[k + 1 :].mean() if k + 1 < window else s[k]
            for a, b in [(q, es), *ways]:
                assert np.allclose([a[i, t], b[i, t]], want, rtol=1e-12, equal_nan=True)


def test_sliding_costs_little_more_for_longer_windows():
    import time

    x, took = np.random.default_rng(0).normal(size=60_000), []
    for window in (500, 20_000):
        began = time.process_time()
        T.tail_kernels(x, (0.999,), window)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 1


def long_unit(spark, n=6400):
    """One unit of n steps, and a short one."""
    y = "0.6D + 0.1D * sin(step / 9D) + 0.05D * (pmod(xxhash64(u, step), 2001) - 1000) / 1000D"
    both = spark.range(n).selectExpr("'a/long' AS u", "id AS step").union(spark.range(90).selectExpr("'b/short' AS u", "id AS step"))
    return both.selectExpr("u AS unit", "step", f"{y} AS y").selectExpr("*", "y / 2 AS p", "timestampadd(MINUTE, CAST(step AS int) * 5, TIMESTAMP_NTZ'2019-05-01 00:00:00') AS ts")


def assert_same(a, b):
    a, b = (x.orderBy("unit", "step").toPandas() for x in (a, b))
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        same = a[c].equals(b[c]) if a[c].dtype == object else np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True)
        assert same, c


FORMS = {
    "lag_diff_features": lambda d, b: W.lag_diff_features(d, "y", block=b),
    "trailing_stats": lambda d, b: W.trailing_stats(d, "y", 6, 20, b),
    "unit_features": lambda d, b: W.unit_features(d, "y", "p", 6, 20, block=b),
    "ar1_slope": lambda d, b: W.ar1_slope(d.select("unit", "step", "y"), "y", 30, block=b),
    "empirical": lambda d, b: T.empirical(d, "y", 0.9, 30, 10, b),
    "fhs": lambda d, b: T.fhs(d, "y", 0.9, 30, 10, b),
    "fhs_ar": lambda d, b: T.fhs_ar(d, "y", 0.9, 30, 10, b),
    "fhs_horizon": lambda d, b: T.fhs_horizon(d, "y", 0.9, 7, 30, 10, b),
}


@pytest.mark.parametrize("name", sorted(FORMS))
@pytest.mark.parametrize("block", [37, 1000])
def test_blocks_change_nothing(spark, name, block):
    """Blocks shorter and longer than what the windows reach back to, against whole units."""
    d = long_unit(spark, 1500)
    assert_same(FORMS[name](d, block), FORMS[name](d, 0))


def test_limit_forecasts_in_blocks(spark):
    d = long_unit(spark, 1500)
    a, b = (T.horizon_forecasts(d, "y", (1, 3, 7), (0.9, 0.99), 30, 10, block).orderBy("h", "alpha", "unit", "step").toPandas() for block in (64, 0))
    assert len(a) == len(b) and np.allclose(a.select_dtypes("number"), b.select_dtypes("number"), equal_nan=True)
    one = T.fhs_horizon(d, "y", 0.9, 7, 30, 10, 0).where("step % 7 = 0").orderBy("unit", "step").toPandas()
    mine = a[(a.h == 7) & (a.alpha == 0.9)].reset_index(drop=True)
    assert np.allclose(one["var"].astype(float), mine["var"], equal_nan=True) and np.allclose(one["es"].astype(float), mine["es"], equal_nan=True)


def test_one_unit_is_the_work_of_many_tasks(spark):
    """6,400 steps in blocks of 100: 64 groups of rows, dealt to as many tasks, and none of them holds the unit."""
    from pyspark.sql import functions as F

    seen = []
    d = long_unit(spark).where("unit = 'a/long'")

    def spy(x):
        seen.append(x)
        return x

    out = W.in_blocks(d, 20, lambda x: spy(x).withColumn("m", W.trailing("avg", "y", 20)), 100)
    assert out.count() == 6400 and out.select("step").distinct().count() == 6400
    sizes = seen[0].groupBy("unit").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.max("n")).first()
    assert sizes[0] == 65 and sizes[1] <= 120  # the last holds history alone
    spread = seen[0].repartition(64, "unit").select(F.spark_partition_id().alias("p"), "unit").distinct().groupBy("p").count()
    assert spread.count() > 30
