"""Running totals, exact quantiles, pooled backtests and pair sums against plain versions; and that nothing sorts a table in one task."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattline.functions import scalars as S
from wattline.operators import backtest as B
from wattline.operators import evaluate as E
from wattline.operators import fleet as L
from wattline.operators import panel as W
from wattline.operators import ranked as K


@pytest.mark.parametrize("n", [2, 7, 256])
def test_running_totals(spark, n):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": np.repeat(["a", "b", None], 50), "x": np.concatenate([rng.permutation(1000)[:50] for _ in range(3)]).astype(float), "v": rng.integers(0, 9, 150)})
    got = K.running(spark.createDataFrame(pdf), "x", {"upto": F.col("v")}, ("g",), n).toPandas()
    pdf["key"] = pdf["g"].fillna("-")
    want = pdf.sort_values("x").assign(upto=lambda d: d.groupby("key")["v"].cumsum())
    key = lambda d: sorted(zip(d["g"].fillna("-"), d["x"], d["upto"], strict=True))
    assert key(got) == key(want)
    assert K.running(spark.createDataFrame(pdf).limit(0), "x", {"upto": F.col("v")}).count() == 0


@pytest.mark.parametrize("values", [[1.0], [2.0, 2.0, 2.0, 9.0], list(range(101)), [0.5] * 40 + [0.25] * 3 + [None] * 5])
def test_quantiles_are_exact(spark, values):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
    probs = [0.0, 0.1, 0.5, 0.95, 0.999, 1.0]
    got = {r.i: r.value for r in K.quantiles(df, "x", probs).collect()}
    want = np.quantile([v for v in values if v is not None], probs)
    assert [got[i] for i in range(len(probs))] == pytest.approx(want.tolist(), abs=1e-12)
    assert K.quantile_row(df.limit(0), "x", {"m": 0.5}).first().m is None


def test_precision_cuts_through_ties(spark):
    rows = [(1, 5.0, 1), (2, 5.0, 0), (3, 4.0, 1), (4, 4.0, 0), (5, 4.0, 1), (6, 1.0, 1), (7, None, 1), (8, 9.0, None)]
    r = E.precision_at_n(spark.createDataFrame(rows, "id int, s double, y int"), "y", "s", "id").first()
    assert r.n == 4 and r.precision_at_n == pytest.approx(2 / 4)  # 5.0 twice, then ids 3 and 4 of the tied
    assert E.precision_at_n(spark.createDataFrame(rows[-1:], "id int, s double, y int"), "y", "s", "id").first().precision_at_n is None


def test_wilcoxon_p_value(spark):
    d = np.r_[np.arange(1, 30), -np.arange(1, 8)].astype(float)
    r = E.wilcoxon(spark.createDataFrame([(float(x),) for x in d], "d double"), "d").first()
    from math import erfc, sqrt

    assert r.p_value == pytest.approx(erfc(abs(r.z) / sqrt(2)), rel=1e-6) and r.n == 36


def test_tail_of_chi_squared(spark):
    from math import erfc, sqrt

    xs = [0.0, 0.001, 0.5, 1.0, 3.84, 12.9554911, 60.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in [*xs, None]], "x double").select(S.chi2_sf1("x").alias("p")).collect()]
    assert got[-1] is None and got[:-1] == pytest.approx([erfc(sqrt(x / 2)) for x in xs], rel=2e-7)


@pytest.mark.parametrize("sizes", [(300, 10, 40), (5, 600), (1,), (100, 100, 100)])
def test_pooled_counts_equal_one_long_series(spark, sizes):
    rng = np.random.default_rng(3)
    parts = [pd.DataFrame({"unit": f"u{i}", "step": np.arange(n) + 7, "exceed": rng.random(n) < 0.3}) for i, n in enumerate(sizes)]
    pdf = pd.concat(parts).assign(y=2.0, var=1.0, es=1.5)
    r = B.pooled_counts(spark.createDataFrame(pdf.sample(frac=1, random_state=1))).first()
    e = pdf["exceed"].to_numpy().astype(int)
    for i in (0, 1):
        for j in (0, 1):
            assert r[f"n{i}{j}"] == int(((e[:-1] == i) & (e[1:] == j)).sum())
    assert (r.n, r.x, r.recent_x, r.recent_n) == (len(e), e.sum(), e[-250:].sum(), min(250, len(e)))


def test_pair_sums_with_gaps(spark, monkeypatch):
    rng = np.random.default_rng(4)
    wide = pd.DataFrame(rng.normal(size=(200, 5)), columns=[f"u{i}" for i in range(5)]).mask(rng.random((200, 5)) < 0.2)
    long = wide.reset_index(names="step").melt("step", var_name="unit", value_name="x").dropna()
    monkeypatch.setattr(L, "_block_steps", lambda units: 17)
    got = {(r.a, r.b): r.corr for r in L.pairwise_corr(spark.createDataFrame(long), "x").collect()}
    want = wide.corr()
    assert len(got) == 10 and all(v == pytest.approx(want.loc[k], abs=1e-9) for k, v in got.items())
    monkeypatch.setattr(L, "MOST_UNITS", 3)  # beyond the bound: joined by step
    again = {(r.a, r.b): r.corr for r in L.pairwise_corr(spark.createDataFrame(long), "x").collect()}
    assert again == pytest.approx(got)
    with pytest.raises(ValueError):
        L.spectrum(spark.createDataFrame(long), "x")


def test_ridge_by_least_squares(spark):
    rng = np.random.default_rng(5)
    u = np.cumsum(rng.normal(0, 0.05, 120)) + 1
    pdf = pd.DataFrame({"unit": "a", "step": np.arange(120), "u": u, "z": rng.normal(size=120), "flat": 1.0})
    fc = L.ablation_forecasts(spark.createDataFrame(pdf), {"persistence": ("persistence", ["u"]), "ridge": ("ridge", ["u", "z", "flat"])}, (1, 3), 80).toPandas()
    for h in (1, 3):
        x, dy = pdf[["u", "z", "flat"]].to_numpy()[:-h], u[h:] - u[:-h]
        tr = np.arange(len(dy)) < 80
        sd = x[tr].std(axis=0)
        z = (x - x[tr].mean(axis=0)) / np.where(sd > 0, sd, 1)
        stacked, target = np.vstack([z[tr], np.eye(3)]), np.r_[dy[tr] - dy[tr].mean(), np.zeros(3)]  # ridge as augmented least squares
        pred = u[:-h] + dy[tr].mean() + z @ np.linalg.lstsq(stacked, target, rcond=None)[0]
        mine = fc[(fc["h"] == h) & (fc["model"] == "ridge")].sort_values("step")
        assert mine["pred"].to_numpy() == pytest.approx(pred[~tr], abs=1e-9)
        still = fc[(fc["h"] == h) & (fc["model"] == "persistence")]
        assert (still["pred"] == still["u"]).all()
    skill = {(r.h, r.model): r.skill for r in L.skill_table(spark.createDataFrame(fc)).collect()}
    assert skill[1, "persistence"] == skill[3, "persistence"] == 0.0


def test_rebuilding_by_plain_ridge(spark):
    """Every unit from the others, at one penalty, against a solve on centred columns."""
    rng = np.random.default_rng(6)
    m = np.cumsum(rng.normal(size=(90, 1)), axis=0) + rng.normal(0, 0.3, (90, 4))
    long = pd.DataFrame(m).reset_index(names="step").melt("step", var_name="unit", value_name="x").astype({"unit": str})
    got = L.virtual_sensors(spark.createDataFrame(long), "x", 60, (2.0,), None).toPandas()
    for i in range(4):
        peers = [j for j in range(4) if j != i]
        x, y = m[:, peers], m[:, i]
        xm, ym = x[:60].mean(axis=0), y[:60].mean()
        beta = np.linalg.solve((x[:60] - xm).T @ (x[:60] - xm) + 2.0 * np.eye(3), (x[:60] - xm).T @ (y[:60] - ym))
        mine = got[got["unit"] == str(i)].sort_values("step")["pred"].to_numpy()
        assert mine == pytest.approx(ym + (x - xm) @ beta, abs=1e-6)


def test_segments_of_two_clusters(spark):
    rng = np.random.default_rng(7)
    rows = [(f"u{i:02d}", "a" if i < 8 else "b", [float(v) for v in rng.normal(0 if i < 8 else 9, 0.5, 3)]) for i in range(16)]
    got = {r.k: r for r in L.segment_scan(spark.createDataFrame(rows, "unit string, cell string, v array<double>"), "v", "unit", "cell", (2, 3), 5, 200).collect()}
    assert got[2].adjusted_rand == pytest.approx(1.0) and got[2].silhouette > 0.8 > got[3].silhouette and got[2].chance_p95 < 0.5 and got[3].inertia < got[2].inertia


def test_silhouettes_of_any_number_of_points(spark):
    """Blocks of points, copies and several groupings at once against all pairs; more points than a task or the driver would hold are no error."""
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(0, 1, (40, 5)), rng.normal(3, 1, (50, 5)), np.full((4, 5), 9.0)]) + 1e5
    x = np.vstack([x, x[:30], x[:1]])
    groups = {"a": np.r_[np.zeros(40), np.ones(50), np.full(4, 2), np.zeros(30), 3].astype(int), "b": rng.integers(0, 3, 125), "c": np.zeros(125, int)}

    def plain(g):
        gaps, out = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), []
        for i in range(len(x)):
            same = (g == g[i]) & (np.arange(len(x)) != i)
            others = [gaps[i, g == h].mean() for h in set(g) - {g[i]}]
            top = max(gaps[i, same].mean(), min(others)) if same.any() and others else 0
            out.append((min(others) - gaps[i, same].mean()) / top if top else 0.0)
        return np.mean(out)

    rows = [(i, *(int(g[i]) for g in groups.values()), x[i].tolist()) for i in range(len(x))] + [(900, None, 1, 1, None), (901, 0, 1, 1, None)]
    df = spark.createDataFrame(rows, "id long, a int, b int, c int, v array<double>").repartition(3)
    for block in (7, 2048):
        got = E.silhouettes(df, "v", list(groups), block).first().asDict()
        assert got == pytest.approx({c: plain(g) for c, g in groups.items()}, abs=1e-9)
    assert E.silhouette(df.limit(0), "v", "a", "id").first()["silhouette"] is None
    many = spark.range(20_500).selectExpr("id", "id % 2 AS a", "array(CAST(id % 2 AS double), CAST(id % 50 AS double) / 100) AS v")
    assert 0.5 < E.silhouette(many, "v", "a", "id").first()["silhouette"] < 1
    scan = {r.k: r for r in L.kmeans_scan(many, "v", "id", "a", (2, 3)).collect()}
    assert scan[2].adjusted_rand == pytest.approx(1.0) and scan[2].silhouette > scan[3].silhouette


def test_dense_panels(spark):
    full = spark.range(12).selectExpr("CONCAT('u', id % 3) AS unit", "id DIV 3 AS step", "1.0D AS x")
    W.require_dense(full, ["x"])
    W.require_dense(full.limit(0), ["x"])
    for bad in (full.where("NOT (unit = 'u1' AND step = 2)"), full.where("NOT (unit = 'u1' AND step = 2)").union(full.where("unit = 'u1' AND step = 1")), full.withColumn("x", F.when(F.col("step") != 1, F.col("x")))):
        with pytest.raises(ValueError):
            W.require_dense(bad, ["x"])


def test_no_table_is_ordered_in_one_task(spark):
    """Windows without a partition see one row per range, unit or step; in these plans there is none at all."""
    df = spark.range(100).selectExpr("id", "CAST(id % 7 AS double) AS s", "CAST(id % 2 AS int) AS y", "CAST(id % 5 AS double) - 2 AS d")
    fc = spark.range(40).selectExpr("CONCAT('u', id % 4) AS unit", "id DIV 4 AS step", "1.0D AS y", "0.5D AS var", "0.6D AS es", "true AS exceed")
    for plan in (E.auc(df, "y", "s"), E.average_precision(df, "y", "s"), E.wilcoxon(df, "d"), E.describe(df, ["s", "d"]), B.counts(fc)):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in text.splitlines() if "Window [" in line]
        assert all("_range" in line or "unit" in line for line in windows)


def test_sketched_quantiles_stay_within_their_rank_error(spark):
    """Each of the 101 points has a rank within 1 / accuracy of the one asked for."""
    x = np.sort(np.random.default_rng(8).lognormal(size=20_000))
    df = spark.createDataFrame(pd.DataFrame({"x": np.random.default_rng(9).permutation(x)}))
    got = df.select(S.quantile_points("x", 100, 1000).alias("q")).first().q
    for i, v in enumerate(got):
        low, high = np.searchsorted(x, v, "left") / len(x), np.searchsorted(x, v, "right") / len(x)
        assert low - 0.001 <= i / 100 <= high + 0.001
    whole = {r.i: r.value for r in K.quantiles(df, "x", [0.5, 0.99]).collect()}
    assert whole[0] == pytest.approx(np.quantile(x, 0.5)) and got[50] == pytest.approx(whole[0], rel=0.02)


@pytest.mark.parametrize("accuracy", [20, 2000])
def test_quantiles_by_group_are_exact(spark, accuracy):
    """Heavy ties, outliers, groups of one, null keys and values; sketches coarse and fine, against numpy."""
    rng = np.random.default_rng(2)
    groups = {"ties": rng.integers(0, 4, 3000).astype(float), "wide": np.r_[rng.normal(size=5000), 1e12, -1e12], "one": np.array([7.0]), "two": np.array([1.0, 2.0]), None: rng.random(777), "same": np.full(500, 2.5)}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("ties", None), ("none", None)]
    named = {"q0": 0.0, "q1": 0.01, "q50": 0.5, "q999": 0.999, "q100": 1.0}
    df = spark.createDataFrame(rows, "k string, x double").repartition(7)
    got = {r.k: r for r in K.quantiles_by(df, ["k"], "x", named, accuracy).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        for name, p in named.items():
            assert got[k][name] == pytest.approx(np.quantile(x, p), rel=1e-12, abs=1e-12), (k, name)
    whole = K.quantiles_by(df, [], "x", named, accuracy).first()
    assert [whole[n] for n in named] == pytest.approx([np.quantile(np.concatenate(list(groups.values())), p) for p in named.values()])


def test_quantiles_by_orders_a_small_part(spark):
    """Of 200,000 distinct values, about a thousand are ordered; no aggregate holds a group's values."""
    df = spark.range(200_000).selectExpr("id % 2 AS k", "CAST(xxhash64(id) AS double) AS x")
    q = K.quantiles_by(df, ["k"], "x", {"m": 0.5})
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    assert " percentile(" not in plan and "collect_list" not in plan
    want = {r.k: r.m for r in df.groupBy("k").agg(F.percentile("x", 0.5).alias("m")).collect()}
    assert {r.k: r.m for r in q.collect()} == want
