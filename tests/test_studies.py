"""The fleet studies against plain versions: virtual sensors, boosted trees, ramp detection, paired comparison, faults, coupling."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattline import constants as C
from wattline.operators import evaluate as E
from wattline.operators import fleet as L
from wattline.operators import panel as W
from wattline.plans import panel as P


@pytest.fixture(scope="module")
def power(spark, sf):
    return P.power(spark, sf).select("unit", "step", F.col(P.Y).alias("u")).toPandas().pivot(index="step", columns="unit", values="u").sort_index()


def plain_ridge(x, y, alpha):
    mx, my = x.mean(axis=0), y.mean()
    b = np.linalg.solve((x - mx).T @ (x - mx) + alpha * np.eye(x.shape[1]), (x - mx).T @ (y - my))
    return my - mx @ b, b


def test_leave_one_out_is_plain_ridge():
    x = np.random.default_rng(0).normal(size=(200, 7)) @ np.random.default_rng(1).normal(size=(7, 7))
    x -= x.mean(axis=0)
    for alpha in (1e-3, 1.0, 100.0):
        w = L.leave_one_out(x.T @ x, alpha)
        for i in range(7):
            rest = [j for j in range(7) if j != i]
            assert w[i, i] == 0 and np.allclose(w[rest, i], plain_ridge(x[:, rest], x[:, i], alpha)[1], rtol=1e-8, atol=1e-10)


def test_virtual_sensor_query_by_plain_ridge(spark, sf, power):
    """One fit a unit and penalty on the rows themselves, with the penalty of the least error on the last quarter of the training half."""
    got = {r.unit: r for r in P.QUERIES["virtual_sensor"](spark, sf).collect()}
    x, split = power.to_numpy(), P.SPLIT
    early, late = power.index < split * 3 // 4, (power.index >= split * 3 // 4) & (power.index < split)
    test = power.index >= split
    for i, unit in enumerate(power.columns):
        rest = [j for j in range(x.shape[1]) if j != i]

        def loss(alpha, i=i, rest=rest):
            a, b = plain_ridge(x[early][:, rest], x[early][:, i], alpha)
            return ((x[late][:, i] - a - x[late][:, rest] @ b) ** 2).sum()

        a, b = plain_ridge(x[early | late][:, rest], x[early | late][:, i], min((10.0 ** (k / 2) for k in range(-6, 7)), key=loss))
        e = x[test][:, i] - a - x[test][:, rest] @ b
        assert got[unit].mae == pytest.approx(np.abs(e).mean(), abs=2e-6) and got[unit].p95_abs_err == pytest.approx(np.quantile(np.abs(e), 0.95), abs=2e-6)


def plain_boost(x, dy, tr, rounds=60, rate=0.1, bins=32, least=20):
    """Trees of depth 2 by trying every cut of every feature."""
    cuts = [np.unique(np.quantile(x[tr, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    guess = np.full(len(dy), dy[tr].mean())

    def best(rows, r):
        top, found = 0.0, None
        for f, c in enumerate(cuts):
            for cut in c:
                left = rows & (x[:, f] <= cut)
                n, m = left.sum(), rows.sum() - left.sum()
                if n >= least and m >= least:
                    gain = r[left].sum() ** 2 / n + (r[rows].sum() - r[left].sum()) ** 2 / m
                    if gain > top + 1e-12:
                        top, found = gain, (f, cut)
        return found

    for _ in range(rounds):
        r, root = dy - guess, best(tr, dy - guess)
        if root is None:
            break
        for side in (x[:, root[0]] <= root[1], x[:, root[0]] > root[1]):
            inner = best(side & tr, r)
            for leaf in [side] if inner is None else [side & (x[:, inner[0]] <= inner[1]), side & (x[:, inner[0]] > inner[1])]:
                if (leaf & tr).any():
                    guess = guess + rate * r[leaf & tr].mean() * leaf
    return guess


def test_boosted_trees_equal_plain_ones():
    rng = np.random.default_rng(0)
    x = np.c_[rng.normal(size=(300, 3)), np.ones(300), rng.integers(0, 3, 300)]
    y = np.where(x[:, 0] > 0.3, x[:, 1], -x[:, 2]) + 0.2 * x[:, 4] + rng.normal(size=300) / 10
    tr = np.arange(300) < 200
    got = L._boost(x, y, tr, rounds=12)
    assert np.allclose(got, plain_boost(x, y, tr, rounds=12), atol=1e-9)
    assert ((got - y)[~tr] ** 2).mean() < 0.7 * y[~tr].var()
    assert np.allclose(L._boost(np.ones((50, 2)), y[:50], tr[:50]), y[:50].mean())


@pytest.fixture(scope="module")
def forecasts(spark, sf):
    f = P.fleet_frame(spark, sf).toPandas().sort_values(["unit", "step"]).reset_index(drop=True)
    return f


def test_ablation_by_plain_fits(spark, sf, forecasts):
    """Every lead and model of the ablation refitted unit by unit in numpy; errors and skill as registered."""
    got = {(r.h, r.model): r for r in P.QUERIES["forecast_ablation"](spark, sf).collect()}
    columns = list(dict.fromkeys(["u", *W.FLEET]))
    for h in C.FLEET_HORIZONS:
        errors = {}
        for _, g in forecasts.groupby("unit"):
            g = g.assign(y=g["u"].shift(-h)).dropna(subset=columns + ["y"])
            tr, y, u = (g["step"] < P.SPLIT).to_numpy(), g["y"].to_numpy(), g["u"].to_numpy()
            for name, (kind, cs) in P.MODELS.items():
                x = g[list(cs)].to_numpy(float)
                dy = np.zeros(len(y)) if kind == "persistence" else (L._ridge if kind == "ridge" else L._boost)(x, y - u, tr)
                errors.setdefault(name, []).append((y - u - dy)[~tr])
        base = np.abs(np.concatenate(errors["persistence"])).mean()
        for name, e in errors.items():
            e = np.concatenate(e)
            r = got[h, name]
            assert r.mae == pytest.approx(np.abs(e).mean(), abs=2e-6) and r.rmse == pytest.approx(np.sqrt((e**2).mean()), abs=2e-6)
            assert r.p95_abs_err == pytest.approx(np.quantile(np.abs(e), 0.95), abs=2e-6) and r.skill == pytest.approx(1 - np.abs(e).mean() / base, abs=2e-5)


def plain_detection(event, score, tie):
    order = sorted(range(len(event)), key=lambda i: (-score[i], tie[i]))
    pos, neg = [s for s, e in zip(score, event, strict=True) if e], [s for s, e in zip(score, event, strict=True) if not e]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None
    top = max(1, len(pos))
    return len(pos), len(pos) / len(event), auc, sum(event[i] for i in order[:top]) / top


def test_detections_by_group_with_ties(spark):
    rng = np.random.default_rng(4)
    rows = [(g, int(t), int(rng.random() < 0.2), float(rng.integers(0, 8))) for g in ("a", "b", None) for t in range(150)]
    rows += [("none", t, 0, float(t % 3)) for t in range(9)] + [("a", 999, None, 1.0), ("a", 1000, 1, None)]
    got = {r.g: r for r in E.detections(spark.createDataFrame(rows, "g string, t long, e int, s double"), "e", "s", "t", ["g"]).collect()}
    assert set(got) == {"a", "b", None, "none"}
    for g, r in got.items():
        mine = [x for x in rows if x[0] == g and x[2] is not None and x[3] is not None]
        n, base, auc, top = plain_detection([x[2] for x in mine], [x[3] for x in mine], [x[1] for x in mine])
        assert (r.n_events, r.base_rate) == (n, pytest.approx(base)) and r.precision_at_n == pytest.approx(top)
        assert r.auc is None if auc is None else r.auc == pytest.approx(auc)


def test_ramp_detection_has_all_leads_and_detectors(spark, sf):
    got = P.QUERIES["ramp_detection"](spark, sf).collect()
    assert {(r.h, r.detector) for r in got} == {(h, d) for h in C.FLEET_HORIZONS for d in ("volatility_persistence", "boost_solo", "boost_fleet")}
    assert all(r.n_events > 0 and 0 <= r.auc <= 1 and r.threshold > 0 for r in got)
    one = {r.h: (r.n_events, r.threshold, r.base_rate) for r in got if r.detector == "boost_fleet"}
    assert all(one[r.h] == (r.n_events, r.threshold, r.base_rate) for r in got)
    plain = {r.h: r for r in P.QUERIES["ramp_volatility"](spark, sf).collect()}
    assert all(plain[r.h].n_events == r.n_events and plain[r.h].auc == pytest.approx(r.auc, abs=2e-3) for r in got if r.detector == "volatility_persistence")


def test_paired_models_compare_units(spark):
    rng = np.random.default_rng(0)
    rows = [(h, m, f"u{u}", t, 0.0, 0.0, float(rng.normal() * s)) for h in (1, 3) for m, s in (("good", 0.5), ("bad", 1.0)) for u in range(12) for t in range(60)]
    got = {r.h: r for r in L.paired_comparison(spark.createDataFrame(rows, "h int, model string, unit string, step long, y double, u double, pred double"), [("good", "bad")]).collect()}
    d = pd.DataFrame(rows, columns="h model unit step y u pred".split())
    for h in (1, 3):
        mae = d[d.h == h].assign(e=lambda x: x.pred.abs()).pivot_table(index="unit", columns="model", values="e")
        gain = mae["bad"] - mae["good"]
        assert got[h].units_improved == (gain > 0).sum() and got[h].n_units == 12 and got[h].median_gain_pct == pytest.approx((gain / mae["bad"]).median() * 100)
        rank = gain.abs().rank()
        w = rank[gain > 0].sum()
        z = (w - 12 * 13 / 4) / math.sqrt(12 * 13 * 25 / 24)
        assert got[h].w_plus == w and got[h].z == pytest.approx(z) and got[h].p_value == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-6)


def test_registered_pairs(spark, sf):
    got = P.QUERIES["paired_models"](spark, sf).collect()
    assert {(r.h, r.better, r.vs) for r in got} == {(h, a, b) for h in C.FLEET_HORIZONS for a, b in P.PAIRS} and {r.n_units for r in got} == {6}


@pytest.mark.parametrize("span", [1, 7, 24])
def test_trials_hold_their_steps(spark, span):
    """Bucketed join against every pair of step and trial, trials overlapping and beginning on bucket borders."""
    steps, starts = list(range(50, 200)), [50, 51, 56, 70, 72, 96, 120, 144, 176, 190]
    test = spark.createDataFrame([("u", s) for s in steps], "unit string, step long")
    got = sorted((r.t, r.step, r.i) for r in L.trial_windows(test, spark.createDataFrame([(t,) for t in starts], "t long"), span).collect())
    assert got == sorted((t, s, s - t) for t in starts for s in steps if t <= s < t + span)
    plan = L.trial_windows(test, spark.createDataFrame([(t,) for t in starts], "t long"), span)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_fault_study_by_hand(spark, sf, power):
    """The registered study on the virtual sensors' residuals, trial by trial."""
    z = L.residual_scores(P.virtual(spark, sf), P.SPLIT).where(F.col("step") >= P.SPLIT).toPandas().sort_values(["unit", "step"])
    got = {(r.fault, r.magnitude): r for r in P.QUERIES["fault_injection"](spark, sf).collect()}
    trials, first = {}, {}
    false = []
    for _, g in z.groupby("unit"):
        g = g.set_index("step")
        tau = np.quantile(g["z"], 1 - 1 / P.DAY)
        false.append((g["z"] > tau).mean())
        for t in P.ONSETS:
            if t + P.SPLIT + P.DAY > 720:
                continue
            w = g.loc[t + P.SPLIT : t + P.SPLIT + P.DAY - 1]
            for fault, m in [(k, m) for k in ("bias", "drift") for m in P.MAGNITUDES] + [("stuck", None)]:
                bump = np.full(P.DAY, m) if fault == "bias" else np.linspace(0, m, P.DAY) if fault == "drift" else w["y"].iloc[0] - w["y"].to_numpy()
                fired = np.flatnonzero(np.abs((w["resid"] + bump - w["mu"]) / w["sd"]).to_numpy() > tau)
                trials[fault, m] = trials.get((fault, m), 0) + 1
                if fired.size:
                    first.setdefault((fault, m), []).append(fired[0])
    assert set(got) == set(trials)
    for k, r in got.items():
        assert r.trials == trials[k] and r.units_tested == 6 and r.false_alarms_per_unit_day == pytest.approx(np.mean(false) * P.DAY, abs=2e-6)
        assert abs(r.detection_rate - len(first.get(k, [])) / trials[k]) < 1.5 / trials[k]  # a reading that sits on its threshold may fall to either side


def test_coupling_on_both_forms(spark, sf, power):
    got = {r.form: r for r in P.QUERIES["coupling_spectrum"](spark, sf).collect()}
    for form, x in (("change", power.diff().iloc[1:]), ("level", power)):
        v = np.sort(np.linalg.eigvalsh(np.corrcoef(x.to_numpy().T)))[::-1]
        assert got[form].n_eff == pytest.approx(v.sum() ** 2 / (v**2).sum(), abs=1e-5) and got[form].pc1_share == pytest.approx(v[0] / v.sum(), abs=1e-5)
        assert got[form].pcs_for_90 == np.searchsorted(np.cumsum(v) / v.sum(), 0.9) + 1
