"""The four reports of the power study, each one call on a panel: Markdown made of small result tables.

A panel has unit, cell, step, ts, both channels and both flags (see adapters.power()). `Settings` holds its clock and windows, which by default
are those of a five-minute panel.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline import constants as C
from wattline.operators import backtest as B
from wattline.operators import evaluate as E
from wattline.operators import fleet as L
from wattline.operators import panel as W
from wattline.operators import risk as R
from wattline.operators import tail as T
from wattline.scratch import keep
from wattline.sources.readers import markdown

Y, P = "measured_power_util", "production_power_util"


@dataclass(frozen=True)
class Settings:
    hour: int = 12
    day: int = C.DAY
    window: int = C.WINDOW
    vol_window: int = C.VOL_WINDOW
    split: int = C.FLEET_SPLIT
    steps: int = 31 * C.DAY
    horizons: Sequence[int] = C.FLEET_HORIZONS
    limit_horizons: Sequence[int] = C.LIMIT_HORIZONS
    limit_start: int = 0
    alphas: Sequence[float] = (0.95, 0.99)
    limit_alphas: Sequence[float] = C.LIMIT_ALPHAS
    fault_magnitudes: Sequence[float] = C.FAULT_MAGNITUDES
    fault_span: int = C.FAULT_STEPS
    fault_onsets: int = C.FAULT_ONSETS
    least_r2: float | None = 0.5


def _text(title: str, sections: Iterable[tuple[str, DataFrame]]) -> str:
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{markdown(table)}" for name, table in sections)]) + "\n"


def _stacked(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def results_report(panel: DataFrame, s: Settings = Settings()) -> str:
    """Backtests, clustering of breaches, calibrated limits by lead, and the fleet's posture."""
    panel, rows, clustered = keep(panel, "panel"), [], []
    for model in T.MODELS:
        for alpha in s.alphas:
            fc = keep(T.usable(T.forecast_panel(panel, Y, model, alpha, s.window, s.vol_window), "var", "es"), "forecasts")
            table = keep(B.p_values(B.backtest_panel(fc, alpha)), "backtests")
            passed = table.where("unit != 'ALL/POOLED'").agg(F.sum((F.col("cc_p") > 0.05).cast("int")).alias("units_passing"), F.count(F.lit(1)).alias("units"))
            tag = [F.lit(model).alias("model"), F.lit(alpha).alias("alpha")]
            rows.append(table.where("unit = 'ALL/POOLED'").select(*tag, "rate", F.lit(1 - alpha).alias("expected_rate"), "kupiec_p", "ind_p", "es_z2").crossJoin(passed))
            clustered.append(B.clustering_stats(fc, alpha).select(*tag, "p01", "p11", "ratio"))
    curve = keep(T.limit_curve(panel, Y, s.limit_horizons, s.limit_alphas, s.split, s.window, s.vol_window, s.limit_start), "limits").orderBy("h", "alpha")
    posture = R.risk_table(panel, T.usable(T.forecast_panel(panel, Y, "fhs_ar", max(s.alphas), s.window, s.vol_window), "var", "es")).groupBy("posture").agg(F.count(F.lit(1)).alias("units")).orderBy("posture")
    return _text("Results", [
        ("Backtests, all units as one", _stacked(rows)), ("Clustering of breaches", _stacked(clustered)),
        ("Calibration by lead, judged after the split", curve.select("h", "alpha", "m", "raw_test", "cal_test", "breaches_per_unit", "verdict")), ("Limits by lead", curve.select("h", "alpha", "worst", "median", "p90", "verdict")), ("Posture", posture),
    ])


def fleet_report(panel: DataFrame, s: Settings = Settings()) -> str:
    """Coupling, reserves, forecasts with ablations, ramps, virtual sensors, injected faults and segments."""
    panel = keep(panel, "panel")
    inc = L.increments(panel, Y)
    coupling = _stacked(L.effective_units(x, Y).select(F.lit(form).alias("form"), "*") for form, x in (("change", inc), ("level", panel)))
    spectra = panel.sparkSession.createDataFrame([(form, *L.components_for(L.spectrum(x, Y))) for form, x in (("change", inc), ("level", panel))], "form string, pc1_share double, pcs_for_90 int")
    reserve = _stacked(L.reserve_inflation(panel, Y, k).select(F.lit(k).alias("h"), "*") for k in s.horizons)
    features = keep(W.fleet_features(panel, hour=s.hour, day=s.day).withColumn("roll_std_h", F.coalesce("roll_std_h", F.lit(0.0))), "features")
    models = {"persistence": ("persistence", ["u"]), "ridge_solo": ("ridge", W.OWN), "ridge_fleet": ("ridge", W.FLEET), "boost_solo": ("boost", W.OWN), "boost_fleet": ("boost", W.FLEET)}
    pred = keep(L.ablation_forecasts(features, models, s.horizons, s.split), "predictions")
    cut = keep(L.ramp_thresholds(features.na.drop(), s.horizons, s.split), "thresholds")
    ramps = keep(L.ramp_scores(pred, features, cut, {"boost_solo": "boost_solo", "boost_fleet": "boost_fleet"}, "roll_std_h").withColumn("tie", F.concat_ws("/", "unit", "step")), "ramps")
    pairs = [("boost_fleet", "boost_solo"), ("ridge_fleet", "ridge_solo"), ("boost_fleet", "persistence"), ("boost_solo", "persistence")]
    rebuilt = keep(L.virtual_sensors(panel, Y, s.split, bad=None), "rebuilt")
    scores = keep(L.residual_scores(rebuilt, s.split), "residuals")
    sensors = keep(E.errors(rebuilt.where(F.col("step") >= s.split), "y", "pred", ["unit"]), "sensors")
    room = max(1, s.steps - s.split - s.fault_span)
    faults = L.inject_faults(scores, s.split, s.steps, range(0, room, max(1, room // s.fault_onsets)), s.fault_magnitudes, s.fault_span, 1 / s.day, s.least_r2, s.day)
    sig = L.signature(panel.withColumn("tod", F.col("step") % s.day)).withColumn("cell", F.split("unit", "/")[0])
    units = sig.count()
    segments = L.segment_scan(L.standardized(sig, [c for c in sig.columns if c not in ("unit", "cell")]), "v", "unit", "cell", range(2, min(11, units)))
    return _text("Fleet", [
        ("Coupling", coupling.join(spectra, "form")), ("Diversity", L.diversity_factor(panel, Y).crossJoin(L.share_up(panel, Y))), ("Reserves", reserve), ("Forecasts", L.skill_table(pred).orderBy("h", "model")),
        ("Paired by unit", L.paired_comparison(pred, pairs).orderBy("h", "better", "vs")), ("Ramps", E.joined_on(E.detections(ramps, "event", "score", "tie", ["h", "detector"]), cut, ["h"]).orderBy("h", "detector")),
        ("Virtual sensors", sensors.agg(F.percentile("r2", 0.5).alias("median_r2"), F.sum((F.col("r2") > 0.5).cast("int")).alias("units_above_half"), F.count(F.lit(1)).alias("units"))),
        ("Injected faults", faults.orderBy("fault", "magnitude")), ("Segments", segments.orderBy("k")),
    ])


def clock_report(panel: DataFrame, s: Settings = Settings()) -> str:
    """What the time of day explains of levels and of steps, and how spikes follow spikes."""
    x = keep(panel.withColumn("tod", F.col("step") % s.day), "panel")
    step = keep(x.select("unit", "step", "tod", (W.lag(Y, -1) - F.col(Y)).alias("rise")).where("rise IS NOT NULL"), "steps")
    cut = L.ramp_thresholds(x.select("unit", "step", F.col(Y).alias("u")), [1], s.split).select("threshold")
    events = step.crossJoin(F.broadcast(cut)).withColumn("event", F.col("rise") >= F.col("threshold")).where(F.col("step") >= s.split)
    explained = _stacked(E.errors(W.tod_profile(d, c, s.split), "y", "profile").select(F.lit(name).alias("of"), "*") for name, d, c in (("level", x, Y), ("step", step, "rise")))
    return _text("Time of day", [("Explained by the clock", explained), ("Spikes after spikes", W.event_after_event(events, "event"))])


def engine_report(panel: DataFrame, s: Settings = Settings(), sigmas: float = 3.0) -> str:
    """Ramps of a site in megawatts and engines, and the reserve that independent units would need."""
    panel = keep(panel, "panel")
    return _text("Engines", [("Ramps", L.engine_conversion(panel, Y, s.horizons, s.day).orderBy("h")), ("Reserve", _stacked(L.reserve_shortfall(panel, Y, k, sigmas) for k in s.horizons))])


REPORTS = {"results": results_report, "fleet": fleet_report, "clock": clock_report, "engines": engine_report}
