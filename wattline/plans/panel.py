"""Registered queries on the power panel: windows, tails, backtests, risk, fleet; and their oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline import adapters as A
from wattline import constants as C
from wattline.functions import scalars as S
from wattline.operators import backtest as B
from wattline.operators import evaluate as E
from wattline.operators import fleet as L
from wattline.operators import panel as W
from wattline.operators import risk as R
from wattline.operators import tail as T
from wattline.operators.ranked import quantile_row
from wattline.plans.capacity import NUDGE, r, rounded
from wattline.scratch import keep

Y, P = "measured_power_util", "production_power_util"
#: The synthetic panel is hourly: a day has 24 steps, a week 168.
DAY, WEEK, SPLIT = 24, 168, 480
#: Steps of a block: the panel's windows reach back about as far, so that every unit is cut several times.
BLOCK = 200
#: Leads of the limit curve in hours, and the first step at which all its windows are full.
LEADS = (1, 2, 3, 6, 12, 24)
LIMIT_START = 3 * LEADS[-1] + DAY + WEEK
POWER = A.POWER_SQL


def power(s, d):
    return A.power(s, d)


def fleet_frame(s, d):
    return W.fleet_features(power(s, d), hour=12, day=DAY, block=BLOCK).withColumn("roll_std_h", F.coalesce("roll_std_h", F.lit(0.0)))


def tails(s, d, alpha=0.95):
    return T.rolling_tail(power(s, d).withColumn("_x", W.lag(Y, 1)), "_x", alpha, WEEK, block=BLOCK).select("unit", "step", "q", "es")


def forecast(s, d, model, alpha=0.95):
    return T.usable(T.forecast_panel(power(s, d), Y, model, alpha, WEEK, DAY, BLOCK), "var", "es").where(f"step >= {WEEK + 2 * DAY}")


def horizon(s, d, alpha=0.95, h=3):
    return T.usable(T.forecast_horizon(power(s, d), Y, alpha, h, 1.0, WEEK, DAY, BLOCK), "var", "es").where(f"step >= {WEEK + 2 * DAY}")


def tests(s, d, model="fhs"):
    return B.counts(B.breaches(forecast(s, d, model)), steps=BLOCK)


def labels(s, d):
    docs = A.table(s, d, "documents").select("doc_id", "n_chars")
    return A.table(s, d, "labels").join(docs, "doc_id").select("doc_id", "quality", F.col("n_chars").cast("double").alias("score"))


def events_with_split(s, d, h=1):
    """Steps that rise above the training half's 99th percentile."""
    x = power(s, d).select("unit", "step", (W.lag(Y, -h) - F.col(Y)).alias("rise"), (F.col("step") % 24).cast("int").alias("tod")).where("rise IS NOT NULL")
    cut = quantile_row(x.where(f"step < {SPLIT}"), "rise", {"cut": 0.99})
    return x.join(F.broadcast(cut)).select("unit", "step", "tod", (F.col("rise") >= F.col("cut")).alias("event"))


def clock_scores(s, d):
    e = events_with_split(s, d)
    train, test = e.where(f"step < {SPLIT}"), e.where(f"step >= {SPLIT}")
    rates = W.smoothed_rates(train, "event", "tod", 24)
    prior = train.agg(F.avg(F.col("event").cast("double")).alias("prior"))
    return test.join(F.broadcast(rates), "tod").join(F.broadcast(prior)).select("unit", "step", F.col("event").cast("int").alias("event"), "rate", "prior")


def clock_resolutions(s, d):
    """Clock-only event rates at four resolutions, fitted on the training half; scored on either half, all in one plan."""
    hour, day = F.col("tod"), (F.col("step").cast("int") / 24).cast("int") % 7
    keys = {"half_day": (hour / 12).cast("int"), "hour": hour, "hour_x_weekend": hour + 24 * (day >= 5).cast("int"), "hour_x_dow": hour + 24 * day}
    forms = F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), k.cast("int").alias("key")) for n, k in keys.items()))).alias("k")
    x = events_with_split(s, d).select("step", F.col("event").cast("int").alias("y"), forms).select("step", "y", "k.*").withColumn("part", F.when(F.col("step") < SPLIT, "train").otherwise("test"))
    train = x.where("part = 'train'")
    prior = train.groupBy("feature").agg(F.avg("y").alias("prior"))
    rates = train.groupBy("feature", "key").agg(F.sum("y").alias("hits"), F.count(F.lit(1)).alias("n"))
    zero = F.lit(0)
    scored = x.join(F.broadcast(prior), "feature").join(rates, ["feature", "key"], "left").withColumn("rate", S.smoothed_rate(F.coalesce("hits", zero), F.coalesce("n", zero), "prior"))
    by = ["feature", "part"]
    return E.deviance_explained(scored, "y", "rate", "prior", keys=by).join(E.auc(scored, "y", "rate", by), by)


def step_profile(s, d):
    """What the clock explains of the next step's change."""
    x = power(s, d).select("unit", "step", (F.col("step") % 24).alias("tod"), (W.lag(Y, -1) - F.col(Y)).alias("rise")).where("rise IS NOT NULL")
    return E.errors(W.tod_profile(x, "rise", SPLIT), "y", "profile")


def ramp_detection(s, d):
    """Three detectors at all leads: recent volatility, and boosted trees on own history and with the other units."""
    f = keep(fleet_frame(s, d), "features")
    pred = keep(L.ablation_forecasts(f, {k: MODELS[k] for k in ("boost_solo", "boost_fleet")}, C.FLEET_HORIZONS, SPLIT), "predictions")
    cut = keep(L.ramp_thresholds(f.na.drop(), C.FLEET_HORIZONS, SPLIT), "thresholds")
    rows = keep(L.ramp_scores(pred, f, cut, {k: k for k in ("boost_solo", "boost_fleet")}, "roll_std_h").withColumn("tie", F.concat_ws("/", "unit", "step")), "ramp-scores")
    return E.joined_on(E.detections(rows, "event", "score", "tie", ["h", "detector"]), cut, ["h"])


def ramp_volatility(s, d):
    """The detector that SQL can say as well: recent volatility at all leads."""
    f = fleet_frame(s, d).na.drop().withColumn("roll_std_h", F.round(F.col("roll_std_h") + F.lit(NUDGE), 9))
    f = keep(f, "features")
    now = L.leads(f, C.FLEET_HORIZONS, "u").where(f"step >= {SPLIT}").select("h", F.lit("now").alias("model"), "unit", "step", "y", "u", F.col("u").alias("pred"))
    cut = keep(L.ramp_thresholds(f, C.FLEET_HORIZONS, SPLIT), "thresholds")
    rows = L.ramp_scores(now, f, cut, {"now": "now"}, "roll_std_h").where("detector = 'volatility_persistence'").withColumn("tie", F.concat_ws("/", "unit", "step"))
    return E.joined_on(E.detections(keep(rows, "ramp-scores"), "event", "score", "tie", ["h", "detector"]), cut, ["h"])


#: Which model is compared with which.
PAIRS = (("boost_fleet", "boost_solo"), ("ridge_fleet", "ridge_solo"), ("boost_fleet", "persistence"), ("boost_solo", "persistence"))


def paired_models(s, d):
    """Four pairs of models at four leads, unit by unit."""
    return L.paired_comparison(keep(L.ablation_forecasts(keep(fleet_frame(s, d), "features"), MODELS, C.FLEET_HORIZONS, SPLIT), "predictions"), PAIRS)


def paired_clock(s, d):
    """The mean change at a time of day against no change, at four leads, unit by unit."""
    x = L.leads(power(s, d).withColumnRenamed(Y, "u"), C.FLEET_HORIZONS, "u").withColumn("tod", F.col("step") % DAY)
    mean = x.where(f"step < {SPLIT}").groupBy("h", "unit", "tod").agg(F.avg(F.col("y") - F.col("u")).alias("change"))
    test = x.where(f"step >= {SPLIT}").join(mean, ["h", "unit", "tod"])
    forms = F.explode(F.array(*(F.struct(F.lit(n).alias("model"), p.alias("pred")) for n, p in {"clock": F.col("u") + F.col("change"), "persistence": F.col("u")}.items()))).alias("m")
    return L.paired_comparison(test.select("h", "unit", "step", "y", "u", forms).select("h", "unit", "step", "y", "u", "m.*"), [("clock", "persistence")])


def flag_detection(s, d):
    """Do residuals of rebuilt readings find flagged ones?"""
    z = keep(L.residual_scores(virtual(s, d), SPLIT), "residuals").join(power(s, d).select("unit", "step", F.col("bad_measurement_data").cast("int").alias("flag")), ["unit", "step"])
    low, high = E.auc_interval(z, "flag", "z")
    return E.auc(z, "flag", "z").select("auc", F.lit(low).alias("low"), F.lit(high).alias("high"))


def virtual(s, d):
    return L.virtual_sensors(power(s, d), Y, SPLIT, bad=None)


def gbt_ceiling(s, d):
    e = events_with_split(s, d).select("unit", "step", F.col("event").cast("double").alias("event"))
    x = VectorAssembler(inputCols=W.FLEET, outputCol="x").transform(fleet_frame(s, d).na.drop()).join(e, ["unit", "step"])
    m = GBTClassifier(featuresCol="x", labelCol="event", maxIter=20, maxDepth=4, seed=0).fit(x.where(f"step < {SPLIT}"))
    p = m.transform(x.where(f"step >= {SPLIT}")).select(F.col("event").cast("int").alias("event"), vector_to_array("probability")[1].alias("p"))
    return E.auc(p, "event", "p").join(E.average_precision(p, "event", "p")).join(E.deviance_explained(p, "event", "p", 0.01))


def headroom(s, d):
    """Headroom predicted without the second channel, beside constant and naive baselines."""
    x = fleet_frame(s, d).withColumn("target", F.col("headroom"))
    pred, _ = L.gbt_forecast(x, W.METER_ONLY, 1, SPLIT)
    base = x.where(f"step < {SPLIT}").groupBy("unit").agg(F.avg("headroom").alias("const"), F.avg("p").alias("mean_p"))
    test = pred.join(x.select("unit", "step", "headroom", "badp"), ["unit", "step"]).join(base, "unit").withColumns({"naive": F.col("u") - F.col("mean_p")})
    const = E.errors(test, "headroom", "const", ["badp"]).select("badp", F.col("mae").alias("mae_const"))
    naive = E.errors(test, "headroom", "naive", ["badp"]).select("badp", F.col("mae").alias("mae_naive"))
    model = E.errors(test, "y", "pred", ["badp"]).select("badp", F.col("mae").alias("mae_model"))
    return const.join(naive, "badp").join(model, "badp")


#: What the ablation compares: own history alone, and with the other units; at all leads.
MODELS = {"persistence": ("persistence", ["u"]), "ridge_solo": ("ridge", W.OWN), "ridge_fleet": ("ridge", W.FLEET), "boost_solo": ("boost", W.OWN), "boost_fleet": ("boost", W.FLEET)}


def ablation(s, d, *kinds):
    models = {k: v for k, v in MODELS.items() if v[0] in kinds}
    return L.skill_table(keep(L.ablation_forecasts(fleet_frame(s, d), models, C.FLEET_HORIZONS, SPLIT), "predictions"))


def gbt_errors(s, d):
    """One boosted model over all units at each lead."""
    f = fleet_frame(s, d)
    parts = [E.errors(L.gbt_forecast(f, W.FLEET, h, SPLIT)[0], "y", "pred").select(F.lit(h).alias("h"), "*") for h in C.FLEET_HORIZONS]
    return reduce(DataFrame.unionByName, parts)


def importances(s, d):
    """What the boosted model over all units looks at."""
    found = L.gbt_forecast(fleet_frame(s, d), W.FLEET, 1, SPLIT)[1]
    return s.createDataFrame([(i + 1, n, v) for i, (n, v) in enumerate(found)], "rank int, feature string, importance double")


#: Onsets and magnitudes of the synthetic fault study.
ONSETS, MAGNITUDES = range(0, 200, 200 // C.FAULT_ONSETS), (0.0, 0.05, 0.1, 0.2, 0.5)


def faults(s, d, rebuilt=None):
    scores = keep(L.residual_scores(virtual(s, d) if rebuilt is None else rebuilt, SPLIT), "residuals")
    return L.inject_faults(scores, SPLIT, A.STEPS, ONSETS, MAGNITUDES, DAY, 1 / DAY, None, DAY)


def faults_by_peers(s, d):
    """The fault study on readings rebuilt as the mean of the others, which SQL can say as well."""
    return faults(s, d, L.peer_mean_sensors(power(s, d), Y))


def points(s, d):
    return A.table(s, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"), (F.col("vec_id") % 7).cast("int").alias("g"))


def segments(s, d):
    sig = L.signature(power(s, d).withColumn("tod", F.col("step") % 24)).withColumn("cell", F.split("unit", "/")[0])
    return L.segment_scan(L.standardized(sig, [c for c in sig.columns if c not in ("unit", "cell")]), "v", "unit", "cell", range(2, A.UNITS))


def numbers(s, d):
    """Small literals through the scalar functions."""
    x = s.range(0, 16).select(F.col("id").alias("x"))
    return x.select("x", S.binom_cdf("x", F.lit(250), 0.01).alias("binom"), S.xlogx("x").alias("xlogx"), S.chi2_sf2("x").alias("chi2_2"), S.rounded_long(F.col("x") / 4 - 2).alias("rounded"), S.bucket(F.col("x") - 8, 5).alias("bucket"))


def enums(s, d):
    x = A.instance_events(s, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return x.select("type", S.enum_name("type", "event_type").alias("name"), "n")


def constraints(s, d):
    x = A.table(s, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("value"), (F.col("p_partkey") % 8).cast("int").alias("relation"), (F.col("p_partkey") % 5 != 0).alias("present"))
    return x.select("p_partkey", S.constraint_holds("relation", F.lit("25"), "value", "present").alias("holds"))


def coupling(s, d):
    """Effective units and principal components of changes and of levels."""
    parts = []
    for form, x in (("change", L.increments(power(s, d), Y)), ("level", power(s, d))):
        pc1, many = L.components_for(L.spectrum(x, Y))
        parts.append(L.effective_units(x, Y).select(F.lit(form).alias("form"), "*", F.lit(pc1).alias("pc1_share"), F.lit(many).alias("pcs_for_90")))
    return reduce(DataFrame.unionByName, parts)


def spectrum_moments(s, d):
    """Sums of the eigenvalues and of their squares, which are the trace and the squared entries of the matrix."""
    found = [(form, L.spectrum(x, Y)) for form, x in (("change", L.increments(power(s, d), Y)), ("level", power(s, d)))]
    return s.createDataFrame([(form, len(v), float(v.sum()), float((v**2).sum())) for form, v in found], "form string, n int, trace double, squares double")


QUERIES = {
    "lag_diff_features": lambda s, d: rounded(W.lag_diff_features(power(s, d), Y, block=BLOCK), 9),
    "trailing_stats": lambda s, d: rounded(W.trailing_stats(power(s, d), Y, 12, DAY, BLOCK).na.drop(), 9),
    "clock_features": lambda s, d: rounded(W.clock_features(power(s, d), width_min=60)),
    "unit_features": lambda s, d: rounded(W.unit_features(power(s, d), Y, P, 12, DAY, block=BLOCK).na.drop(), 9),
    "fleet_features": lambda s, d: rounded(W.fleet_features(power(s, d), hour=12, day=DAY, block=BLOCK).na.drop(), 9),
    "ar1_slope": lambda s, d: rounded(W.ar1_slope(power(s, d), Y, WEEK, block=BLOCK).select("unit", "step", "phi")),
    "rolling_tail_q": lambda s, d: rounded(T.usable(tails(s, d), "q").where(f"step >= {WEEK}").select("unit", "step", "q"), 9),
    "rolling_tail_es": lambda s, d: rounded(T.usable(tails(s, d), "es").where(f"step >= {WEEK}").select("unit", "step", "es"), 9),
    "empirical": lambda s, d: rounded(forecast(s, d, "empirical").select("unit", "step", "var", "es"), 9),
    "fhs": lambda s, d: rounded(forecast(s, d, "fhs").select("unit", "step", "var", "es")),
    "fhs_ar": lambda s, d: rounded(forecast(s, d, "fhs_ar").select("unit", "step", "var", "es")),
    "fhs_horizon": lambda s, d: rounded(horizon(s, d).select("unit", "step", "var", "es")),
    "calibrate_multiplier": lambda s, d: rounded(T.calibrate(horizon(s, d), 0.95, SPLIT)),
    "limit_curve": lambda s, d: rounded(T.limit_curve(power(s, d), Y, LEADS, C.LIMIT_ALPHAS, SPLIT, WEEK, DAY, LIMIT_START, BLOCK)),
    "kupiec": lambda s, d: rounded(B.kupiec(tests(s, d), 0.95).select("unit", "n", "x", "expected", "rate", "kupiec_lr")),
    "christoffersen": lambda s, d: rounded(B.christoffersen(tests(s, d)).select("unit", "n00", "n01", "n10", "n11", "ind_lr")),
    "cond_coverage": lambda s, d: rounded(B.conditional_coverage(tests(s, d), 0.95).select("unit", "cc_lr", "cc_p")),
    "basel_zone": lambda s, d: rounded(B.basel_zone(tests(s, d), 0.95).select("unit", "recent_x", "cum_prob", "basel_zone")),
    "es_z2": lambda s, d: rounded(B.es_z2(tests(s, d), 0.95).select("unit", "es_z2")),
    "backtest_panel": lambda s, d: rounded(B.p_values(B.backtest_panel(forecast(s, d, "fhs_ar"), 0.95, steps=BLOCK))),
    "es_bootstrap": lambda s, d: rounded(B.es_p_values(B.breaches(forecast(s, d, "fhs_ar")), 0.95)),
    "backtest_pooled": lambda s, d: rounded(B.backtest_panel(forecast(s, d, "fhs"), 0.95, steps=BLOCK).where("unit = 'ALL/POOLED'").select("n", "x", "n00", "n01", "n10", "n11", "recent_x", "kupiec_lr", "ind_lr")),
    "clustering_stats": lambda s, d: rounded(B.clustering_stats(forecast(s, d, "empirical"), 0.95, steps=BLOCK)),
    "episodes": lambda s, d: W.episodes(power(s, d), "bad_measurement_data"),
    "global_episodes": lambda s, d: W.global_episodes(power(s, d), "bad_measurement_data"),
    "frozen_rate": lambda s, d: rounded(R.frozen_rates(power(s, d))),
    "observability": lambda s, d: rounded(R.observability(power(s, d))),
    "cappable_share": lambda s, d: rounded(R.cappable_share(power(s, d))),
    "attribution_bound": lambda s, d: rounded(R.attribution_bound(power(s, d))),
    "risk_posture": lambda s, d: rounded(R.risk_table(power(s, d), forecast(s, d, "empirical")).select("unit", "par_99", "capping_credit", "limit_raw", "limit_adj", "margin_cost", "posture")),
    "pairwise_corr": lambda s, d: rounded(L.pairwise_corr(L.increments(power(s, d), Y), Y)),
    "n_eff": lambda s, d: rounded(L.effective_units(L.increments(power(s, d), Y), Y)),
    "n_eff_levels": lambda s, d: rounded(L.effective_units(power(s, d), Y)),
    "coupling_spectrum": lambda s, d: rounded(coupling(s, d)),
    "spectrum_moments": lambda s, d: rounded(spectrum_moments(s, d)),
    "reserve_inflation": lambda s, d: rounded(L.reserve_inflation(power(s, d), Y, 1)),
    "diversity_factor": lambda s, d: rounded(L.diversity_factor(power(s, d), Y)),
    "share_up": lambda s, d: rounded(L.share_up(power(s, d), Y)),
    "engine_conversion": lambda s, d: rounded(L.engine_conversion(power(s, d), Y, C.FLEET_HORIZONS, DAY)),
    "smoothed_rate": lambda s, d: rounded(W.smoothed_rates(events_with_split(s, d).where(f"step < {SPLIT}"), "event", "tod", 24)),
    "deviance_explained": lambda s, d: rounded(E.deviance_explained(clock_scores(s, d), "event", "rate", "prior")),
    "spike_after_spike": lambda s, d: rounded(W.event_after_event(events_with_split(s, d).where(f"step >= {SPLIT}"), "event")),
    "tod_profile_r2": lambda s, d: rounded(E.errors(W.tod_profile(power(s, d).withColumn("tod", F.col("step") % 24), Y, SPLIT), "y", "profile")),
    "auc_exact": lambda s, d: rounded(E.auc(labels(s, d), "quality", "score")),
    "average_precision": lambda s, d: rounded(E.average_precision(labels(s, d), "quality", "score")),
    "precision_at_n": lambda s, d: rounded(E.precision_at_n(labels(s, d), "quality", "score", "doc_id")),
    "wilcoxon_paired": lambda s, d: rounded(E.wilcoxon(power(s, d).select((F.round((F.col(Y) - F.col(P)) * 1000) - 160).alias("diff")), "diff")),
    "ridge_per_unit": lambda s, d: rounded(ablation(s, d, "persistence", "ridge")),
    "forecast_ablation": lambda s, d: rounded(ablation(s, d, "persistence", "ridge", "boost")),
    "gbt_forecast": lambda s, d: rounded(gbt_errors(s, d)),
    "importances": lambda s, d: rounded(importances(s, d)),
    "virtual_sensor": lambda s, d: rounded(E.errors(keep(virtual(s, d).where(f"step >= {SPLIT}"), "rebuilt"), "y", "pred", ["unit"])),
    "fault_injection": lambda s, d: rounded(faults(s, d)),
    "fault_injection_peers": lambda s, d: rounded(faults_by_peers(s, d)),
    "gbt_ceiling": lambda s, d: rounded(gbt_ceiling(s, d)),
    "meter_only_headroom": lambda s, d: rounded(headroom(s, d)),
    "silhouette_euclid": lambda s, d: rounded(E.silhouette(points(s, d), "v", "label", "vec_id")),
    "adjusted_rand": lambda s, d: rounded(E.adjusted_rand(points(s, d), "label", "g")),
    "kmeans_scan": lambda s, d: rounded(L.kmeans_scan(points(s, d), "v", "vec_id", "label", range(2, 11))),
    "segmentation": lambda s, d: rounded(segments(s, d)),
    "describe": lambda s, d: rounded(E.describe(power(s, d), [Y, P])),
    "wide_panel": lambda s, d: rounded(L.wide_panel(power(s, d), Y, ["a/pdu0", "b/pdu1", "c/mvpp5"]), 9),
    "reserve_shortfall": lambda s, d: rounded(L.reserve_shortfall(power(s, d), Y, 3)),
    "tod_step_r2": lambda s, d: rounded(step_profile(s, d)),
    "clock_resolutions": lambda s, d: rounded(clock_resolutions(s, d)),
    "ramp_detection": lambda s, d: rounded(ramp_detection(s, d)),
    "ramp_volatility": lambda s, d: rounded(ramp_volatility(s, d)),
    "paired_models": lambda s, d: rounded(paired_models(s, d)),
    "paired_clock": lambda s, d: rounded(paired_clock(s, d)),
    "flag_detection": lambda s, d: rounded(flag_detection(s, d)),
    "boost_per_unit": lambda s, d: rounded(ablation(s, d, "persistence", "boost")),
    "scalar_functions": lambda s, d: rounded(numbers(s, d)),
    "enum_decode": enums,
    "constraint_match": constraints,
}
assert C.DAY == 288

W0 = "WINDOW w AS (PARTITION BY unit ORDER BY step)"


def frame(fn: str, x: str, size: int, ends: int = 1) -> str:
    over = f"OVER (PARTITION BY unit ORDER BY step ROWS BETWEEN {ends + size - 1} PRECEDING AND {ends} PRECEDING)"
    return f"CASE WHEN count({x}) {over} = {size} THEN {fn}({x}) {over} END"


def tail_sql(x: str, alpha: float = 0.95, window: int = WEEK, h: int = 1) -> tuple[str, str]:
    over = f"OVER (PARTITION BY unit ORDER BY step ROWS BETWEEN {h + window - 1} PRECEDING AND {h} PRECEDING)"
    k = T.rank_in_window(alpha, window)
    return f"quantile_disc({x}, {alpha}) {over}", f"list_avg(list_sort(list({x}) {over})[{k + 2}:])"


def fhs_sql(h: int = 1) -> str:
    q, es = tail_sql("z", h=h)
    return f"""a AS (SELECT unit, step, u, lag(u, {h}) OVER w AS anchor, u - lag(u, {h}) OVER w AS d FROM power {W0}),
        b AS (SELECT *, {frame('stddev_samp', 'd', DAY, h)} AS sigma FROM a), zs AS (SELECT *, d / nullif(sigma, 0) AS z FROM b),
        e AS (SELECT unit, step, u, anchor, anchor + sigma * {q} AS var, anchor + sigma * {es} AS es, count(z) OVER (PARTITION BY unit ORDER BY step ROWS BETWEEN {h + WEEK - 1} PRECEDING AND {h} PRECEDING) AS held FROM zs),
        f AS (SELECT * FROM e WHERE step >= {WEEK + 2 * DAY} AND held = {WEEK} AND var IS NOT NULL AND es IS NOT NULL)"""


EQ, EES = tail_sql("u")
EMPIRICAL = f"f AS (SELECT * FROM (SELECT unit, step, u, {EQ} AS var, {EES} AS es FROM power) WHERE step >= {WEEK + 2 * DAY})"
BREACH = """x AS (SELECT *, CAST(u > var AS INTEGER) AS e FROM f), t AS (SELECT *, lag(e) OVER (PARTITION BY unit ORDER BY step) AS before, row_number() OVER (PARTITION BY unit ORDER BY step DESC) AS age FROM x),
        c AS (SELECT unit, count(*) AS n, sum(e)::BIGINT AS x, count(*) FILTER (before = 0 AND e = 0) AS n00, count(*) FILTER (before = 0 AND e = 1) AS n01, count(*) FILTER (before = 1 AND e = 0) AS n10, count(*) FILTER (before = 1 AND e = 1) AS n11,
          coalesce(sum(e) FILTER (age <= 250), 0)::BIGINT AS recent_x, least(count(*), 250) AS recent_n, coalesce(sum(u / es) FILTER (e = 1), 0) AS es_sum FROM t GROUP BY unit)"""
XL = lambda x: f"CASE WHEN {x} > 0 THEN ({x}) * ln({x}) ELSE 0 END"
KUPIEC = f"-2 * ((n - x) * ln(1 - 0.05) + x * ln(0.05) - ({XL('n - x')} + {XL('x')} - {XL('n')}))"
IND = f"greatest(0, -2 * (({XL('n00 + n10')} + {XL('n01 + n11')} - {XL('n00 + n01 + n10 + n11')}) - ({XL('n00')} + {XL('n01')} - {XL('n00 + n01')} + {XL('n10')} + {XL('n11')} - {XL('n10 + n11')})))"
FHS = fhs_sql()
CAP = "share AS (SELECT unit, greatest((u - p) / u, 0) AS s FROM power WHERE NOT badp), cs AS (SELECT unit, avg(s) AS cappable_share, stddev_samp(s) AS cappable_sd, count(*) AS n_trusted FROM share GROUP BY 1), ob AS (SELECT unit, 1 - avg(badp::INTEGER) AS obs_score, count(*) AS n FROM power GROUP BY 1)"
BOUND = "lam AS (SELECT greatest(coalesce(stddev_pop(cappable_share) FILTER (obs_score >= 0.999), 0), coalesce(stddev_pop(cappable_share) FILTER (obs_score < 0.5), 0)) AS bound FROM cs JOIN ob USING (unit))"
INC = "inc AS (SELECT * FROM (SELECT unit, step, u - lag(u) OVER w AS d FROM power WINDOW w AS (PARTITION BY unit ORDER BY step)) WHERE d IS NOT NULL), pairs AS (SELECT a.unit AS a, b.unit AS b, corr(a.d, b.d) AS corr FROM inc a JOIN inc b ON a.step = b.step AND a.unit < b.unit GROUP BY 1, 2)"
EVENTS = f"""rise AS (SELECT * FROM (SELECT unit, step, step % 24 AS tod, lead(u) OVER w - u AS rise FROM power {W0}) WHERE rise IS NOT NULL), cut AS (SELECT quantile_cont(rise, 0.99) AS cut FROM rise WHERE step < {SPLIT}),
        ev AS (SELECT unit, step, tod, CAST(rise >= cut AS INTEGER) AS event FROM rise, cut)"""
RATES = f"pr AS (SELECT avg(event) AS prior FROM ev WHERE step < {SPLIT}), rates AS (SELECT CAST(t.tod AS INTEGER) AS tod, count(event) AS n, (coalesce(sum(event), 0) + 20 * any_value(prior)) / (count(event) + 20) AS rate FROM range(24) AS t(tod) CROSS JOIN pr LEFT JOIN (SELECT * FROM ev WHERE step < {SPLIT}) e ON e.tod = t.tod GROUP BY t.tod)"
LABELS = "lab AS (SELECT doc_id, quality, n_chars::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"
ISLANDS = lambda src, keys, flag: f"""fl AS (SELECT *, CAST({flag} != coalesce(lag({flag}) OVER w, false) AS INTEGER) AS flip FROM {src} WINDOW w AS (PARTITION BY {keys} ORDER BY step)),
        ru AS (SELECT *, sum(flip) OVER (PARTITION BY {keys} ORDER BY step) AS run FROM fl)"""  # noqa: E731
LAGS = ", ".join([*(r(f"lag(u, {k}) OVER w", f"lag_{k}", 9) for k in (1, 2, 3, 6, 12)), *(r(f"u - lag(u, {k}) OVER w", f"d{k}", 9) for k in (1, 3, 6))])
ANGLE = "2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440"
DOW = "(isodow(ts) - 1)::INTEGER"
FF = f"""o AS (SELECT unit, cell, step, u, p, badp::INTEGER::DOUBLE AS badp, sin({ANGLE}) AS tod_sin, cos({ANGLE}) AS tod_cos, {DOW} AS dow, u - lag(u) OVER w AS d1, u - lag(u, 3) OVER w AS d3, u - lag(u, 6) OVER w AS d6, lag(u, 12) OVER w AS lag12, lag(u, {DAY}) OVER w AS lag_day, p - lag(p) OVER w AS p_d1,
        {frame('avg', 'u', 12)} AS roll_mean_h, {frame('stddev_samp', 'u', 12)} AS roll_std_h, {frame('stddev_samp', 'u', DAY)} AS roll_std_day, u - {frame('avg', 'u', DAY)} AS dev_from_day, u - p AS headroom FROM power {W0}),
        ff AS (SELECT *, avg(u) OVER s AS fleet_mean, stddev_samp(u) OVER s AS fleet_std, avg(d1) OVER s AS fleet_d1, avg(u) OVER c AS cell_mean, avg(d1) OVER c AS cell_d1, u - avg(u) OVER s AS rel_to_fleet FROM o WINDOW s AS (PARTITION BY step), c AS (PARTITION BY step, cell))"""
FLEET_COLS = [c for c in W.FLEET if c != "dow"]

def erfc_sql(z: str) -> str:
    """S.erfc() in SQL."""
    t, poly = f"(1 / (1 + ({z}) / 2))", str(S.ERFC[-1])
    for c in reversed(S.ERFC[:-1]):
        poly = f"({c} + {t} * {poly})"
    return f"{t} * exp(-({z}) * ({z}) + {poly})"


def chi2_sql(x: str) -> str:
    return erfc_sql(f"sqrt(greatest({x}, 0.0) / 2)")


FHS_AR = f"""a AS (SELECT unit, step, u, lag(u) OVER w AS anchor, u - lag(u) OVER w AS d, lag(u) OVER w - lag(u, 2) OVER w AS d1 FROM power {W0}), b AS (SELECT *, d * d1 AS num, d1 * d1 AS den FROM a),
        p AS (SELECT *, least(0.99, greatest(-0.99, coalesce({frame('sum', 'num', WEEK)} / nullif({frame('sum', 'den', WEEK)}, 0), 0))) AS phi FROM b), q AS (SELECT *, d - phi * d1 AS resid, anchor + phi * d1 AS center FROM p),
        g AS (SELECT *, {frame('stddev_samp', 'resid', DAY)} AS sigma FROM q), zs AS (SELECT *, resid / nullif(sigma, 0) AS z FROM g),
        e AS (SELECT unit, step, u, center + sigma * {tail_sql('z')[0]} AS var, center + sigma * {tail_sql('z')[1]} AS es, count(z) OVER (PARTITION BY unit ORDER BY step ROWS BETWEEN {WEEK} PRECEDING AND 1 PRECEDING) AS held FROM zs),
        f AS (SELECT * FROM e WHERE step >= {WEEK + 2 * DAY} AND held = {WEEK} AND var IS NOT NULL AND es IS NOT NULL)"""
ZONE = f"(SELECT least(1.0, sum(exp(lgamma(recent_n + 1) - lgamma(k + 1) - lgamma(recent_n - k + 1) + k * ln(0.05) + (recent_n - k) * ln(0.95)))) FROM range({B.RECENT + 1}) AS t(k) WHERE k <= recent_x)"


def pooled_sql(f: str) -> str:
    """A forecast's units, and all of them as one series."""
    return f.replace("f AS (", "f0 AS (") + ", f AS (SELECT unit, step, u, var, es FROM f0 UNION ALL SELECT 'ALL/POOLED', row_number() OVER (ORDER BY unit, step), u, var, es FROM f0)"


def limit_sql() -> str:
    """Forecasts of all leads and levels as rows, then what calibrate_by() and limit_curve() say, group by group."""
    parts, rows, nan = [], [], "coalesce(z, 'nan'::DOUBLE)"  # missing values sort last
    for h in LEADS:
        parts.append(f"""a{h} AS (SELECT unit, step, u, lag(u, {h}) OVER w AS anchor, u - lag(u, {h}) OVER w AS d FROM power {W0}), b{h} AS (SELECT *, {frame('stddev_samp', 'd', DAY, h)} AS sigma FROM a{h}), z{h} AS (SELECT *, d / nullif(sigma, 0) AS z FROM b{h})""")
        rows += [f"SELECT {h} AS h, {alpha}::DOUBLE AS alpha, unit, step, u, anchor, anchor + sigma * list_sort(list({nan}) OVER (PARTITION BY unit ORDER BY step ROWS BETWEEN {h + WEEK - 1} PRECEDING AND {h} PRECEDING))[{T.rank_in_window(alpha, WEEK) + 1}] AS var FROM z{h}" for alpha in C.LIMIT_ALPHAS]
    return f"""WITH {POWER}, {', '.join(parts)}, f AS (SELECT * FROM ({' UNION ALL '.join(rows)}) WHERE step >= {LIMIT_START} AND step % h = 0 AND var IS NOT NULL AND NOT isnan(var)),
        d AS (SELECT *, var - anchor AS spread, CASE WHEN var > anchor THEN (u - anchor) / (var - anchor) WHEN u > anchor THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END AS ratio FROM f),
        t AS (SELECT h, alpha, ratio, row_number() OVER (PARTITION BY h, alpha ORDER BY ratio) AS i, count(*) OVER (PARTITION BY h, alpha) AS n FROM d WHERE step < {SPLIT}),
        m AS (SELECT h, alpha, least(4.0, greatest(0.5, max(ratio))) AS m, any_value(n) AS n_train FROM t WHERE i = greatest(1, n - floor((1.0 - alpha) * n + 1e-9)) GROUP BY ALL),
        v AS (SELECT h, alpha, any_value(m) AS m, any_value(n_train) AS n_train, count(*) AS n_test, avg(CAST(u > anchor + spread AS INTEGER)) AS raw, avg(CAST(u > anchor + m * spread AS INTEGER)) AS cal, count(DISTINCT unit) AS units FROM d JOIN m USING (h, alpha) WHERE step >= {SPLIT} GROUP BY h, alpha),
        z AS (SELECT *, raw * n_test / greatest(1, units) AS per, abs(cal - (1 - alpha)) / (1 - alpha) AS err FROM v),
        l AS (SELECT h, alpha, unit, 1 / avg(anchor + m * spread) - 1 AS lim FROM d JOIN m USING (h, alpha) GROUP BY ALL), p AS (SELECT h, alpha, quantile_cont(lim, 0.1) AS p10, quantile_cont(lim, 0.5) AS p50, quantile_cont(lim, 0.9) AS p90, min(lim) AS worst FROM l GROUP BY ALL)
        SELECT h, {r('alpha', 'alpha')}, {r('m', 'm')}, n_train, n_test, {r('raw', 'raw_test')}, {r('cal', 'cal_test')}, {r('per', 'breaches_per_unit')}, {r('err', 'rel_error')}, CASE WHEN per >= 5 AND err <= 0.15 THEN 'validated' WHEN per >= 2 AND err <= 0.30 THEN 'marginal' ELSE 'underpowered' END AS verdict,
          {r('p10', 'p10')}, {r('p50', 'median')}, {r('p90', 'p90')}, {r('worst', 'worst')} FROM z JOIN p USING (h, alpha)"""


CLOCK_KEYS = {"half_day": "tod // 12", "hour": "tod", "hour_x_weekend": "tod + 24 * CAST(dow >= 5 AS INTEGER)", "hour_x_dow": "tod + 24 * dow"}
CLOCK_SQL = f"""k AS (SELECT *, step // 24 % 7 AS dow FROM ev), x AS ({' UNION ALL '.join(f"SELECT '{n}' AS feature, unit, step, event AS y, {k} AS key FROM k" for n, k in CLOCK_KEYS.items())}),
        pr AS (SELECT feature, avg(y) AS prior FROM x WHERE step < {SPLIT} GROUP BY 1), rt AS (SELECT feature, key, sum(y) AS hits, count(*) AS n FROM x WHERE step < {SPLIT} GROUP BY 1, 2),
        sc AS (SELECT x.feature, CASE WHEN step < {SPLIT} THEN 'train' ELSE 'test' END AS part, y, prior, (coalesce(hits, 0) + 20 * prior) / (coalesce(n, 0) + 20) AS p FROM x JOIN pr USING (feature) LEFT JOIN rt USING (feature, key)),
        dv AS (SELECT feature, part, 1 - sum(y * ln(p) + (1 - y) * ln(1 - p)) / sum(y * ln(prior) + (1 - y) * ln(1 - prior)) AS dev FROM sc GROUP BY 1, 2), g AS (SELECT feature, part, p, sum(y) AS pos, count(*) - sum(y) AS neg FROM sc GROUP BY 1, 2, 3),
        au AS (SELECT feature, part, sum(pos * (coalesce(below, 0) + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM (SELECT *, sum(neg) OVER (PARTITION BY feature, part ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM g) GROUP BY 1, 2)"""
LEADS_SQL = " UNION ALL ".join(f"SELECT {k} AS h, unit, step, roll_std_h, u, lead(u, {k}) OVER (PARTITION BY unit ORDER BY step) AS y FROM whole" for k in C.FLEET_HORIZONS)
VOLATILITY = f"""whole AS (SELECT unit, step, u, {r('roll_std_h', 'roll_std_h', 9)} FROM ff WHERE dev_from_day IS NOT NULL AND lag_day IS NOT NULL), ld AS (SELECT * FROM ({LEADS_SQL}) WHERE y IS NOT NULL),
        th AS (SELECT h, quantile_cont(y - u, 0.99) AS threshold FROM ld WHERE step < {SPLIT} GROUP BY h), ev AS (SELECT h, unit || '/' || step AS tie, roll_std_h AS score, CAST(y - u >= threshold AS INTEGER) AS event FROM ld JOIN th USING (h) WHERE step >= {SPLIT}),
        g AS (SELECT h, score, sum(event) AS p, count(*) AS n FROM ev GROUP BY 1, 2), k AS (SELECT *, sum(p) OVER d AS tp, sum(n) OVER d AS k, sum(n - p) OVER (PARTITION BY h ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM g WINDOW d AS (PARTITION BY h ORDER BY score DESC)),
        m AS (SELECT h, sum(p) / sum(n) AS base_rate, sum(p)::BIGINT AS n_events, sum(p * (coalesce(below, 0) + (n - p) / 2)) / nullif(sum(p) * sum(n - p), 0) AS auc, sum(p * tp / k) / nullif(sum(p), 0) AS ap FROM k GROUP BY h),
        rk AS (SELECT h, event, row_number() OVER (PARTITION BY h ORDER BY score DESC, tie) AS rn FROM ev), pn AS (SELECT h, coalesce(sum(event) FILTER (rn <= greatest(1, n_events)), 0) / greatest(1, any_value(n_events)) AS pn FROM rk JOIN m USING (h) GROUP BY h)"""
CHANGES = " UNION ALL ".join(f"SELECT {k} AS h, unit, step, step % {DAY} AS tod, u, lead(u, {k}) OVER (PARTITION BY unit ORDER BY step) AS y FROM power" for k in C.FLEET_HORIZONS)
PAIRED = f"""ld AS (SELECT * FROM ({CHANGES}) WHERE y IS NOT NULL), pf AS (SELECT h, unit, tod, avg(y - u) AS c FROM ld WHERE step < {SPLIT} GROUP BY ALL),
        ma AS (SELECT h, unit, avg(abs(y - (u + c))) AS a, avg(abs(y - u)) AS b FROM ld JOIN pf USING (h, unit, tod) WHERE step >= {SPLIT} GROUP BY ALL), gn AS (SELECT h, b, b - a AS d FROM ma),
        k AS (SELECT h, d, rank() OVER (PARTITION BY h ORDER BY abs(d)) + (count(*) OVER (PARTITION BY h, abs(d)) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY h, abs(d)) AS t FROM gn WHERE d != 0),
        s AS (SELECT h, count(*) AS n, coalesce(sum(rk) FILTER (d > 0), 0) AS w, sum(t::DOUBLE * t - 1) AS ties FROM k GROUP BY h), z AS (SELECT *, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s),
        m AS (SELECT h, quantile_cont(d / b, 0.5) * 100 AS gain, count(*) FILTER (d > 0) AS up, count(*) AS units FROM gn GROUP BY h)"""
TRIALS = ", ".join(str(t + SPLIT) for t in ONSETS if t + SPLIT + DAY <= A.STEPS)
SETTINGS = ", ".join([*(f"('{k}', {m}::DOUBLE)" for k in ("bias", "drift") for m in MAGNITUDES), "('stuck', NULL)"])
PEERS = f"""sums AS (SELECT step, sum(u) AS su, count(*) AS n FROM power GROUP BY 1), rr AS (SELECT unit, step, u AS y, u - (su - u) / (n - 1) AS resid FROM power JOIN sums USING (step)),
        ms AS (SELECT unit, avg(resid) AS mu, stddev_samp(resid) AS sd FROM rr WHERE step < {SPLIT} GROUP BY 1), z AS (SELECT rr.*, mu, sd, abs((resid - mu) / nullif(sd, 0)) AS z FROM rr JOIN ms USING (unit) WHERE step >= {SPLIT}),
        ta AS (SELECT unit, quantile_cont(z, 1 - 1 / {DAY}.0::DOUBLE) AS tau FROM z GROUP BY 1), fa AS (SELECT avg(rate) * {DAY} AS alarms, count(*) AS units FROM (SELECT unit, avg(CAST(z > tau AS INTEGER)) AS rate FROM z JOIN ta USING (unit) GROUP BY 1)),
        tr AS (SELECT z.*, tau, t, step - t AS i, max(CASE WHEN step = t THEN y END) OVER (PARTITION BY unit, t) AS y0 FROM z JOIN ta USING (unit), (SELECT unnest([{TRIALS}]) AS t) WHERE step >= t AND step < t + {DAY}),
        f AS (SELECT fault, magnitude, unit, t, min(i) FILTER (abs((resid + CASE fault WHEN 'bias' THEN magnitude WHEN 'drift' THEN magnitude * i / {DAY - 1} ELSE y0 - y END - mu) / sd) > tau) AS first FROM tr, (VALUES {SETTINGS}) AS c(fault, magnitude) GROUP BY ALL)"""
LEVELS = INC.replace("inc AS (SELECT * FROM (SELECT unit, step, u - lag(u) OVER w AS d FROM power WINDOW w AS (PARTITION BY unit ORDER BY step)) WHERE d IS NOT NULL)", "inc AS (SELECT unit, step, u AS d FROM power)")
MOMENTS = f"{A.UNITS} AS n, {A.UNITS}::DOUBLE AS trace"
RAMPS = " UNION ALL ".join(f"SELECT {k} AS h, step, (u - lag(u, {k}) OVER (ORDER BY step)) * 1000 AS mw FROM site" for k in C.FLEET_HORIZONS)

ORACLES = {
    "backtest_panel": f"""WITH {POWER}, {pooled_sql(FHS_AR)}, {BREACH}, y AS (SELECT *, {KUPIEC} AS uc, {IND} AS ind, {ZONE} AS cum FROM c)
        SELECT unit, n, x, n00, n01, n10, n11, recent_x, recent_n, {r('es_sum', 'es_sum')}, {r('n * (1 - 0.95)', 'expected')}, {r('x / n', 'rate')}, {r('uc', 'kupiec_lr')}, {r('ind', 'ind_lr')}, {r('uc + ind', 'cc_lr')}, {r('exp(-(uc + ind) / 2)', 'cc_p')}, {r('cum', 'cum_prob')},
          CASE WHEN cum < 0.95 THEN 'green' WHEN cum < 0.9999 THEN 'yellow' ELSE 'red' END AS basel_zone, {r('CASE WHEN x > 0 THEN es_sum / (n * 0.05) - 1 END', 'es_z2')}, {r(chi2_sql('uc'), 'kupiec_p')}, {r(chi2_sql('ind'), 'ind_p')} FROM y""",
    "limit_curve": limit_sql(),
    "clock_resolutions": f"WITH {POWER}, {EVENTS}, {CLOCK_SQL} SELECT feature, part, {r('dev', 'deviance_explained')}, {r('auc', 'auc')} FROM dv JOIN au USING (feature, part)",
    "lag_diff_features": f"WITH {POWER} SELECT unit, step, {LAGS} FROM power {W0}",
    "trailing_stats": f"""WITH {POWER}, x AS (SELECT unit, step, {frame('avg', 'u', 12)} AS a, {frame('stddev_samp', 'u', 12)} AS b, {frame('avg', 'u', DAY)} AS c, {frame('max', 'u', DAY)} AS m, {frame('stddev_samp', 'u', DAY)} AS e FROM power)
        SELECT unit, step, {r('a', 'roll_mean_1h', 9)}, {r('b', 'roll_std_1h', 9)}, {r('c', 'roll_mean_1d', 9)}, {r('m', 'roll_max_1d', 9)}, {r('e', 'roll_std_1d', 9)}, {r('b / e', 'vol_ratio', 9)} FROM x WHERE c IS NOT NULL AND e > 0""",
    "clock_features": f"WITH {POWER} SELECT unit, step, hour(ts)::INTEGER AS tod, {r(f'sin({ANGLE})', 'tod_sin')}, {r(f'cos({ANGLE})', 'tod_cos')}, {DOW} AS dow, CAST({DOW} >= 5 AS INTEGER) AS weekend FROM power",
    "unit_features": f"""WITH {POWER}, x AS (SELECT unit, step, u AS y, {', '.join(f'lag(u, {k}) OVER w AS lag_{k}' for k in (1, 2, 3, 6, 12))}, lag(u, {DAY}) OVER w AS lag_day, lag(u, {7 * DAY}) OVER w AS lag_week, {frame('avg', 'u', 12)} AS roll_mean_1h, {frame('stddev_samp', 'u', 12)} AS roll_std_1h,
        {frame('avg', 'u', DAY)} AS roll_mean_1d, {frame('max', 'u', DAY)} AS roll_max_1d, {frame('stddev_samp', 'u', DAY)} AS roll_std_1d, lag(p) OVER w AS prod_lag_1, lag(u - p) OVER w AS headroom_lag_1, sin({ANGLE}) AS tod_sin, cos({ANGLE}) AS tod_cos, {DOW} AS dow FROM power {W0})
        SELECT unit, step, dow, {', '.join(r(c, c, 9) for c in ('y', 'lag_1', 'lag_2', 'lag_3', 'lag_6', 'lag_12', 'lag_day', 'lag_week', 'roll_mean_1h', 'roll_std_1h', 'roll_mean_1d', 'roll_max_1d', 'roll_std_1d', 'prod_lag_1', 'headroom_lag_1', 'tod_sin', 'tod_cos'))}, {r('roll_std_1h / roll_std_1d', 'vol_ratio', 9)} FROM x WHERE lag_week IS NOT NULL AND roll_std_1d > 0""",
    "fleet_features": f"WITH {POWER}, {FF} SELECT unit, cell, step, dow, {', '.join(r(c, c, 9) for c in FLEET_COLS)} FROM ff WHERE dev_from_day IS NOT NULL AND lag_day IS NOT NULL",
    "ar1_slope": f"""WITH {POWER}, a AS (SELECT unit, step, u - lag(u) OVER w AS d, lag(u) OVER w - lag(u, 2) OVER w AS d1 FROM power {W0}), b AS (SELECT *, d * d1 AS num, d1 * d1 AS den FROM a),
        c AS (SELECT unit, step, {frame('sum', 'num', WEEK)} AS num, {frame('sum', 'den', WEEK)} AS den FROM b) SELECT unit, step, {r('least(0.99, greatest(-0.99, coalesce(num / nullif(den, 0), 0)))', 'phi')} FROM c""",
    "rolling_tail_q": f"WITH {POWER}, x AS (SELECT unit, step, {EQ} AS q FROM power) SELECT unit, step, {r('q', 'q', 9)} FROM x WHERE step >= {WEEK}",
    "rolling_tail_es": f"WITH {POWER}, x AS (SELECT unit, step, {EES} AS es FROM power) SELECT unit, step, {r('es', 'es', 9)} FROM x WHERE step >= {WEEK}",
    "empirical": f"WITH {POWER}, {EMPIRICAL} SELECT unit, step, {r('var', 'var', 9)}, {r('es', 'es', 9)} FROM f",
    "fhs": f"WITH {POWER}, {FHS} SELECT unit, step, {r('var', 'var')}, {r('es', 'es')} FROM f",
    "fhs_horizon": f"WITH {POWER}, {fhs_sql(3)} SELECT unit, step, {r('var', 'var')}, {r('es', 'es')} FROM f WHERE step % 3 = 0",
    "kupiec": f"WITH {POWER}, {FHS}, {BREACH} SELECT unit, n, x, {r('n * (1 - 0.95)', 'expected')}, {r('x / n', 'rate')}, {r(KUPIEC, 'kupiec_lr')} FROM c",
    "christoffersen": f"WITH {POWER}, {FHS}, {BREACH} SELECT unit, n00, n01, n10, n11, {r(IND, 'ind_lr')} FROM c",
    "cond_coverage": f"WITH {POWER}, {FHS}, {BREACH} SELECT unit, {r(f'{KUPIEC} + {IND}', 'cc_lr')}, {r(f'exp(-({KUPIEC} + {IND}) / 2)', 'cc_p')} FROM c",
    "basel_zone": f"""WITH {POWER}, {FHS}, {BREACH}, z AS (SELECT unit, recent_x, (SELECT least(1.0, sum(exp(lgamma(recent_n + 1) - lgamma(k + 1) - lgamma(recent_n - k + 1) + k * ln(0.05) + (recent_n - k) * ln(0.95)))) FROM range(251) AS t(k) WHERE k <= recent_x) AS cum FROM c)
        SELECT unit, recent_x, {r('cum', 'cum_prob')}, CASE WHEN cum < 0.95 THEN 'green' WHEN cum < 0.9999 THEN 'yellow' ELSE 'red' END AS basel_zone FROM z""",
    "es_z2": f"WITH {POWER}, {FHS}, {BREACH} SELECT unit, {r('CASE WHEN x > 0 THEN es_sum / (n * 0.05) - 1 END', 'es_z2')} FROM c",
    "es_bootstrap": f"""WITH {POWER}, {FHS_AR}, br AS (SELECT unit, step, u / es AS ratio, u > var AS e FROM f), sz AS (SELECT unit, count(*) AS n, count(*) FILTER (e) AS x, sum(ratio) FILTER (e) AS seen FROM br GROUP BY 1), la AS (SELECT *, n * (1 - 0.95::DOUBLE) / x AS l FROM sz WHERE x > 0),
        ks AS (SELECT unit, k, sum(exp(-l + k * ln(l) - lgamma(k + 1))) OVER (PARTITION BY unit ORDER BY k) AS c FROM la, range(10000) AS r(k) WHERE k <= ceil(l + 10 * sqrt(l) + 10)), cs AS (SELECT unit, list(c ORDER BY k) AS cdf FROM ks GROUP BY 1),
        drawn AS (SELECT br.unit, draw, ratio, cdf, CAST('0x' || substr(md5(br.unit || '/' || step || '/' || draw), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS h FROM br JOIN cs USING (unit), range(1, {B.DRAWS + 1}) AS d(draw) WHERE e),
        nu AS (SELECT unit, draw, sum(len(list_filter(cdf, lambda c: h >= c)) * ratio) AS s FROM drawn GROUP BY 1, 2)
        SELECT unit, {r('avg(CAST(s / (n * (1 - 0.95::DOUBLE)) - 1 >= seen / (n * (1 - 0.95::DOUBLE)) - 1 AS INTEGER))', 'es_p')} FROM nu JOIN la USING (unit) GROUP BY unit""",
    "backtest_pooled": f"WITH {POWER}, {FHS.replace('f AS (SELECT * FROM e', 'f0 AS (SELECT * FROM e')}, f AS (SELECT 'all' AS unit, row_number() OVER (ORDER BY unit, step) AS step, u, var, es FROM f0), {BREACH} SELECT n, x, n00, n01, n10, n11, recent_x, {r(KUPIEC, 'kupiec_lr')}, {r(IND, 'ind_lr')} FROM c",
    "clustering_stats": f"""WITH {POWER}, {EMPIRICAL.replace('f AS (', 'f0 AS (', 1)}, f AS (SELECT unit, step, u, var, es FROM f0 UNION ALL SELECT 'all', row_number() OVER (ORDER BY unit, step), u, var, es FROM f0), {BREACH},
        p AS (SELECT x / n AS rate, n01 / greatest(1, n00 + n01) AS p01, n11 / greatest(1, n10 + n11) AS p11 FROM c WHERE unit = 'all'), k AS (SELECT count(*) FILTER (exp(-({KUPIEC} + {IND}) / 2) > 0.05) AS cc_pass, count(*) AS n_units FROM c WHERE unit != 'all')
        SELECT {r('rate', 'rate')}, {r('p01', 'p01')}, {r('p11', 'p11')}, {r('p11 / nullif(p01, 0)', 'ratio')}, cc_pass, n_units FROM p, k""",
    "calibrate_multiplier": f"""WITH {POWER}, {fhs_sql(3)}, d AS (SELECT unit, step, u, anchor, var - anchor AS spread, CASE WHEN var > anchor THEN (u - anchor) / (var - anchor) WHEN u > anchor THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END AS ratio FROM f WHERE step % 3 = 0),
        t AS (SELECT ratio, row_number() OVER (ORDER BY ratio) AS i, count(*) OVER () AS n FROM d WHERE step < {SPLIT}), m AS (SELECT least(4.0, greatest(0.5, max(ratio))) AS m, any_value(n) AS n_train FROM t WHERE i = greatest(1, n - floor((1 - 0.95) * n + 1e-9))),
        v AS (SELECT any_value(m) AS m, any_value(n_train) AS n_train, count(*) AS n_test, avg(CAST(u > anchor + spread AS INTEGER)) AS raw, avg(CAST(u > anchor + m * spread AS INTEGER)) AS cal, count(DISTINCT unit) AS units FROM d, m WHERE step >= {SPLIT}),
        z AS (SELECT *, raw * n_test / greatest(1, units) AS per, abs(cal - (1 - 0.95)) / (1 - 0.95) AS err FROM v)
        SELECT {r('m', 'm')}, n_train, n_test, {r('raw', 'raw_test')}, {r('cal', 'cal_test')}, {r('per', 'breaches_per_unit')}, {r('err', 'rel_error')}, CASE WHEN per >= 5 AND err <= 0.15 THEN 'validated' WHEN per >= 2 AND err <= 0.30 THEN 'marginal' ELSE 'underpowered' END AS verdict FROM z""",
    "episodes": f"WITH {POWER}, {ISLANDS('power', 'cell, pdu', 'badm')} SELECT cell, pdu, count(*) AS n_intervals, min(ts) AS start, max(ts) AS \"end\" FROM ru WHERE badm GROUP BY cell, pdu, run",
    "global_episodes": f"WITH {POWER}, g AS (SELECT step, ts, bool_or(badm) AS badm, 1 AS k FROM power GROUP BY 1, 2), {ISLANDS('g', 'k', 'badm')} SELECT count(*) AS n_intervals, min(ts) AS start, max(ts) AS \"end\" FROM ru WHERE badm GROUP BY run",
    "frozen_rate": f"""WITH {POWER}, x AS (SELECT badm, badp, CAST(u < p AS INTEGER) AS v, CAST(coalesce(u = lag(u) OVER w, false) AS INTEGER) AS f FROM power {W0}),
        l AS (SELECT 'bad_measurement_data' AS flag, badm AS value, v, f FROM x UNION ALL SELECT 'bad_production_power_data', badp, v, f FROM x) SELECT flag, value, {r('avg(v)', 'p_violation')}, {r('avg(f)', 'p_frozen')}, count(*) AS n FROM l GROUP BY 1, 2""",
    "observability": f"WITH {POWER}, {CAP} SELECT unit, {r('obs_score', 'obs_score')}, n FROM ob",
    "cappable_share": f"WITH {POWER}, {CAP} SELECT unit, {r('cappable_share', 'cappable_share')}, {r('cappable_sd', 'cappable_sd')}, n_trusted FROM cs",
    "attribution_bound": f"WITH {POWER}, {CAP}, {BOUND} SELECT {r('bound', '"lambda"')} FROM lam",
    "risk_posture": f"""WITH {POWER}, {EMPIRICAL}, {CAP}, {BOUND}, k AS (SELECT unit, avg(var) AS par FROM f GROUP BY 1),
        t AS (SELECT unit, par, cappable_share, obs_score, greatest(0, coalesce(cappable_share, 0) * obs_score - bound * (1 - obs_score)) AS credit FROM k JOIN ob USING (unit) LEFT JOIN cs USING (unit), lam),
        v AS (SELECT *, 1 / par - 1 AS raw, (1 + credit) / par - 1 AS adj FROM t), z AS (SELECT quantile_cont(adj, 0.25) AS tight FROM v)
        SELECT unit, {r('par', 'par_99')}, {r('credit', 'capping_credit')}, {r('raw', 'limit_raw')}, {r('adj', 'limit_adj')}, {r('adj - raw', 'margin_cost')}, CASE WHEN cappable_share IS NULL THEN 'blind' WHEN adj < tight THEN 'tight' WHEN obs_score < 0.5 THEN 'degraded' ELSE 'ok' END AS posture FROM v, z""",
    "pairwise_corr": f"WITH {POWER}, {INC} SELECT a, b, {r('corr', 'corr')} FROM pairs",
    "n_eff": f"WITH {POWER}, {INC} SELECT {A.UNITS}::DOUBLE AS n_units, {r(f'{A.UNITS} * {A.UNITS} / ({A.UNITS} + 2 * sum(corr * corr))', 'n_eff')}, {r('avg(corr)', 'mean_corr')} FROM pairs",
    "n_eff_levels": f"WITH {POWER}, {LEVELS} SELECT {A.UNITS}::DOUBLE AS n_units, {r(f'{A.UNITS} * {A.UNITS} / ({A.UNITS} + 2 * sum(corr * corr))', 'n_eff')}, {r('avg(corr)', 'mean_corr')} FROM pairs",
    "spectrum_moments": f"""SELECT 'change' AS form, {MOMENTS}, {r(f'{A.UNITS} + 2 * (WITH {POWER}, {INC} SELECT sum(corr * corr) FROM pairs)', 'squares')} UNION ALL
        SELECT 'level', {MOMENTS}, {r(f'{A.UNITS} + 2 * (WITH {POWER}, {LEVELS} SELECT sum(corr * corr) FROM pairs)', 'squares')}""",
    "ramp_volatility": f"WITH {POWER}, {FF}, {VOLATILITY} SELECT h, 'volatility_persistence' AS detector, {r('base_rate', 'base_rate')}, n_events, {r('auc', 'auc')}, {r('ap', 'average_precision')}, {r('pn', 'precision_at_n')}, {r('threshold', 'threshold')} FROM m JOIN pn USING (h) JOIN th USING (h)",
    "paired_clock": f"WITH {POWER}, {PAIRED} SELECT h, 'clock' AS better, 'persistence' AS vs, {r('gain', 'median_gain_pct')}, up AS units_improved, units AS n_units, n, {r('w', 'w_plus')}, {r('z', 'z')}, {r(chi2_sql('z * z'), 'p_value')} FROM m JOIN z USING (h)",
    "fault_injection_peers": f"""WITH {POWER}, {PEERS} SELECT fault, {r('magnitude', 'magnitude')}, {r('avg(CAST(first IS NOT NULL AS INTEGER))', 'detection_rate')}, {r('quantile_cont(first, 0.5)', 'median_lag')}, count(*) AS trials, {r('any_value(alarms)', 'false_alarms_per_unit_day')},
        any_value(units) AS units_tested FROM f, fa GROUP BY fault, magnitude""",
    "reserve_inflation": f"""WITH {POWER}, {INC}, fl AS (SELECT stddev_samp(d) AS act, quantile_cont(d, 0.999) AS q FROM (SELECT step, avg(d) AS d FROM inc GROUP BY 1)), un AS (SELECT sqrt(sum(v)) AS s, count(*) AS n, avg(q) AS uq FROM (SELECT unit, var_samp(d) AS v, quantile_cont(d, 0.999) AS q FROM inc GROUP BY 1))
        SELECT {r('act / (s / n)', 'reserve_inflation')}, {r('act', 'fleet_ramp_sd')}, {r('uq', 'unit_p999')}, {r('q', 'fleet_p999')} FROM fl, un""",
    "diversity_factor": f"WITH {POWER} SELECT {r('(SELECT max(m) FROM (SELECT avg(u) AS m FROM power GROUP BY step)) / (SELECT avg(m) FROM (SELECT max(u) AS m FROM power GROUP BY unit))', 'diversity_factor')}",
    "share_up": f"WITH {POWER}, {INC}, st AS (SELECT step, avg(d) AS d, avg(CAST(d > 0 AS INTEGER)) AS up FROM inc GROUP BY 1), ct AS (SELECT quantile_cont(d, 0.99) AS cut FROM st) SELECT {r('avg(up) FILTER (d >= cut)', 'share_up_on_ramp')}, {r('avg(up)', 'share_up')} FROM st, ct",
    "smoothed_rate": f"WITH {POWER}, {EVENTS}, {RATES} SELECT tod, n, {r('rate', 'rate')} FROM rates",
    "deviance_explained": f"""WITH {POWER}, {EVENTS}, {RATES}, q AS (SELECT event AS y, rate AS p, prior AS p0 FROM ev JOIN rates USING (tod), pr WHERE step >= {SPLIT})
        SELECT {r('1 - sum(y * ln(p) + (1 - y) * ln(1 - p)) / sum(y * ln(p0) + (1 - y) * ln(1 - p0))', 'deviance_explained')} FROM q""",
    "spike_after_spike": f"WITH {POWER}, {EVENTS}, b AS (SELECT event, coalesce(lag(event) OVER (PARTITION BY unit ORDER BY step), 0) AS before FROM ev WHERE step >= {SPLIT}) SELECT {r('avg(event)', 'p_event')}, {r('avg(event) FILTER (before = 1)', 'p_after_event')}, {r('avg(event) FILTER (before = 0)', 'p_after_calm')} FROM b",
    "tod_profile_r2": f"""WITH {POWER}, pf AS (SELECT unit, step % 24 AS tod, avg(u) AS profile FROM power WHERE step < {SPLIT} GROUP BY 1, 2), x AS (SELECT u AS y, profile AS p FROM power JOIN pf ON power.unit = pf.unit AND step % 24 = tod WHERE step >= {SPLIT})
        SELECT {r('avg(abs(y - p))', 'mae')}, {r('sqrt(avg((y - p) * (y - p)))', 'rmse')}, {r('1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(y))', 'r2')}, {r('quantile_cont(abs(y - p), 0.95)', 'p95_abs_err')} FROM x""",
    "auc_exact": f"WITH {LABELS} SELECT {r('sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*)', 'auc')} FROM lab a, lab b WHERE a.quality = 1 AND b.quality = 0",
    "average_precision": f"WITH {LABELS}, g AS (SELECT score, sum(quality) AS p, count(*) AS n FROM lab GROUP BY 1), k AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS k FROM g) SELECT {r('sum(p * tp / k) / sum(p)', 'average_precision')} FROM k",
    "precision_at_n": f"WITH {LABELS}, x AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rn FROM lab) SELECT {r('avg(quality)', 'precision_at_n')}, count(*) AS n FROM x WHERE rn <= (SELECT sum(quality) FROM lab)",
    "wilcoxon_paired": f"""WITH {POWER}, d AS (SELECT round((u - p) * 1000) - 160 AS d FROM power), k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY abs(d)) AS t FROM d WHERE d != 0),
        s AS (SELECT count(*) AS n, coalesce(sum(rk) FILTER (d > 0), 0) AS w, sum(t::DOUBLE * t - 1) AS ties FROM k) SELECT n, {r('w', 'w_plus')}, {r('z', 'z')}, {r(chi2_sql('z * z'), 'p_value')} FROM (SELECT *, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s)""",
    "silhouette_euclid": f"""WITH q AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), m AS (SELECT a.vec_id, a.label AS la, b.label AS lb, avg(list_distance(a.e, b.e)) AS d FROM q a JOIN q b ON a.vec_id != b.vec_id GROUP BY 1, 2, 3),
        o AS (SELECT vec_id, max(d) FILTER (la = lb) AS own, min(d) FILTER (la != lb) AS other FROM m GROUP BY 1) SELECT {r('avg(coalesce((other - own) / greatest(own, other), 0))', 'silhouette')} FROM o""",
    "adjusted_rand": f"""WITH q AS (SELECT label AS a, vec_id % 7 AS b FROM embeddings), c AS (SELECT a, b, count(*) AS n FROM q GROUP BY 1, 2), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS x, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM q GROUP BY a)) AS pa,
        (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM q GROUP BY b)) AS pb, (SELECT count(*) FROM q) AS t) SELECT {r('(x - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2))', 'adjusted_rand')} FROM s""",
    "describe": f"""WITH {POWER}, x AS (SELECT 'measured_power_util' AS "column", u AS x FROM power UNION ALL SELECT 'production_power_util', p FROM power)
        SELECT "column", count(x) AS count, {r('avg(x)', 'mean')}, {r('stddev_samp(x)', 'std')}, {r('min(x)', 'min')}, {r('quantile_cont(x, 0.25)', 'q25')}, {r('quantile_cont(x, 0.5)', 'q50')}, {r('quantile_cont(x, 0.75)', 'q75')}, {r('max(x)', 'max')} FROM x GROUP BY 1""",
    "wide_panel": f"""WITH {POWER} SELECT step, {', '.join(r(f"max(u) FILTER (unit = '{k}')", f'"{k}"', 9) for k in ('a/pdu0', 'b/pdu1', 'c/mvpp5'))} FROM power GROUP BY 1""",
    "reserve_shortfall": f"""WITH {POWER}, inc AS (SELECT * FROM (SELECT unit, step, u - lag(u, 3) OVER w AS d FROM power {W0}) WHERE d IS NOT NULL), fl AS (SELECT stddev_samp(d) AS act FROM (SELECT avg(d) AS d FROM inc GROUP BY step)), un AS (SELECT sqrt(sum(v)) / count(*) AS ind FROM (SELECT var_samp(d) AS v FROM inc GROUP BY unit))
        SELECT 3 AS h, {r('act * 3000', 'actual_mw')}, {r('ind * 3000', 'independent_mw')}, {r('(act - ind) * 3000 / 9.6', 'short_engines')} FROM fl, un""",
    "tod_step_r2": f"""WITH {POWER}, {EVENTS}, pf AS (SELECT unit, tod, avg(rise) AS profile FROM rise WHERE step < {SPLIT} GROUP BY 1, 2), x AS (SELECT rise AS y, profile AS p FROM rise JOIN pf USING (unit, tod) WHERE step >= {SPLIT})
        SELECT {r('avg(abs(y - p))', 'mae')}, {r('sqrt(avg((y - p) * (y - p)))', 'rmse')}, {r('1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(y))', 'r2')}, {r('quantile_cont(abs(y - p), 0.95)', 'p95_abs_err')} FROM x""",
    "engine_conversion": f"""WITH {POWER}, site AS (SELECT step, avg(u) AS u FROM power GROUP BY 1), ramps AS ({RAMPS})
        SELECT h, {r('stddev_samp(mw)', 'sd_mw')}, {r('quantile_cont(mw, 0.99) FILTER (mw > 0)', 'p99_mw')}, {r('quantile_cont(mw, 0.999) FILTER (mw > 0)', 'p999_mw')}, {r('max(mw)', 'max_mw')}, {r('max(mw) / 9.6', 'max_engines')},
          {r(f'count(*) FILTER (step % h = 0 AND mw >= 9.6) / (count(*) FILTER (step % h = 0) * h / {DAY})', 'one_per_day')}, {r(f'7 * count(*) FILTER (step % h = 0 AND mw >= 19.2) / (count(*) FILTER (step % h = 0) * h / {DAY})', 'two_per_week')} FROM ramps WHERE mw IS NOT NULL GROUP BY h""",
    "fhs_ar": f"WITH {POWER}, {FHS_AR} SELECT unit, step, {r('var', 'var')}, {r('es', 'es')} FROM f",
    "scalar_functions": f"""SELECT x, (SELECT {r('least(1.0, sum(exp(lgamma(251) - lgamma(k + 1) - lgamma(251 - k) + k * ln(0.01) + (250 - k) * ln(0.99))))', 'b')} FROM range(16) AS t(k) WHERE k <= x) AS binom, {r('CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END', 'xlogx')}, {r('exp(-x / 2)', 'chi2_2')},
        CAST(round(x / 4 - 2) AS BIGINT) AS rounded, CAST(floor((x - 8) / 5) AS BIGINT) AS bucket FROM range(16) AS q(x)""",
    "enum_decode": f"WITH {A.USAGE_SQL} SELECT type, CASE type WHEN 0 THEN 'SUBMIT' WHEN 3 THEN 'SCHEDULE' END AS name, count(*) AS n FROM instance_events GROUP BY 1",
    "constraint_match": "SELECT p_partkey, coalesce(CASE p_partkey % 8 WHEN 0 THEN h AND p_size = 25 WHEN 1 THEN NOT (h AND p_size = 25) WHEN 2 THEN h AND p_size < 25 WHEN 3 THEN h AND p_size > 25 WHEN 4 THEN h AND p_size <= 25 WHEN 5 THEN h AND p_size >= 25 WHEN 6 THEN h WHEN 7 THEN NOT h END, false) AS holds FROM (SELECT *, p_partkey % 5 != 0 AS h FROM part)",
}
