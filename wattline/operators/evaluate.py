"""Scores of predictions and groupings, exact with ties.

Rank-based scores first count by distinct score, and running sums over those are cut into ranges.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions import scalars as S
from wattline.operators.ranked import quantile_row, quantiles_by, running
from wattline.scratch import forget, keep


def by_score(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Positives and rows per distinct score, with running totals from the highest (tp, k) and of negatives below the score."""
    d = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*keys, F.col(score).cast("double").alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    d = running(d.withColumn("_down", -F.col("s")), "_down", {"tp": F.col("p"), "k": F.col("n")}, keys).drop("_down")
    whole = d.groupBy(*(F.col(c).alias(f"_{c}") for c in keys)).agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    d = d.join(whole, [d[c].eqNullSafe(whole[f"_{c}"]) for c in keys]) if keys else d.join(F.broadcast(whole))
    return d.withColumn("below", (F.col("_n") - F.col("_p")) - (F.col("k") - F.col("tp"))).drop("_p", "_n", *(f"_{c}" for c in keys))


def auc(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve; tied pairs count half. Null for one class."""
    d = by_score(df, label, score, keys)
    wins = F.sum(F.col("p") * (F.col("below") + (F.col("n") - F.col("p")) / 2))
    return d.groupBy(*keys).agg(S.ratio(wins, F.sum("p").cast("double") * F.sum(F.col("n") - F.col("p"))).alias("auc"))


def average_precision(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    d = by_score(df, label, score, keys)
    return d.groupBy(*keys).agg(S.ratio(F.sum(F.col("p") * F.col("tp") / F.col("k")), F.sum("p").cast("double")).alias("average_precision"))


def precision_at_n(df: DataFrame, label: str, score: str, tie: str) -> DataFrame:
    """Precision among as many top scores as there are positives; ties go to the smaller `tie`. Rows without label or
    score are left out. Whole scores are counted; only the rows of the one score that the cut goes through are ordered."""
    d = by_score(df, label, score)
    n = d.agg(F.greatest(F.lit(1), F.sum("p")).alias("_top"))
    cut = d.join(F.broadcast(n)).where("k >= _top AND k - n < _top").select("s", "p", "tp", "n", "k", "_top").first()
    if cut is None:
        return d.agg(F.lit(None).cast("double").alias("precision_at_n"), F.lit(0).cast("long").alias("n"))
    rest, above = cut["_top"] - (cut["k"] - cut["n"]), cut["tp"] - cut["p"]
    tied = df.where((F.col(score).cast("double") == cut["s"]) & F.col(label).isNotNull()).select(F.col(label).cast("long").alias("y"), F.col(tie).alias("t")).orderBy("t").limit(rest)
    return tied.agg(((F.sum("y") + above) / F.lit(float(cut["_top"]))).alias("precision_at_n"), F.lit(cut["_top"]).cast("long").alias("n"))


def deviance_explained(df: DataFrame, label: str, p: str, p_null: float | str, eps: float = 1e-6, keys: Sequence[str] = ()) -> DataFrame:
    """Share of the deviance of a null prediction that another one saves, for each group of `keys`."""

    def deviance(q):
        q = S.clip(q, eps, 1 - eps)
        y = F.col(label).cast("double")
        return -2 * F.sum(y * F.log(q) + (1 - y) * F.log(1 - q))

    null = F.col(p_null) if isinstance(p_null, str) else F.lit(float(p_null))
    return df.groupBy(*keys).agg((1 - S.ratio(deviance(F.col(p)), deviance(null))).alias("deviance_explained"))


def errors(df: DataFrame, y: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, R2 and the 95th percentile of the absolute error. df is read three times: write it first if it is dear."""
    e = F.col(y) - F.col(pred)
    total = F.sum(F.col(y) * F.col(y)) - F.sum(y) * F.sum(y) / F.count(y)
    found = [F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - S.ratio(F.sum(e * e), total)).alias("r2")]
    if keys:
        top = quantiles_by(df.select(*keys, F.abs(e).alias("_e")), keys, "_e", {"p95_abs_err": 0.95})
        return joined_on(df.groupBy(*keys).agg(*found), top, keys)
    return df.agg(*found).join(F.broadcast(quantile_row(df.select(F.abs(e).alias("_e")), "_e", {"p95_abs_err": 0.95})))


def joined_on(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """a with b's columns where all keys agree, nulls with nulls; nulls where b has no such row."""
    b = b.withColumnsRenamed({k: f"_b_{k}" for k in keys})
    return a.join(b, [a[k].eqNullSafe(b[f"_b_{k}"]) for k in keys], "left").drop(*(f"_b_{k}" for k in keys))


def wilcoxon(df: DataFrame, diff: str) -> DataFrame:
    """Signed-rank test of paired differences (normal approximation, tie correction, zeros left out): n, w_plus, z and the
    two-sided p."""
    return wilcoxon_by(df, diff, ())


def wilcoxon_by(df: DataFrame, diff: str, keys: Sequence[str]) -> DataFrame:
    """wilcoxon() for each group of `keys`."""
    d = df.where(F.col(diff) != 0).select(*keys, F.col(diff).alias("d"), F.abs(diff).cast("double").alias("a"))
    c = d.groupBy(*keys, "a").agg(F.count(F.lit(1)).alias("t"), F.sum((F.col("d") > 0).cast("long")).alias("pos"))
    c = running(c, "a", {"upto": F.col("t")}, keys).withColumn("rank", F.col("upto") - (F.col("t") - 1) / 2)
    s = c.groupBy(*keys).agg(F.sum("t").alias("n"), F.sum(F.col("rank") * F.col("pos")).alias("w_plus"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    mean = F.col("n") * (F.col("n") + 1) / 4
    var = F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24 - F.col("ties") / 48
    return s.select(*keys, "n", "w_plus", S.ratio(F.col("w_plus") - mean, F.sqrt(var)).alias("z")).withColumn("p_value", S.chi2_sf1(F.col("z") * F.col("z")))


def silhouette(points: DataFrame, vector: str, label: str, key: str, block: int = 2048) -> DataFrame:
    """Mean Euclidean silhouette: one row. Points without a vector or label are left out, points alone in their group count 0."""
    return silhouettes(points, vector, [label], block).withColumnRenamed(label, "silhouette")


def silhouettes(points: DataFrame, vector: str, labels: Sequence[str], block: int = 2048) -> DataFrame:
    """Mean Euclidean silhouette of each of several groupings: one row, a column named after each. Distances need all pairs of distinct
    points, whatever the groupings: blocks of points meet in a cross join, so that none goes to the driver and a task
    holds a few blocks; a point sums its distances by group, so groups should be few (a number a point and group)."""
    n = len(labels)
    rows = points.select(F.col(vector).cast("array<double>").alias("v"), *(F.col(c).cast("string").alias(f"l{j}") for j, c in enumerate(labels)))
    rows = keep(rows.where("v IS NOT NULL").groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("w")), "points")
    sizes = [{r[0]: r[1] for r in rows.where(f"l{j} IS NOT NULL").groupBy(f"l{j}").agg(F.sum("w")).collect()} for j in range(n)]
    names = [sorted(s) for s in sizes]
    places = [{x: i for i, x in enumerate(x)} for x in names]
    size = [np.array([s[x] for x in x], float) for s, x in zip(sizes, names, strict=True)]
    cuts = np.cumsum([0, *map(len, names)])

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        group = np.array([part[f"l{j}"].map(places[j]).fillna(-1).to_numpy(np.int32) for j in range(n)], np.int32)
        return pd.DataFrame({"v": [np.array(part["v"].tolist(), float).tobytes()], "w": [part["w"].to_numpy(float).tobytes()], "g": [group.tobytes()]})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf])
            while len(held) >= block:
                yield packed(held.iloc[:block])
                held = held.iloc[block:]
        if held is not None and len(held):
            yield packed(held)

    def members(w: np.ndarray, g: np.ndarray) -> np.ndarray:
        out = np.zeros((len(w), cuts[-1]))
        for j in range(n):
            known = np.nonzero(g[j] >= 0)[0]
            out[known, cuts[j] + g[j][known]] = w[known]
        return out

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sums = None, None
        for pdf in batches:
            for i, v, j, u, w, g in zip(*(pdf[c] for c in ("block", "v", "block_b", "v_b", "w_b", "g_b")), strict=True):
                if at != i and at is not None:
                    yield pd.DataFrame({"block": [at], "sums": [sums.tobytes()]})
                w = np.frombuffer(w)
                y = np.frombuffer(u).reshape(len(w), -1)
                x = np.frombuffer(v).reshape(-1, y.shape[1])
                member = members(w, np.frombuffer(g, np.int32).reshape(n, -1))
                sums = np.zeros((len(x), cuts[-1])) if at != i else sums
                at = i
                for k in range(0, len(x), 512):
                    gaps = distances(x[k : k + 512], y)
                    if i == j:
                        np.fill_diagonal(gaps[:, k:], 0.0)
                    sums[k : k + 512] += gaps @ member
        if at is not None:
            yield pd.DataFrame({"block": [at], "sums": [sums.tobytes()]})

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        w, g = np.frombuffer(pdf["w"].iloc[0]), np.frombuffer(pdf["g"].iloc[0], np.int32).reshape(n, -1)
        sums, out = sum(np.frombuffer(s).reshape(len(w), -1) for s in pdf["sums"]), {}
        for j in range(n):
            known = np.nonzero(g[j] >= 0)[0]
            mine, own, i = g[j][known], sums[known, cuts[j] : cuts[j + 1]], np.arange(len(known))
            mean, own = own / size[j], own[i, mine] / np.maximum(size[j][mine] - 1, 1)
            mean[i, mine] = np.inf
            other = mean.min(axis=1, initial=np.inf)
            alone = (size[j][mine] < 2) | ~np.isfinite(other) | (np.maximum(own, other) == 0)
            each = np.where(alone, 0.0, (np.where(alone, 0.0, other) - own) / np.where(alone, 1.0, np.maximum(own, other)))
            out |= {f"s{j}": [float(each @ w[known])], f"n{j}": [float(w[known].sum())]}
        return pd.DataFrame(out)

    blocks = keep(rows.mapInPandas(pack, "v binary, w binary, g binary").withColumn("block", F.monotonically_increasing_id()), "blocks")
    forget(rows)
    tasks = min(max(1, blocks.count()), 4 * points.sparkSession.sparkContext.defaultParallelism)
    met = blocks.select("block", "v").repartition(tasks).crossJoin(blocks.select(*(F.col(c).alias(f"{c}_b") for c in ("block", "v", "w", "g"))))
    sums = met.mapInPandas(meet, "block long, sums binary").join(blocks.select("block", "w", "g"), "block")
    each = sums.groupBy("block").applyInPandas(score, ", ".join(f"s{j} double, n{j} double" for j in range(n)))
    return each.agg(*(S.ratio(F.sum(f"s{j}"), F.sum(f"n{j}")).alias(c) for j, c in enumerate(labels)))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows; those of close rows, where products of a matrix leave few digits, from differences."""
    center = y.mean(axis=0)
    u, v = x - center, y - center
    a, b = (u * u).sum(axis=1), (v * v).sum(axis=1)
    gaps = a[:, None] + b - 2 * u @ v.T
    i, j = np.nonzero(gaps <= 1e-7 * (a[:, None] + b))
    for at in range(0, len(i), 1 << 16):
        p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        gaps[p, q] = ((x[p] - y[q]) ** 2).sum(axis=1)
    return np.sqrt(gaps)


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two groupings, corrected for chance, from their contingency table."""
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    both = cells.agg(F.sum(pairs("n")).alias("both"), F.sum("n").alias("total"))
    side = lambda c, name: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(pairs("n")).alias(name))
    t = both.join(F.broadcast(side(a, "pa"))).join(F.broadcast(side(b, "pb")))
    expected = F.col("pa") * F.col("pb") / (F.col("total") * (F.col("total") - 1) / 2)
    return t.select(F.coalesce(S.ratio(F.col("both") - expected, (F.col("pa") + F.col("pb")) / 2 - expected), F.lit(1.0)).alias("adjusted_rand"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, extremes and exact (interpolated) quartiles, one row per column."""
    long = df.unpivot([], list(columns), "column", "x")
    out = long.groupBy("column").agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    quartiles = [quantile_row(df, c, {"q25": 0.25, "q50": 0.5, "q75": 0.75}).withColumn("column", F.lit(c)) for c in columns]
    return out.join(F.broadcast(reduce(DataFrame.unionByName, quartiles)), "column", "left").select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def paired_summary(pairs: DataFrame) -> DataFrame:
    """Of compare_models(): median gain in per cent, units improved, and the signed-rank test."""
    gain = pairs.agg((F.percentile(S.ratio("gain", "mae_b"), 0.5) * 100).alias("median_gain_pct"), F.sum((F.col("gain") > 0).cast("int")).alias("units_improved"), F.count(F.lit(1)).alias("n_units"))
    return gain.join(F.broadcast(wilcoxon(pairs, "gain").select("w_plus", "z", "p_value")))


def detection(df: DataFrame, label: str, score: str, tie: str) -> DataFrame:
    """AUC, average precision, precision among the top and base rate of an event score: one row."""
    base = df.agg(F.avg(F.col(label).cast("double")).alias("base_rate"), F.sum(F.col(label).cast("long")).alias("n_events"))
    return base.join(auc(df, label, score)).join(average_precision(df, label, score)).join(precision_at_n(df, label, score, tie).select("precision_at_n"))


def detections(df: DataFrame, label: str, score: str, tie: str, keys: Sequence[str]) -> DataFrame:
    """detection() for each group of `keys`, with n_events and base_rate, all from one table of counts by score. Ties at the
    cut go to the smaller `tie`: only the rows of the one score that it goes through are ordered."""
    d = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    s = keep(by_score(d, label, score, keys), "scores")
    p, n, neg = F.col("p"), F.col("n"), F.col("n") - F.col("p")
    whole = s.groupBy(*keys).agg(
        S.ratio(F.sum("p").cast("double"), F.sum("n")).alias("base_rate"), F.sum("p").alias("n_events"), S.ratio(F.sum(p * (F.col("below") + neg / 2)), F.sum("p").cast("double") * F.sum(neg)).alias("auc"),
        S.ratio(F.sum(p * F.col("tp") / F.col("k")), F.sum("p").cast("double")).alias("average_precision"), F.greatest(F.lit(1), F.sum("p")).alias("_top"),
    )
    cut = joined_on(s, whole.select(*keys, "_top"), keys).where((F.col("k") >= F.col("_top")) & (F.col("k") - n < F.col("_top")))
    cut = cut.select(*keys, F.col("s").alias("_s"), (F.col("_top") - F.col("k") + n).alias("_rest"), (F.col("tp") - p).alias("_above"))
    rows = d.select(*keys, F.col(score).cast("double").alias("_score"), F.col(label).cast("long").alias("_y"), F.col(tie).alias("_tie"))
    at = cut.withColumnsRenamed({k: f"_c_{k}" for k in keys})
    tied = rows.join(F.broadcast(at), [*(rows[k].eqNullSafe(at[f"_c_{k}"]) for k in keys), rows["_score"] == at["_s"]])  # a row for each group
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_tie"))
    hits = tied.withColumn("_nth", nth).where("_nth <= _rest").groupBy(*keys).agg((F.sum("_y") + F.max("_above")).alias("_hits"))
    return joined_on(whole, hits, keys).withColumn("precision_at_n", S.ratio(F.col("_hits").cast("double"), F.col("_top"))).drop("_hits", "_top")


def auc_interval(df: DataFrame, label: str, score: str, draws: int = 400, most: int = 2000, seed: int = 0) -> tuple[float, float]:
    """Bootstrap 95 % interval of the AUC from at most `most` rows of either class, chosen by hash (a bound)."""
    def pick(v: int) -> np.ndarray:
        rows = df.where(F.col(label).cast("int") == v).select(F.col(score).cast("double").alias("s"))
        n = rows.count()
        if n > 2 * most:  # a threshold first: not `most` rows of every partition
            rows = rows.where(F.pmod(F.xxhash64("s"), F.lit(1 << 40)) < int(2 * most / n * (1 << 40)))
        return np.array([r.s for r in rows.orderBy(F.xxhash64("s"), "s").limit(most).collect()])

    pos, neg, rng = pick(1), np.sort(pick(0)), np.random.default_rng(seed)
    if not len(pos) or not len(neg):
        return float("nan"), float("nan")

    def one(p: np.ndarray, n: np.ndarray) -> float:
        n = np.sort(n)
        return float((np.searchsorted(n, p, "left") + np.searchsorted(n, p, "right")).mean() / 2 / len(n))

    scores = [one(rng.choice(pos, len(pos)), rng.choice(neg, len(neg))) for _ in range(draws)]
    return float(np.quantile(scores, 0.025)), float(np.quantile(scores, 0.975))
