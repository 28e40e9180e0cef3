"""URL filters: rules by host and path, and boosted trees on lexical features for the rest.

The trees are trained from labelled URLs (by default those that the rules themselves decide) and become
SQL conditional expressions; features and scores are computed without Python.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm._sql import let, lets, quoted
from wattline.llm._support import hash_sample

#: Cells for suffixes: a host's last label, and its last two.
CELLS = 1024
SUFFIXES = ("regexp_extract(host, '([^.]*)$', 1)", "regexp_extract(host, '([^.]*[.]?[^.]*)$', 1)")
ALPHABET = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

ENTROPY = lets(
    ("n", "length(u)"),
    then="IF(n = 0, 0D, aggregate(array_distinct(split(u, '')), 0D, (a, c) -> a - IF(c = '', 0D, " + let("p", "(n - length(replace(u, c, ''))) / n", "p * ln(greatest(p, 1e-9D))") + ")))",
)
FEATURES = {
    "length": "CAST(length(u) AS double)",
    "depth": "CAST(size(split(path, '/')) - 1 AS double)",
    "digit_ratio": "length(regexp_replace(u, '[^0-9]+', '')) / greatest(length(u), 1)",
    "entropy": ENTROPY,
    "parameters": "CAST(IF(instr(u, '?') > 0, size(split(u, '[?&]')) - 1, 0) AS double)",
    "labels": "CAST(size(split(host, '[.]')) AS double)",
    "path_length": "CAST(length(path) AS double)",
    "fragment": "CAST(instr(u, '#') > 0 AS double)",
}


def parts(url: str = "url") -> tuple[str, str]:
    """SQL for host and path."""
    rest = f"substring({url}, instr({url}, '://') + 3)"
    has = f"coalesce(instr({url}, '://') > 0, false)"
    return (
        f"IF({has}, translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{ALPHABET[0]}', '{ALPHABET[1]}'), '')",
        f"IF({has}, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '')",
    )


def rule_cases(rules: dict[str, str]) -> tuple[str, str]:
    """SQL for the matching rule and its verdict; rules: {'host/path': 'allow' or 'block'}, a short list."""
    names, verdicts = [], []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        host, slash, path = rule.partition("/")
        fits = f"(host = {quoted(host)} OR endswith(host, {quoted('.' + host)})) AND startswith(path, {quoted(slash + path)})"
        names.append(f"WHEN {fits} THEN {quoted(rule)}")
        verdicts.append(f"WHEN {fits} THEN {quoted(rules[rule])}")
    end = "ELSE CAST(NULL AS string) END"
    return (f"CASE {' '.join(names)} {end}", f"CASE {' '.join(verdicts)} {end}") if names else ("CAST(NULL AS string)",) * 2


def train(x: np.ndarray, y: np.ndarray, rounds: int = 20, rate: float = 0.3, bins: int = 32) -> tuple[float, list[tuple]]:
    """Gradient-boosted trees of depth 2 for the logistic loss: (bias, trees); a tree is
    (feature, cut, (feature, cut, low, high), (feature, cut, low, high)). One class only: no trees."""
    share = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
    bias, trees = math.log(share / (1 - share)), []
    if not len(y) or y.min() == y.max():
        return bias, trees
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    score = np.full(len(y), bias)

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float, np.ndarray]:
        best = (-1.0, 0, 0.0)
        for f, options in enumerate(cuts):
            place = np.searchsorted(options, x[rows, f], side="left")
            gs, hs = (np.bincount(place, v[rows], len(options) + 1) for v in (g, h))
            gl, hl = np.cumsum(gs)[:-1], np.cumsum(hs)[:-1]
            gain = gl**2 / (hl + 1) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + 1)
            if len(gain) and gain.max() > best[0] + 1e-12:
                best = (float(gain.max()), f, float(options[int(gain.argmax())]))
        return best[1], best[2], x[:, best[1]] <= best[2]

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        f, cut, low = split(np.ones(len(y), bool), g, h)
        tree = [f, cut]
        for side in (low, ~low):
            f2, cut2, low2 = split(side, g, h)
            leaves = []
            for leaf in (side & low2, side & ~low2):
                value = rate * float(g[leaf].sum() / (h[leaf].sum() + 1))
                score[leaf] += value
                leaves.append(value)
            tree.append((f2, cut2, *leaves))
        trees.append(tuple(tree))
    return bias, trees


def margin(bias: float, trees: list[tuple]) -> str:
    """The ensemble as SQL over columns f0, f1, ..."""
    out = [f"{bias!r}D"]
    for f, cut, *sides in trees:
        low, high = (f"IF(f{g} <= {c!r}D, {a!r}D, {b!r}D)" for g, c, a, b in sides)
        out.append(f"IF(f{f} <= {cut!r}D, {low}, {high})")
    return " + ".join(out)


def measured(pages: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, u (the url, null as empty), host, path, rule, ruled, the suffix cells c0 and c1, and features f0, f1, ..."""
    host, path = parts()
    name, verdict = rule_cases(rules)
    rows = pages.selectExpr(f"`{id_col}` AS id", f"`{url_col}` AS url").selectExpr("id", "coalesce(url, '') AS u", f"{host} AS host", f"{path} AS path")
    cells = (f"CAST(pmod(xxhash64({e}), {CELLS}) AS int) AS c{i}" for i, e in enumerate(SUFFIXES))
    return rows.selectExpr("id", "u", "host", "path", f"{name} AS rule", f"{verdict} AS ruled", *cells, *(f"{e} AS f{i}" for i, e in enumerate(FEATURES.values())))


def suffix_counts(rows: DataFrame) -> np.ndarray:
    """Labelled rows and blocked ones by suffix cell, over all labelled rows of measured(): (kind, cell, 2)."""
    out = np.zeros((len(SUFFIXES), CELLS, 2))
    each = rows.where("ruled IS NOT NULL").select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"c{i}").alias("c")) for i in range(len(SUFFIXES))))).alias("x"), (F.col("ruled") == "block").cast("long").alias("y"))
    for r in each.groupBy("x.i", "x.c").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("b")).collect():  # at most kinds x cells
        out[r.i, r.c] = r.n, r.b
    return out


def suffix_odds(total: np.ndarray, blocked: np.ndarray, share: float) -> np.ndarray:
    """Smoothed log-odds of block."""
    return np.log((blocked + 10 * share + 0.5) / (total - blocked + 10 * (1 - share) + 0.5))


def learn(rows: DataFrame, sample: int = 10_000) -> tuple[np.ndarray, float, list[tuple]]:
    """(suffix odds, bias, trees) from the labelled rows of measured(): suffix statistics from all of them, trees from at
    most `sample` distinct URLs, chosen by hash (a bound). A URL that is trained on is left out of the suffix statistics
    that it is shown with, so that they don't tell its label."""
    n, k = len(FEATURES), len(SUFFIXES)
    counts = suffix_counts(rows)
    total, blocked = counts[0].sum(axis=0)
    share = float(blocked / total) if total else 0.5
    odds = suffix_odds(counts[..., 0], counts[..., 1], share)
    labelled = rows.where("ruled IS NOT NULL").selectExpr("xxhash64(u) AS h", "xxhash64(u, 1) AS h2", "ruled = 'block' AS y", *(f"c{i}" for i in range(k)), *(f"f{i}" for i in range(n)))
    chosen = hash_sample(labelled, sample, "h", "h2", distinct=True).collect()
    y = np.array([r.y for r in chosen], float)
    times = np.array([r.n for r in chosen], float)
    x = np.array([[r[f"f{i}"] for i in range(n)] for r in chosen], float).reshape(-1, n)
    for i in range(k):
        cell = np.array([r[f"c{i}"] for r in chosen], int)
        x = np.column_stack([x, suffix_odds(counts[i, cell, 0] - times, counts[i, cell, 1] - times * y, share)])
    return odds, *train(x, y)


def filter_urls(pages: DataFrame, rules: dict[str, str], sample: int = 10_000, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, score (the trees' log-odds of block) for every row.

    Trained on at most `sample` distinct URLs that a rule decides, chosen by hash (a bound). Suffix statistics are
    the smoothed log-odds of block of the host's last label and of its last two, over all rows that a rule decides,
    each hashed into 1024 cells. Null URLs and URLs without '://' have empty host and path and are left to the trees;
    without labelled URLs everything that no rule decides is allowed. Repeated rows get equal results; an empty
    table gives an empty one. Other columns are dropped before use.
    """
    rows, n = measured(pages, rules, id_col, url_col), len(FEATURES)
    odds, bias, trees = learn(rows, sample)
    tables = {f"f{n + i}": F.expr(f"element_at(array({', '.join(f'{v!r}D' for v in o)}), c{i} + 1)") for i, o in enumerate(odds.tolist())}
    scored = rows.withColumns(tables).withColumn("score", F.expr(margin(bias, trees)))
    return scored.selectExpr("id", "host", "path", "rule", "coalesce(ruled, IF(score > 0, 'block', 'allow')) AS verdict", "score")
