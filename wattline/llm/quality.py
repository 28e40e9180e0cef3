"""Quality rules: statistics as SQL expressions and a learned decision list over them.

The list is learned by sequential covering: a conjunction of thresholds is grown on two thirds of the
labelled rows, adding the condition with the best information gain for rejecting, then pruned
from its end on the other third; the rows it covers are taken away and the next rule is learned, until
a rule is not precise enough. The result is an ordered list of Spark conditional expressions.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm._sql import SPACE_CLASS, SPACES, let, lets
from wattline.llm._support import hash_sample

FEATURES = {
    "n_words": "CAST(n_words AS double)",
    "mean_word": "word_chars / greatest(n_words, 1L)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1L)",
    "dup_lines": "CAST(n_dup_lines AS double)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1L)",
}
BASE = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def _statistics(text: str) -> str:
    """SQL for a struct of the five statistics of a string column; null is empty."""
    repeated = lets(
        ("s", "array_sort(transform(hs, (h, i) -> struct(h AS h, i AS i)))"),
        ("m", "size(s)"),
        ("p", "sort_array(transform(filter(s, (x, j) -> (j > 0 AND x.h = s[greatest(j - 1, 0)].h) OR (j < m - 1 AND x.h = s[least(j + 1, m - 1)].h)), x -> x.i))"),
        then="aggregate(p, named_struct('last', -3, 'n', 0L), (a, x) -> named_struct('last', x, 'n', a.n + least(3, x - a.last)), a -> a.n)",
    )
    windows = let("hs", "transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))", f"IF(size(array_distinct(hs)) = size(hs), 0L, {repeated})")
    lines = let("ls", f"filter(split(body, '\\n', -1), l -> l RLIKE '[^{SPACE_CLASS[1:]}')", "CAST(size(ls) - size(array_distinct(ls)) AS long)")
    return lets(
        ("body", f"coalesce({text}, '')"),
        ("core", f"trim(BOTH {SPACES} FROM body)"),
        ("w", f"IF(core = '', CAST(array() AS array<string>), split(core, '{SPACE_CLASS}+', -1))"),
        then=f"""named_struct('n_words', CAST(size(w) AS long), 'word_chars', CAST(length(array_join(w, '')) AS long),
            'n_symbols', CAST(length(regexp_replace(core, '[^#*$%&|<>]+', '')) AS long), 'n_dup_lines', {lines},
            'n_repeat_words', IF(size(w) < 3, 0L, {windows}))""",
    )


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every whole text. Null text
    has no words. Three-word windows are compared by a 64-bit hash within their own text."""
    return docs.selectExpr(f"`{id_col}` AS id", f"{_statistics(f'`{text_col}`')} AS st").selectExpr("id", "st.*")


def _grow(x: np.ndarray, bad: np.ndarray, depth: int) -> list[tuple[int, str, float]]:
    """Conditions (feature, operator, threshold), added while they gain information."""
    inside, rule = np.ones(len(bad), bool), []
    while len(rule) < depth and 0 < bad[inside].sum() < inside.sum():
        p0 = math.log2(bad[inside].mean())
        best = (1e-9, None, None)
        for f in range(x.shape[1]):
            values = np.unique(x[inside, f])
            cuts = (values[1:] + values[:-1]) / 2
            if len(cuts) > 64:
                cuts = np.unique(np.r_[cuts[np.linspace(0, len(cuts) - 1, 64).astype(int)]])
            for cut in cuts:
                for op in (">", "<="):
                    now = inside & ((x[:, f] > cut) == (op == ">"))
                    hits = bad[now].sum()
                    if hits and (gain := hits * (math.log2(hits / now.sum()) - p0)) > best[0]:
                        best = (gain, (f, op, float(cut)), now)
        if best[1] is None:
            break
        rule.append(best[1])
        inside = best[2]
    return rule


def covers(x: np.ndarray, rule: list[tuple[int, str, float]]) -> np.ndarray:
    inside = np.ones(len(x), bool)
    for f, op, cut in rule:
        inside &= (x[:, f] > cut) == (op == ">")
    return inside


def learn(x: np.ndarray, bad: np.ndarray, rules: int = 8, depth: int = 3, precision: float = 0.95, least: int = 10) -> list[list[tuple[int, str, float]]]:
    """Rules that reject, in order. None if a class is missing or nothing is precise enough."""
    found: list[list[tuple[int, str, float]]] = []
    part = np.arange(len(bad)) % 3 == 2
    while len(found) < rules and len(bad) and 0 < bad.sum() < len(bad):
        rule = _grow(x[~part], bad[~part], depth)

        def worth(r: list, x=x, bad=bad, part=part) -> float:
            inside = covers(x[part], r)
            return (bad[part][inside].sum() - (~bad[part][inside]).sum()) / inside.sum() if inside.any() else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        inside = covers(x, rule)
        if not rule or bad[inside].sum() < least or bad[inside].mean() < precision:
            break
        found.append(rule)
        x, bad, part = x[~inside], bad[~inside], part[~inside]
    return found


def decision_list(docs: DataFrame, labels: DataFrame, sample: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[list[tuple[int, str, float]]]:
    """Learn from at most `sample` labelled rows (a bound, chosen by a hash of the id): only their
    texts are measured and only their statistics reach the driver. Null labels are left out."""
    chosen = labels.selectExpr(f"`{id_col}` AS lid", f"`{label_col}` AS label").where("lid IS NOT NULL AND label IS NOT NULL")
    chosen = hash_sample(chosen, sample, "lid")
    texts = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").join(F.broadcast(chosen), F.col("id") == F.col("lid"))
    # The base rule is applied to the measured rows, here: as a filter it would be pushed below the join and measure every text.
    measured = texts.selectExpr("id", "label", f"{_statistics('text')} AS st").selectExpr("id", "label", "st.*")
    rows = measured.selectExpr("id", "label", f"({BASE}) AS base", *(f"{e} AS f{i}" for i, e in enumerate(FEATURES.values()))).orderBy("id", "f0", "f1").limit(sample).collect()
    rows = [r for r in rows if not r.base]
    x = np.array([[r[f"f{i}"] for i in range(len(FEATURES))] for r in rows], float).reshape(-1, len(FEATURES))
    return learn(x, np.array([r.label == 0 for r in rows], bool))


def rejects(rules: list[list[tuple[int, str, float]]]) -> str:
    """The decision list as one SQL conditional expression: true where a rule rejects."""
    names = list(FEATURES.values())
    arms = " ".join("WHEN " + " AND ".join(f"({names[f]}) {op} {cut!r}D" for f, op, cut in rule) + " THEN true" for rule in rules)
    return f"CASE {arms} ELSE false END" if arms else "false"


def judge(docs: DataFrame, labels: DataFrame, sample: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """statistics() with base_failed and kept.

    Null and empty texts have no words and fail the base rule. Without usable labels the base rule
    alone decides. Repeated rows are judged alike, null ids like others; an empty table gives an empty
    result. Other columns are dropped before use.
    """
    rules = decision_list(docs, labels, sample, id_col, text_col, label_col)
    st = statistics(docs, id_col, text_col).withColumn("base_failed", F.expr(BASE))
    return st.withColumn("kept", F.expr(f"NOT base_failed AND NOT ({rejects(rules)})"))
