"""Language identification as inference in a mixture of languages.

A language is a distribution over hashed byte n-grams. A document is a mixture: expectation-maximisation
estimates each language's share of its n-grams from their likelihoods. The set of languages is chosen
by penalised likelihood: languages are admitted in order of their shares as long as the
likelihood of the mixture, with a cost for each language, improves. How well the chosen set fits is the mean
log-likelihood of an n-gram against a uniform background: below 0 the text is in none of the languages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm._support import release_slot, slices

CELLS = 1 << 16
#: Cells times languages that a model holds at most (4 bytes each), and the fewest cells: more languages share coarser cells.
HELD, LEAST_CELLS = 200 * CELLS, 1 << 8
#: Languages that a task counts before it hands on what it has.
COUNTED = 64
#: Longer texts are counted by cell.
LISTED = 1 << 13
LETTER = re.compile(r"[^\W\d_]")


def codes(text: str) -> np.ndarray:
    """Cells of the byte trigrams of a text, lower-cased, with a blank at either end."""
    b = np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8).astype(np.uint32)
    return ((b[:-2] * 65599 + b[1:-1] * 2654435761 + b[2:] * 40503) * np.uint32(2246822519) >> np.uint32(16)).astype(np.int64)


class Model:
    """Languages, their shares in training, and the likelihood ratio of each cell for each. Rows of `counts` are cells, a
    power of two of them; a text's cell is its hash's highest bits."""

    def __init__(self, names: list[str], counts: np.ndarray, docs: np.ndarray, smooth: float = 0.5):
        self.names, self.cells = names, len(counts)
        self.shift = CELLS.bit_length() - self.cells.bit_length()
        p = (counts + smooth) / (counts + smooth).sum(axis=0, keepdims=True)
        self.ratio = (p / p.mean(axis=1, keepdims=True)).astype(np.float32) if names else p.astype(np.float32)
        self.base = np.log(p.mean(axis=1) * self.cells).astype(np.float32) if names else np.zeros(0, np.float32)
        self.prior = (docs / docs.sum() if len(docs) else docs).astype(np.float32)

    def shares(self, x: np.ndarray, times: np.ndarray, prior: np.ndarray, steps: int, weight: float = 2.0) -> np.ndarray:
        """EM: the mixture's shares given the likelihoods of n-grams and how often each occurs."""
        pi, n = np.full(x.shape[1], 1 / x.shape[1], np.float32), float(times.sum())
        for _ in range(steps):
            new = ((pi * ((times / (x @ pi)) @ x) + weight * prior) / (n + weight)).astype(np.float32)
            if np.abs(new - pi).max() < 1e-3:
                return new
            pi = new
        return pi

    def judge(self, text: str | None, steps: int = 12, cost: float = 3.0) -> tuple[str, float, list[tuple[str, float]]]:
        """(language, its share, the chosen set with shares). No letters or no model: und."""
        return self.judge_fit(text, steps, cost)[:3]

    def judge_fit(self, text: str | None, steps: int = 12, cost: float = 3.0) -> tuple[str, float, list[tuple[str, float]], float | None]:
        """judge() and the mean log-likelihood of an n-gram under the chosen set against a uniform background."""
        if text is None or not self.names or not any(m.group().isalpha() for m in LETTER.finditer(text)):
            return "und", 0.0, [], None
        cell = codes(text) >> self.shift
        if len(cell) > LISTED:
            times = np.bincount(cell, minlength=self.cells)
            cell = np.flatnonzero(times)
            times = times[cell].astype(np.float32)
        else:
            times = np.ones(len(cell), np.float32)
        x, n = self.ratio[cell], float(times.sum())
        whole = self.shares(x, times, self.prior, steps)
        order = np.argsort(-whole, kind="stable")
        chosen, best = np.array([1.0]), float(times @ np.log(x[:, order[0]]))
        for size in range(2, len(order) + 1):
            if whole[order[size - 1]] < 0.02:
                break
            part = x[:, order[:size]]
            pi = self.shares(part, times, self.prior[order[:size]], steps)
            gain = float(times @ np.log(part @ pi))
            if gain - cost * np.log(n + 1) <= best:
                break
            chosen, best = pi, gain
        top = int(np.argmax(chosen))
        return self.names[order[top]], float(min(1.0, whole[order[top]])), [(self.names[order[i]], float(s)) for i, s in enumerate(chosen)], (best + float(times @ self.base[cell])) / n


def cells_for(languages: int) -> int:
    """Cells of a model of so many languages: all of them up to 200, then half as many whenever languages double."""
    return 1 << (min(CELLS, max(LEAST_CELLS, HELD // max(1, languages))).bit_length() - 1)


def train(docs: DataFrame, sample: int = 2000, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Count n-grams of about `sample` documents per language (a bound on the rows learned from; chosen by a hash of the id
    against the language's size). Every language is learned, however many there are. Null texts and languages are left out."""
    rows = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text", f"`{lang_col}` AS lang").where("text IS NOT NULL AND lang IS NOT NULL")
    sized = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("of"))
    sizes = {r.lang: r.of for r in sized.collect()}  # a row for each language
    names = sorted(sizes)
    if not names:
        return Model([], np.zeros((CELLS, 0)), np.zeros(0))
    spark, cells = docs.sparkSession, cells_for(len(names))
    shares = spark.createDataFrame([(k, min(1.0, sample / n)) for k, n in sizes.items()], "lang string, share double")
    chosen = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20)) < F.col("share"))
    fold = CELLS.bit_length() - cells.bit_length()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_slot()
        totals: dict[str, np.ndarray] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for lang, n in totals.items():
                found = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int32)), pa.array(n[found])], ["lang", "cell", "n"])
            totals.clear()

        for batch in slices(batches, "text"):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if lang not in totals:
                    if len(totals) >= COUNTED:
                        yield from handed_on()
                    totals[lang] = np.zeros(cells, np.int64)
                totals[lang] += np.bincount(codes(text) >> fold, minlength=cells)
        yield from handed_on()

    counted = chosen.select("text", "lang").mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    found = counted.toArrow()  # at most cells x languages
    counts = np.zeros((cells, len(names)))
    place = {k: i for i, k in enumerate(names)}
    counts[found.column("cell").to_numpy(), [place[k] for k in found.column("lang").to_pylist()]] = found.column("n").to_numpy()
    return Model(names, counts, np.array([sizes[k] for k in names], float))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score (0 to 1), lang_set (the chosen languages with their shares) and lang_fit
    (mean log-likelihood of an n-gram against a uniform background; negative: in none of the languages).

    Null text or text without a letter: `und`, score 0, empty set, null fit. Rows are judged alone on their whole text, so
    repeated rows get equal results; equal shares go to the language first in order. An empty
    table gives an empty result. Columns named like the new ones are replaced.
    """
    names = ["lang_pred", "lang_score", "lang_set", "lang_fit"]
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = docs.columns
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_slot()
        for batch in slices(batches, text_col):
            lang, score, chosen, fit = zip(*(shared.value.judge_fit(t) for t in batch.column(text_col).to_pylist()), strict=True)
            sets = pa.array([[{"lang": k, "share": v} for k, v in s] for s in chosen], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), sets, pa.array(fit, pa.float64())], [*fields, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "lang_pred string, lang_score double, lang_set array<struct<lang: string, share: double>>, lang_fit double"])
    return docs.mapInArrow(run, schema)
