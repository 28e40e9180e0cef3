"""Compression of vectors to codes: one byte per part, with codebooks learned in whole numbers.

Vectors become whole numbers and are cut into equal parts; each part position has a codebook. Assigning a part to its nearest
entry is screened by a float32 matrix product: |c|^2 - 2 x.c for all entries at once, each with an interval that bounds what
rounding may have changed. Entries whose interval overlaps the best are computed again in int64, and the first of the
nearest wins, so the codes are exact.

Each round is one pass over all vectors. A task adds up its parts by (position, entry), so what it sends has a size that
depends on the parameters alone, and so have the codebooks, which the driver makes of the sums and sends to the next round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm._support import join_by_key, keep

#: Components of which a chunk has about so many, whatever the vectors' length: bounds a worker's memory.
CHUNK = 1 << 19
UNIT = 2.0**-24  # rounding of float32


def largest_component(dims: int) -> int:
    """The bound within which squared distances of whole vectors fit 63 bits."""
    return 1 << (61 - max(1, dims - 1).bit_length()) // 2


def integers(values: np.ndarray, scale: int, dims: int) -> np.ndarray:
    """floor(scale * x) as int64, within the bound."""
    most = largest_component(dims)
    return np.clip(np.floor(values.astype(np.float64) * scale), -most, most).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x (n, s) the index of the nearest row of book (k, s), the first of equals, and the squared distance.

    Screening. With s terms, any order of summation and inputs rounded to float32, the computed |c|^2 - 2 x.c is off by
    no more than (s + 8) units of rounding of |c|^2 + 2 |x||c| (the usual bound gamma_n with n = s + 4, and Cauchy-Schwarz);
    twice that also covers the rounding of the bound itself and of the comparison."""
    n, s = x.shape
    wide, length = book.astype(np.float64), np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    square = (wide**2).sum(axis=1)
    guess = square.astype(np.float32) - np.float32(2) * (x.astype(np.float32) @ book.T.astype(np.float32))
    slack = (2 * (s + 8) * UNIT) * (square + 2 * length[:, None] * np.sqrt(square))
    least = (guess + slack).min(axis=1)
    row, entry = np.nonzero(guess - slack <= least[:, None])  # in order of row and entry; each row has one at least
    gap = ((x[row] - book[entry]) ** 2).sum(axis=1)
    starts = np.searchsorted(row, np.arange(n))
    best = np.minimum.reduceat(gap, starts) if n else gap
    hit = np.flatnonzero(gap == best[row])
    first = hit[np.searchsorted(row[hit], np.arange(n))]
    return entry[first], best


def _chunks(batches: Iterator[pa.RecordBatch], dims: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches cut to chunks, with their vectors as whole numbers (rows, dims)."""
    rows = max(1, CHUNK // dims)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            values = part.column("v").flatten().to_numpy(zero_copy_only=False)
            yield part, integers(values.reshape(part.num_rows, dims), scale, dims)


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label and v of the rows whose vector is there and has only finite components. A vector of no components is left out too."""
    v = F.col(f"`{vector_col}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & ~bad).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), v.alias("v"))


def first_books(rows: DataFrame, dims: int, parts: int, entries: int, scale: int) -> np.ndarray:
    """The parts of the vectors with the smallest ids: (parts, entries, dims / parts). Null ids come last; ties by vector.
    `entries` is a parameter, so what the driver sees is bounded."""
    held = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    x = integers(np.array([r.v for r in held], np.float64).reshape(len(held), dims), scale, dims)
    return x.reshape(len(held), parts, dims // parts).swapaxes(0, 1).copy()


def _moved(rows: DataFrame, books: np.ndarray, dims: int, scale: int) -> np.ndarray:
    """Codebooks whose entries are the floored means of the parts nearest to them; entries without parts stay."""
    parts, entries, s = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, total, count = shared.value, np.zeros((parts * entries, s), object), np.zeros(parts * entries, np.int64)
        for _, x in _chunks(batches, dims, scale):
            for p in range(parts):
                own = x[:, p * s : (p + 1) * s]
                code = nearest(own, books[p])[0]
                n = np.bincount(code, minlength=entries)
                order = np.argsort(code, kind="stable")
                used = np.flatnonzero(n)
                sums = np.add.reduceat(own[order], (np.cumsum(n) - n)[used], axis=0)
                total[p * entries + used] += sums  # whole numbers of any size
                count[p * entries : (p + 1) * entries] += n
        used = np.flatnonzero(count)
        cell, place = np.repeat(used, s), np.tile(np.arange(s), len(used))
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(place, pa.int32()), pa.array([str(v) for v in total[used].ravel()], pa.string()), pa.array(np.repeat(count[used], s), pa.int64())], ["cell", "place", "total", "n"])

    sums = rows.select("v").mapInArrow(run, "cell int, place int, total string, n long")
    found = sums.groupBy("cell", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()  # parts * entries * s rows at most
    out = books.reshape(parts * entries, s).copy()
    for r in found:
        out[r.cell, r.place] = int(r.total) // r.n
    return out.reshape(books.shape)


def learned(rows: DataFrame, dims: int, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> np.ndarray:
    """Codebooks after `rounds` rounds over all rows."""
    books = first_books(rows, dims, parts, entries, scale)
    for _ in range(rounds if books.size else 0):
        books = _moved(rows, books, dims, scale)
    return books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encoded(rows: DataFrame, books: np.ndarray, dims: int, scale: int = 256) -> DataFrame:
    """id, label, code (a byte per part), error (squared distance in whole numbers)."""
    parts, _, s = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _chunks(batches, dims, scale):
            code, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                code[:, p], gap = nearest(x[:, p * s : (p + 1) * s], shared.value[p])
                error += gap
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)], ["id", "label", "code", "error"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select("id", "label", "v").mapInArrow(run, f"id {kind['id']}, label {kind['label']}, code binary, error long")


def dimensions(rows: DataFrame, parts: int) -> int:
    """The length that most vectors have of those that can be cut into equal parts, the smaller of equals; 0 without any."""
    lengths = rows.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n")).where(F.col("dims") % parts == 0)
    found = lengths.orderBy(F.col("n").desc(), "dims").first()
    return found.dims if found else 0


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(id, code, error, label_error; codebooks). label_error adds up the errors of equal labels; rows without label are one group.

    Rows whose vector is null or empty or has a null or non-finite component are left out, and those whose length is not that of most
    vectors. Repeated rows are rows of their own; null ids are kept. Fewer vectors than entries make smaller codebooks; an
    empty table gives an empty result. Components are held within largest_component() of the scaled value, so that errors fit a long
    (for 64 dimensions and a scale of 256, values up to half a million are exact). Other columns are dropped before use."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte per part: 1 to 256 entries")
    rows = usable(vectors, id_col, vector_col, label_col)
    dims = dimensions(rows, parts)
    if not dims:
        empty = vectors.select(F.col(f"`{id_col}`").alias("id")).where("false").selectExpr("id", "CAST(NULL AS binary) AS code", "CAST(NULL AS long) AS error", "CAST(NULL AS long) AS label_error")
        return empty, np.zeros((parts, 0, 0), np.int64)
    rows = rows.where(F.size("v") == dims)
    books = learned(rows, dims, parts, entries, rounds, scale)
    label: Column = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    coded = keep(encoded(rows, books, dims, scale).withColumn("label", label), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    return join_by_key(coded, sums, ["label"], "n").select("id", "code", "error", "label_error"), books
