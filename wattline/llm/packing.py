"""Best-two-fit packing of tokenized documents into sequences of a fixed capacity.

A sequence is filled greedily (always the longest piece that still fits); then its smallest piece is
replaced by the two unpacked pieces that fit its expanded gap more tightly, if there are such.

Lengths are whole numbers up to the capacity, so the algorithm runs on the histogram of lengths
(at most `capacity` numbers, whatever the corpus) and makes patterns, each with the number of
sequences that repeat it. A pattern is repeated until one of its lengths has too few pieces left for
it, which at least halves what that length has left, so there are at most capacity * 33 patterns and
each names at most 90 lengths (distinct numbers that sum to 4096): the table of patterns is bounded
however large the corpus is; it is sent to the tasks in parts of a checked size. Pieces then find their places without meeting: a piece's rank among the
pieces of its length is its rank within its own task plus the number of such pieces in earlier tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm._support import keep, slices
from wattline.llm.bpe import BATCH_BYTES, crc, load, worker_encoder


#: Rows of the table of places that one broadcast holds (40 bytes each).
BROADCAST_ROWS = 2_000_000


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-two-fit on a histogram {length: pieces}: [([(length, copies), ...], sequences)].
    Ties take the longer first partner. An empty histogram gives no patterns."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    index = np.arange(capacity + 1)

    def fits() -> np.ndarray:
        """For each gap the longest length that is left and fits; 0 if none."""
        return np.maximum.accumulate(np.where(left > 0, index, 0))

    best, out = fits(), []
    while best[capacity]:
        gap, held = capacity, {}
        taken = best
        while gap and (length := int(taken[gap])):
            free = int(left[length]) - held.get(length, 0)
            if free <= 0:  # used up by this very sequence: look below it
                below = length - 1
                while below and left[below] - held.get(below, 0) <= 0:
                    below = int(taken[below]) if taken[below] < below else below - 1
                if not below:
                    break
                length, free = below, int(left[below]) - held.get(below, 0)
            n = min(gap // length, free)
            if not n:
                break
            held[length] = held.get(length, 0) + n
            gap -= n * length
        if gap and held:
            small = min(held)
            room = gap + small
            rest = left.copy()
            for length, n in held.items():
                rest[length] -= n
            rest[small] += 1
            longest = np.maximum.accumulate(np.where(rest > 0, index, 0))
            first = np.flatnonzero(rest[: room + 1] > 0)
            second = np.minimum(longest[room - first], first)
            pair = (second == first) & (rest[first] < 2)
            second[pair] = longest[first[pair] - 1]
            total = np.where(second > 0, first + second, 0)
            if len(total) and total.max() > small:
                at = int(np.flatnonzero(total == total.max())[-1])
                held[small] -= 1
                for length in (int(first[at]), int(second[at])):
                    held[length] = held.get(length, 0) + 1
                held = {length: n for length, n in held.items() if n}
        times = min(int(left[length]) // n for length, n in held.items())
        out.append((sorted(held.items(), reverse=True), times))
        for length, n in held.items():
            left[length] -= n * times
        best = fits()
    return out


def places(found: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by rank: runs of ranks sorted by (length, rank)."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for items, times in found:
        at = 0
        for length, n in items:
            rows.append((length, rank.get(length, 0), n, sequence, at))
            rank[length] = rank.get(length, 0) + n * times
            at += n * length
        sequence += times
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"key": a[:, 0] << 48 | a[:, 1], "rank": a[:, 1], "copies": a[:, 2], "sequence": a[:, 3], "offset": a[:, 4]}


def chunks(table: dict[str, np.ndarray], most: int | None = None) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    """The table of places cut by ranges of lengths (low, high, part) of at most BROADCAST_ROWS rows, or of one length."""
    length, most = table["key"] >> 48, most or BROADCAST_ROWS
    start = 0
    while True:
        stop = min(len(length), start + most)
        if stop < len(length):  # back to where its last length begins, or on to where its only one ends
            begins = int(np.searchsorted(length, length[stop], side="left"))
            stop = begins if begins > start else int(np.searchsorted(length, length[stop], side="right"))
        yield int(length[start]) if start < stop else 0, int(length[stop - 1]) if start < stop else 0, {k: v[start:stop] for k, v in table.items()}
        start = stop
        if start >= len(length):
            return


def tokenize_pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", held: int | None = None) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, and task and nth (its number among
    the task's pieces of this length). Null text is empty: one piece with the end id alone. `held` bounds the words that a worker
    caches (memory against time; no result depends on it)."""
    shared = docs.sparkSession.sparkContext.broadcast(load(docs.sparkSession, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = end_id.to_bytes(4, "little")
        encoder, seen, task = worker_encoder(shared.value, held), [0] * (capacity + 1), TaskContext.get().partitionId()
        for batch in slices(batches, "text", BATCH_BYTES):
            rows: list[tuple] = []
            for i, ids in zip(batch.column("id").to_pylist(), encoder.encode_all([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                data = ids + end
                size = len(data) // 4
                for piece, start in enumerate(range(0, size, capacity)):
                    length = min(capacity, size - start)
                    rows.append((i, piece, start, length, crc(data[4 * start : 4 * (start + length)]), seen[length]))
                    seen[length] += 1
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (batch.column("id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array(list(repeat(task, len(rows))), pa.int32())], ["id", "piece", "start", "length", "ids_crc32", "nth", "task"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, nth long, task int")


def pack_pieces(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to the pieces of tokenize_pieces().

    Null ids are packed like others. Repeated rows are separate pieces and each gets its own place;
    ties in length are placed by task and rank. An empty table gives an empty result.
    """
    pieces = keep(pieces, "pieces")
    spark = pieces.sparkSession
    counts = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    base = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    base = base.selectExpr("task", "length", "coalesce(base, 0L) AS base")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    table = places(patterns(histogram, capacity))

    def placed(rows: DataFrame, t: dict[str, np.ndarray]) -> DataFrame:
        shared = spark.sparkContext.broadcast(t)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = shared.value
            for b in batches:
                length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
                run = np.searchsorted(t["key"], length << 48 | rank, side="right") - 1
                since = rank - t["rank"][run]
                sequence, copy = t["sequence"][run] + since // t["copies"][run], since % t["copies"][run]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(t["offset"][run] + copy * length)],
                    ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
                )

        return rows.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

    ranked = pieces.join(base, ["task", "length"]).selectExpr("id", "piece", "start", "length", "ids_crc32", "base + nth AS rank")
    kind = pieces.schema["id"].dataType.simpleString()
    parts = list(chunks(table))
    if len(parts) == 1:
        return placed(ranked, parts[0][2])
    return reduce(DataFrame.unionByName, (placed(ranked.where(F.col("length").between(low, high)), t) for low, high, t in parts))


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", held: int | None = None) -> DataFrame:
    """Tokenize, cut what is longer than the capacity, and pack; see the functions above."""
    return pack_pieces(tokenize_pieces(docs, path, capacity, end_id, id_col, text_col, held), capacity)
