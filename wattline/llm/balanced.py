"""Packing of tokenized documents into near-equal windows by multiway differencing.

Pieces are put into windows by the differencing method of Karmarkar and Karp: a partial partition is a list of window
loads, and the two with the largest imbalances are merged with their loads in opposite order, until one is left. Its windows are
near-equal. Where one exceeds the capacity, the number of windows rises, as long as that costs no more than a small share
of padding; where even that leaves windows too full, they give up their excess, cut off their longest piece, to windows with room.

A task packs what it reads, block by block, a block having a bounded number of windows and of pieces. Documents longer than a
window fill whole windows first. A block ends at a multiple of the capacity, and what is beyond goes on to the next, so only
a task's last block is padded for want of documents. Nothing is shuffled, and no task sees more than its own rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from wattline.llm._support import slices
from wattline.llm.bpe import BATCH_BYTES, crc, load, worker_encoder

#: Windows and pieces of a block. Pieces bound the time of short documents, windows that of long ones.
BLOCK_WINDOWS, BLOCK_PIECES = 256, 8192
#: Share of padding up to which the number of windows may rise.
PADDING = 0.005


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k - 1) of each size, loads being near-equal. Ties are merged in order of age.

    A partial partition keeps only its windows that hold something, so the first merges are short; a load is what it has
    above the smallest of the k. What came together in a window is a node over its two halves; windows are handed down at the end."""
    n = len(sizes)
    heap = [(-int(s), i, np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    joined: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    nodes, age = n, n
    while len(heap) > 1:
        (_, _, a, of_a), (_, _, b, of_b) = heapq.heappop(heap), heapq.heappop(heap)
        b, of_b = b[::-1], of_b[::-1]  # the fullest of one meets the emptiest of the other
        shared = max(0, len(a) + len(b) - k)
        alone = len(a) - shared
        loads = np.concatenate((a[:alone], a[alone:] + b[:shared], b[shared:]))
        held = np.concatenate((of_a[:alone], np.arange(nodes, nodes + shared), of_b[shared:]))
        if shared:
            joined.append((held[alone : len(a)], of_a[alone:], of_b[:shared]))
            nodes += shared
        if len(loads) == k:
            loads = loads - loads.min()
        order = np.argsort(-loads, kind="stable")
        heapq.heappush(heap, (-int(loads[order[0]]), age, loads[order], held[order]))
        age += 1
    window = np.zeros(nodes, np.int64)
    if heap:
        window[heap[0][3]] = np.arange(len(heap[0][3]))
    for node, left, right in reversed(joined):
        window[left] = window[right] = window[node]
    return window[:n]


def levelled(sizes: list[int], window: np.ndarray, k: int, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, window) with no window over the capacity: excess is cut off the longest pieces of full windows
    and put where there is room. k windows must have room for all."""
    load = np.bincount(window, sizes, k).astype(np.int64)
    out, loose = [], []
    members: list[list[int]] = [[] for _ in range(k)]
    for i, w in enumerate(window.tolist()):
        members[w].append(i)
    for w, inside in enumerate(members):
        over = max(0, int(load[w]) - capacity)
        for i in sorted(inside, key=lambda i: -sizes[i]):
            cut = min(over, sizes[i])
            over -= cut
            if cut:
                loose.append((i, sizes[i] - cut, cut))
            if cut < sizes[i]:
                out.append((i, 0, sizes[i] - cut, w))
    room = [(w, capacity - int(n)) for w, n in enumerate(load) if n < capacity]
    for i, start, length in loose:
        while length:
            w, free = room.pop()
            take = min(free, length)
            out.append((i, start, take, w))
            start, length = start + take, length - take
            if take < free:
                room.append((w, free - take))
    return out


def windows(sizes: list[int], capacity: int, padding: float = PADDING) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, window) of the pieces of one block, none longer than the capacity."""
    total = sum(sizes)
    least = -(-total // capacity)
    k, lengths = least, np.array(sizes, np.int64)
    while k:
        window = differencing(lengths, k)
        if np.bincount(window, lengths, k).max() <= capacity:
            return [(i, 0, n, w) for i, (n, w) in enumerate(zip(sizes, window.tolist(), strict=True))]
        if k == least:
            first = window
        if total < (1 - padding) * (k + 1) * capacity:
            return levelled(sizes, first, least, capacity)
        k += 1
    return []


class Packer:
    """One task's blocks: add() documents, then close(); both give finished pieces (row, start, data, doc_tokens, sequence, offset)."""

    def __init__(self, capacity: int):
        self.capacity, self.sequence = capacity, 0
        self.held: list[tuple[object, int, bytes, int]] = []  # row, start, ids, tokens of the document
        self.tokens = 0

    def add(self, row: object, data: bytes) -> Iterator[tuple]:
        size, start = len(data) // 4, 0
        while size - start >= self.capacity:
            yield row, start, data[4 * start : 4 * (start + self.capacity)], size, self.sequence, 0
            self.sequence += 1
            start += self.capacity
        if start < size:
            self.held.append((row, start, data[4 * start :], size))
            self.tokens += size - start
        if self.tokens >= BLOCK_WINDOWS * self.capacity or (len(self.held) >= BLOCK_PIECES and self.tokens >= self.capacity):
            yield from self._block()

    def _block(self) -> Iterator[tuple]:
        """Pack a multiple of the capacity; the rest, the last piece cut, stays for the next block."""
        rest, beyond = [], self.tokens % self.capacity
        while beyond:
            row, start, data, size = self.held.pop()
            n = len(data) // 4
            take = min(beyond, n)
            rest.append((row, start + n - take, data[4 * (n - take) :], size))
            if take < n:
                self.held.append((row, start, data[: 4 * (n - take)], size))
            beyond -= take
        yield from self.close()
        self.held = rest[::-1]
        self.tokens = sum(len(x[2]) // 4 for x in rest)

    def close(self) -> Iterator[tuple]:
        held, self.held, self.tokens = self.held, [], 0
        offset: dict[int, int] = {}
        for i, at, length, w in windows([len(x[2]) // 4 for x in held], self.capacity):
            row, start, data, size = held[i]
            yield row, start + at, data[4 * at : 4 * (at + length)], size, self.sequence + w, offset.get(w, 0)
            offset[w] = offset.get(w, 0) + length
        self.sequence += max(offset, default=-1) + 1


def pack_balanced(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", held: int | None = None) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (gapless from 0 in its sequence).

    A document is its ids and then `end_id`; null text is empty, so it is the end id alone. Ids play no part: null ids and repeated
    rows are documents like others. Equal lengths are packed in order of reading. An empty table gives an empty result; other columns
    are dropped before use. A task that runs again reads the same rows and packs them alike; sequences of a task are its
    partition's number and a count. `held` bounds the words that a worker caches (memory against time)."""
    shared = docs.sparkSession.sparkContext.broadcast(load(docs.sparkSession, path))
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, base = worker_encoder(shared.value, held), Packer(capacity), TaskContext.get().partitionId() << 32
        end, id_type = end_id.to_bytes(4, "little"), None

        def table(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*((r, start, len(data) // 4, crc(data), size, base + w, at) for r, start, data, size, w, at in rows), strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

        for batch in slices(batches, "text", BATCH_BYTES):
            id_type, rows = batch.column("id").type, []
            for i, ids in zip(batch.column("id").to_pylist(), encoder.encode_all([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                rows += packer.add(i, ids + end)
            yield table(rows)
        if id_type is not None:
            yield table(list(packer.close()))

    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
