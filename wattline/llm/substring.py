"""Exact removal of repeated word passages by seed and extend over winnowed anchors.

Every window of 20 words is represented by its anchor: of the 8-word sequences inside it, the
one with the smallest hash (winnowing; leftmost of equals). Equal windows have equal anchors at equal
places, so documents need to be joined only on anchors. An anchor's occurrence carries every way to extend
the seed to a whole window, so many words to the left and the rest to the right, as the 64-bit hash of that window;
occurrences of one anchor that agree on an extension share that passage, and the union of the windows that
also start earlier is the maximal repeat to remove.

Nothing is compared in pairs: per anchor and extension the earliest occurrence is found
by sorting. Each task first does this for its own block and sends a window once however often the block
repeats it. Anchors that are common in a sample of the documents are dealt by extension instead of by anchor, and their
blocks meet in two rounds, so that neither a passage that a third of all documents share nor the
many contexts around it come to one task; the sample decides the cost, never the result. Windows are equal if
anchor (48 bits and the bucket), place in the run and window hash (64 bits) are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from wattline.llm._support import raw, slices

ODD = 0x9E3779B97F4A7C15
BLOCK_BYTES = 10 << 20
#: Groups in which blocks meet first for common anchors.
PARTS = 256


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words by doubling; the result is size - 1 shorter."""
    out, length, base = None, 0, ODD
    power, width = h, 1
    while True:
        if size & width:
            out, length = (power, width) if out is None else (out[: len(out) - width] * np.uint64(pow(ODD, width, 1 << 64)) + power[length:], length + width)
        if width * 2 > size:
            return out
        power = power[:-width] * np.uint64(base) + power[width:]
        base, width = base * base % (1 << 64), width * 2


def _least(h: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each `size` consecutive numbers."""
    low, width = h, 1
    while width * 2 <= size:
        low, width = np.minimum(low[:-width], low[width:]), width * 2
    return low if width == size else np.minimum(low[: len(h) - size + 1], low[size - width :])


def _ranges(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, sorted by document and place, as runs: document, first start, windows."""
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)]) if len(doc) else np.zeros(0, np.int64)
    return doc[new], start[new], np.diff(np.r_[new, len(doc)])


def _six(h: np.ndarray) -> np.ndarray:
    """The low 48 bits of each number, as rows of six bytes."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def _eight(b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = b.reshape(-1, 6)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of all texts, and the number of words of each."""
    hashed, sizes, digest = [np.zeros(0, np.uint64)], [], xxhash.xxh64_intdigest
    for text in texts:
        words = text.split()
        sizes.append(len(words))
        hashed.append(np.fromiter((digest(w, 7) for w in words), np.uint64, len(words)))
    return np.concatenate(hashed), np.array(sizes, np.int64)


def _windows(h: np.ndarray, size: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """For each window that lies in one text: the text's number, its place there, the window's own number, its anchor and
    the anchor's place in it."""
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(size)), size)
    n = len(h) - window + 1
    whole = np.flatnonzero(np.arange(n) - first[owner[:n]] + window <= size[owner[:n]])
    grams = _mix(_grams(h, seed))
    least = _least(grams, window - seed + 1)[whole]
    off = np.zeros(len(whole), np.uint8)
    for i in range(window - seed, -1, -1):
        off[grams[whole + i] == least] = i
    return owner[whole], whole - first[owner[whole]], whole, least, off


def _seeds(block: list[tuple[int, bytes]], window: int, seed: int, buckets: int, hot: np.ndarray, part: int) -> Iterator[tuple[int, int, bytes]]:
    """A block's packs (bucket, part, bytes): its anchors with their windows, and what it found alone. Windows of the
    anchors `hot` (sorted) are dealt by window, and belong to `part`; all others to part 0."""
    block.sort(key=lambda x: x[0])
    h, size = _hash_words([text for _, text in block])
    if len(h) < window:
        return
    owner, start, whole, least, off = _windows(h, size, window, seed)
    full = _mix(_grams(h, window))[whole]
    doc = np.array([i for i, _ in block], np.int64)[owner]
    _, at, which = np.unique(full, return_index=True, return_inverse=True)
    earliest = at[which]
    same = (least == least[earliest]) & (off == off[earliest])
    late = ((doc != doc[earliest]) | (start != start[earliest])) & same
    d, s, k = _ranges(doc[late], start[late])
    if len(d):
        yield int(d[0]) % buckets, 0, _pack(1, d, s, k, np.zeros(0, np.uint8), np.zeros(len(d), np.uint8), np.zeros(0, np.uint64))
    sent = np.flatnonzero((earliest == np.arange(len(whole))) | ~same)
    common = np.isin(least[sent], hot)
    anchor = whole[sent] + off[sent]
    run = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (sent[1:] != sent[:-1] + 1) | common[1:]])
    count = np.diff(np.r_[run, len(sent)])
    key, windows = least[sent[run]], full[sent]
    common = common[run]
    bucket = (np.where(common, windows[run], key) >> np.uint64(16)).astype(np.int64) % buckets
    order = np.lexsort((common, bucket))
    edges = np.flatnonzero(np.r_[True, (bucket[order][1:] != bucket[order][:-1]) | (common[order][1:] != common[order][:-1]), True])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        chosen = order[a:b]
        k = count[chosen]
        index = np.repeat(run[chosen] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        first = sent[run[chosen]]
        yield int(bucket[chosen[0]]), part if common[chosen[0]] else 0, _pack(0, doc[first], start[first], k, _six(key[chosen]), off[first], windows[index])


def _pack(kind: int, doc: np.ndarray, start: np.ndarray, count: np.ndarray, key: np.ndarray, off: np.ndarray, windows: np.ndarray) -> bytes:
    """Column after column; document ids as differences from the least."""
    low = int(doc.min())
    wide = int(doc.max()) - low >= 1 << 32
    head = np.array([kind, len(doc), low, wide], "<i8").tobytes()
    return b"".join((head, (doc - low).astype("<i8" if wide else "<u4").tobytes(), start.astype("<u4").tobytes(), count.astype("<u4" if kind else "<u1").tobytes(), off.tobytes(), key.tobytes(), windows.astype("<u8").tobytes()))


def _unpack(data: bytes) -> tuple:
    kind, n, low, wide = np.frombuffer(data, "<i8", 4).tolist()
    at, out = 32, []
    for kind_of in ("<i8" if wide else "<u4", "<u4", "<u4" if kind else "<u1", "<u1"):
        out.append(np.frombuffer(data, kind_of, n, at).astype(np.int64))
        at += out[-1].size * np.dtype(kind_of).itemsize
    doc, start, count, off = out
    if kind:
        return kind, doc + low, start, count, off, None, None
    key = _eight(np.frombuffer(data, np.uint8, 6 * n, at))
    return kind, doc + low, start, count, off, key, np.frombuffer(data, "<u8", offset=at + 6 * n)


def _extend(packs: list[bytes], onward: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes | None]:
    """All packs of a bucket -> runs of windows that also start earlier: doc, start, windows; and with `onward` a pack of
    the earliest ones, each a run of its own, for the next round."""
    parts, done = [], []
    for data in packs:
        kind, doc, start, count, off, key, windows = _unpack(data)
        if kind:
            done.append((doc, start, count))
            continue
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        parts.append((np.repeat(doc, count), np.repeat(start, count) + step, np.repeat(off, count) - step, np.repeat(key, count), windows))
    rest = None
    if parts:
        doc, start, off, key, windows = (np.concatenate(x) for x in zip(*parts, strict=True))
        if not onward:  # most windows occur once
            content = _mix(windows ^ _mix(key)) ^ off.astype(np.uint64)
            order = np.argsort(content, kind="stable")
            same = content[order][1:] == content[order][:-1]
            shared = order[np.r_[False, same] | np.r_[same, False]]
            doc, start, off, key, windows = (x[shared] for x in (doc, start, off, key, windows))
        order = np.lexsort((start, doc, windows, off, key))
        doc, start, off, key, windows = (x[order] for x in (doc, start, off, key, windows))
        new = np.ones(len(doc), bool)
        new[1:] = (windows[1:] != windows[:-1]) | (key[1:] != key[:-1]) | (off[1:] != off[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
        late = (doc != doc[head]) | (start != start[head])
        if onward:
            one = np.ones(int(new.sum()), np.int64)
            rest = _pack(0, doc[new], start[new], one, _six(key[new]), off[new].astype(np.uint8), windows[new])
        doc, start = doc[late], start[late]
        order = np.lexsort((start, doc))
        done.append(_ranges(doc[order], start[order]))
    return (*(np.concatenate(x) for x in zip(*done, strict=True)), rest) if done else (*(np.zeros(0, np.int64),) * 3, rest)


def common_anchors(docs: DataFrame, window: int, seed: int, sample: int = 20_000, least: int = 20) -> np.ndarray:
    """Anchors of at least `least` documents of about `sample` (id, text) rows, chosen by hash: sorted, and at most a
    twentieth of the sample's anchors, whatever the input."""
    span = 1 << 20
    bound = int(min(1.0, sample / max(1, docs.count())) * span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            h, size = _hash_words([t or b"" for t in raw(batch, "text")])
            if len(h) < window:
                continue
            owner, _, _, key, _ = _windows(h, size, window, seed)
            pairs = np.unique(np.stack([owner.astype(np.uint64), key]), axis=1)[1]
            yield pa.RecordBatch.from_arrays([pa.array(pairs.view(np.int64))], ["key"])

    found = docs.where(F.pmod(F.xxhash64("id", "text"), F.lit(span)) < bound).mapInArrow(run, "key long").groupBy("key").count().where(F.col("count") >= least)
    return np.sort(found.select("key").toArrow().column("key").to_numpy().view(np.uint64))


def repeated_windows(docs: DataFrame, window: int = 20, seed: int = 8, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of windows whose words also start earlier: id, start, windows. `buckets` only sets how
    finely anchors are grouped for the shuffle (by default a bucket for each MB of input)."""
    if buckets is None:
        size = int(str(docs.select(text_col)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size >= 1 << 55:  # a plan without statistics: measure
            size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        buckets = max(64, size >> 20)
    buckets = min(buckets, 1 << 30)
    rows = _rows(docs, id_col, text_col).where("id IS NOT NULL AND text IS NOT NULL")
    shared = docs.sparkSession.sparkContext.broadcast(common_anchors(rows, window, seed))

    def sow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, number = [], 0, TaskContext.get().partitionId() * 7919

        def flush() -> pa.RecordBatch:
            found = list(_seeds(block, window, seed, buckets, shared.value, 1 + number % PARTS))
            return pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in found], pa.int32()), pa.array([p for _, p, _ in found], pa.int32()), pa.array([d for _, _, d in found], pa.binary())], ["bucket", "part", "pack"])

        for batch in slices(batches, "text"):
            for i, text in zip(batch.column("id").to_pylist(), raw(batch, "text"), strict=True):
                block.append((i, text))
                held += len(text)
                if held >= BLOCK_BYTES:
                    yield flush()
                    block, held, number = [], 0, number + 1
        if block:
            yield flush()

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        bucket, part = (k.as_py() for k in key)
        doc, start, count, rest = _extend(group.column("pack").to_pylist(), part > 0)
        out = [] if rest is None else [(bucket, rest)]
        if len(doc):
            out.append((int(doc[0]) % buckets, _pack(1, doc, start, count, np.zeros(0, np.uint8), np.zeros(len(doc), np.uint8), np.zeros(0, np.uint64))))
        return pa.table({"bucket": pa.array([b for b, _ in out], pa.int32()), "pack": pa.array([d for _, d in out], pa.binary())})

    def reap(group: pa.Table) -> pa.Table:
        doc, start, count, _ = _extend(group.column("pack").to_pylist())
        return pa.table({"id": pa.array(doc, pa.int64()), "start": pa.array(start, pa.int64()), "windows": pa.array(count, pa.int64())})

    met = rows.mapInArrow(sow, "bucket int, part int, pack binary").groupBy("bucket", "part").applyInArrow(meet, "bucket int, pack binary")
    return met.groupBy("bucket").applyInArrow(reap, "id long, start long, windows long")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{id_col} must be a whole number, as earlier means a smaller one: {kind.simpleString()}")
    return docs.selectExpr(f"CAST(`{id_col}` AS long) AS id", f"`{text_col}` AS text")


def cut_repeats(docs: DataFrame, window: int = 20, seed: int = 8, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed, kept (the words left, joined by one blank).

    Null, empty and short texts lose nothing. Rows that repeat an id count as one document: the same
    place in it is not earlier than itself, and what is found for any of them is cut in each. A row
    with a null id keeps all its words and is no one's original. An empty table gives an empty
    result; other columns are dropped before use. A text longer than a block is worked on whole. Ids are whole numbers.
    """
    found = repeated_windows(docs, window, seed, buckets, id_col, text_col)
    cuts = found.groupBy("id").agg(F.collect_list("start").alias("starts"), F.collect_list("windows").alias("counts"))
    rows = _rows(docs, id_col, text_col).join(cuts, "id", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n_words, n_removed, kept = [], [], []
            for text, starts, counts in zip(raw(batch, "text"), batch.column("starts").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                words = (text or b"").split()
                n_words.append(len(words))
                if starts:
                    gone = np.zeros(len(words) + 1, np.int32)
                    first = np.array(starts)
                    np.add.at(gone, np.minimum(first, len(words)), 1)
                    np.add.at(gone, np.minimum(first + np.array(counts) + window - 1, len(words)), -1)
                    stays = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                    n_removed.append(len(words) - len(stays))
                    words = [words[i] for i in stays.tolist()]
                else:
                    n_removed.append(0)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept"])

    return rows.select("id", "text", "starts", "counts").mapInArrow(cut, "id long, n_words long, n_removed long, kept string")
