"""Balanced packing, importance resampling and vector codes: plain versions, hard cases, and the registered queries."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from fixtures import SCHEMA, documents
from tokenizers import Tokenizer

from wattline.llm import balanced, codes, queries, resample


# Balanced packing


def loads(sizes, window, k):
    return np.bincount(window, sizes, k)


def test_differencing_merges_opposing_imbalances():
    assert sorted(loads([8, 7, 6, 5, 4], balanced.differencing(np.array([8, 7, 6, 5, 4]), 2), 2).tolist()) == [14, 16]  # the textbook result
    rng = np.random.default_rng(0)
    for k, n in ((1, 5), (3, 3), (7, 200), (50, 120), (10, 4)):
        sizes = rng.integers(1, 500, n)
        window = balanced.differencing(sizes, k)
        assert len(window) == n and window.min() >= 0 and window.max() < k
        got = loads(sizes, window, k)
        if n >= 10 * k:
            assert got.max() - got.min() < sizes.min() + 20
    assert balanced.differencing(np.array([], int), 3).tolist() == []


@pytest.mark.parametrize("sizes", [[1100] * 40, [700] * 100, [1] * 5000, [2047] * 30, [2047, 1] * 10, [5], [*range(1, 2048, 7)], [600, 800] * 50])
def test_windows_hold_all_and_little_padding(sizes):
    got = balanced.windows(sizes, 2048)
    pieces = {i: [] for i in range(len(sizes))}
    for i, start, length, _ in got:
        pieces[i].append((start, length))
    for i, parts in pieces.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == sizes[i]
    load = Counter()
    for _, _, length, w in got:
        load[w] += length
    assert max(load.values()) <= 2048 and len(load) * 2048 * (1 - balanced.PADDING) <= max(sum(sizes), 2048 * (-(-sum(sizes) // 2048)) * (1 - balanced.PADDING))


def test_window_count_rises_where_little_is_lost():
    rng = np.random.default_rng(1)
    sizes = np.minimum(2047, rng.exponential(300, 1700).astype(int) + 1).tolist()
    got = balanced.windows(sizes, 2048, padding=0.03)
    assert len({w for *_, w in got}) > -(-sum(sizes) // 2048) and len(got) == len(sizes)  # nothing is cut


def judged(rows, texts, library, capacity):
    """Checks of a packing against the library's ids; returns padded tokens and all tokens."""
    ids = {i: [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in ts] for i, ts in texts.items()}
    want, got = Counter(), Counter()
    for i, all_ids in ids.items():
        for x in all_ids:
            want[i] += len(x)
    places = {}
    for r in rows:
        got[r["id"]] += r["length"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for x in ids[r["id"]])
    assert got == want
    used = []
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        used.append(at)
    return sum(capacity - n for n in used if n & (n - 1)), sum(used)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.TOKENIZER)


def test_pack_balanced_on_hard_cases(spark, library):
    rows = documents()
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(r[1])
    for parts in (1, 3):
        got = balanced.pack_balanced(spark.createDataFrame(rows, SCHEMA).repartition(parts), queries.TOKENIZER, capacity=256).collect()
        padded, total = judged([r.asDict() for r in got], texts, library, 256)
        assert padded < 256 * parts + 0.005 * total
    assert balanced.pack_balanced(spark.createDataFrame([], SCHEMA), queries.TOKENIZER).count() == 0


def test_blocks_end_at_whole_windows(monkeypatch):
    monkeypatch.setattr(balanced, "BLOCK_PIECES", 16)
    rng, packer, out, sizes = random.Random(3), balanced.Packer(64), [], {}
    for i in range(300):
        sizes[i] = rng.randint(1, 150)
        out += packer.add(i, np.arange(sizes[i], dtype="<u4").tobytes())
    out += packer.close()
    load, spans = Counter(), {}
    for i, start, data, size, w, _ in out:
        assert size == sizes[i] and np.frombuffer(data, "<u4").tolist() == [*range(start, start + len(data) // 4)]
        load[w] += len(data) // 4
        spans[i] = spans.get(i, 0) + len(data) // 4
    assert spans == sizes and max(load.values()) <= 64 and sum(load.values()) / 64 <= len(load) <= 1.01 * sum(load.values()) / 64 + 1


def test_op11(spark, sf, library):
    docs = {r.doc_id: [r.text] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [{**r.asDict(), "id": r.doc_id} for r in queries.op11_karmarkar_karp(spark, sf).collect()]
    padded, total = judged(got, docs, library, 2048)
    assert padded < 0.005 * total + 2048


# Importance resampling


def brute_resample(rows, target, longest=1, buckets=10_000, percent=10, least=20, seed="2024"):
    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return ws, [zlib.crc32(" ".join(ws[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]

    s, t = Counter(), Counter()
    found = [(i, *features(x)) for i, x in rows]
    for _, _, f in found:
        s.update(f)
    for x in target:
        t.update(features(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (total_s + buckets) / ((s[b] + 1.0) * (total_t + buckets)))) for b in range(buckets)}
    out = []
    for i, ws, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(ws)))
    order = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    return out, [(x[3], x[0]) for x in order[: percent * len(order) // 100]]


@pytest.mark.parametrize("longest, buckets, percent", [(1, 10_000, 10), (3, 97, 50), (1, 50, 100)])
def test_resample_on_hard_cases(spark, longest, buckets, percent):
    rows = documents()
    target = [rows[0][1], rows[3][1], None, ""]
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(spark.createDataFrame(rows, SCHEMA).repartition(5), frame, percent, longest=longest, buckets=buckets).collect()
    want, drawn = brute_resample([(r[0], r[1]) for r in rows], target, longest, buckets, percent)
    assert Counter((r.id, r.n_features, r.weight, r.score) for r in got) == Counter(x[:4] for x in want)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == [*range(1, len(drawn) + 1)] and [(r.score, r.id) for r in ranked] == drawn


def test_resample_empty(spark):
    docs, none = spark.createDataFrame(documents(), SCHEMA), spark.createDataFrame([], SCHEMA)
    assert resample.resample(none, docs).count() == 0
    assert resample.resample(docs, none).count() == docs.count()
    with pytest.raises(ValueError):
        resample.gains(docs, docs, buckets=1 << 21)


def test_resample_many_copies_are_ranked_in_parts(spark):
    """A third of all rows being one document, no range of the sort has to hold them all."""
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.range(3000).selectExpr("IF(id % 3 = 0, 3000L, id) AS doc_id", f"IF(id % 3 = 0, '{text}', concat('{text} x', id)) AS text")
    got = resample.resample(docs, docs.limit(5), percent=100).collect()
    assert sorted(r["rank"] for r in got) == [*range(1, 3001)] and sum(r.id == 3000 for r in got) == 1000
    assert len({r.score for r in got if r.id == 3000}) == 1


def test_op12(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    want = set(con.execute(queries.oracle_sql()["op12_importance_resampling"]).fetchall())
    assert {(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in queries.op12_importance_resampling(spark, sf).collect()} == want


def test_resample_stays_in_the_engine(spark, sf):
    docs, target = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    plan = resample.weigh(docs, resample.gains(docs, target))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


# Vector codes


def whole(x, scale, most):
    return [max(-most, min(most, math.floor(float(v) * scale))) for v in x]


def brute_codes(rows, parts, entries, rounds, scale):
    """rows of (id, vector, label), in order of id and vector; plain whole numbers throughout."""
    s = len(rows[0][1]) // parts
    most = codes.largest_component(len(rows[0][1]))
    xs = [whole(v, scale, most) for _, v, _ in rows]
    books = [[x[p * s : (p + 1) * s] for x in xs[:entries]] for p in range(parts)]

    def nearest(x, p):
        gaps = [sum((a - b) ** 2 for a, b in zip(x[p * s : (p + 1) * s], e, strict=True)) for e in books[p]]
        return gaps.index(min(gaps)), min(gaps)

    for _ in range(rounds):
        taken = {}
        for x in xs:
            for p in range(parts):
                taken.setdefault((p, nearest(x, p)[0]), []).append(x[p * s : (p + 1) * s])
        for (p, j), members in taken.items():
            books[p][j] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out = []
    for (i, _, label), x in zip(rows, xs, strict=True):
        found = [nearest(x, p) for p in range(parts)]
        out.append((i, bytes(j for j, _ in found), sum(g for _, g in found), label))
    total = Counter()
    for *_, g, label in out:
        total[label] += g
    return [(i, c, g, total[label]) for i, c, g, label in out], books


def test_nearest_is_exact_where_float32_is_not():
    rng = np.random.default_rng(0)
    for size in (3, 1 << 10, 1 << 22, 1 << 26):  # at the last, neighbours differ by less than float32 can tell
        book = rng.integers(-size, size, (40, 4))
        book[20:] = book[:20] + rng.integers(-1, 2, (20, 4))
        book[7] = book[3]  # a tie: the smaller index
        x = np.concatenate((book, book + rng.integers(-1, 2, book.shape), rng.integers(-size, size, (200, 4))))
        code, gap = codes.nearest(x, book)
        full = ((x[:, None].astype(object) - book[None].astype(object)) ** 2).sum(axis=2)
        assert code.tolist() == [row.index(min(row)) for row in full.tolist()] and gap.tolist() == [min(row) for row in full.tolist()]


SCHEMA13 = "vec_id long, embedding array<float>, label int, code string, error string, n string"


@pytest.mark.parametrize("parts, entries, rounds", [(4, 8, 2), (2, 64, 1), (8, 3, 0)])
def test_compress_on_hard_cases(spark, parts, entries, rounds):
    rng = random.Random(1)
    vectors = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(60)]
    rows = [(i, v, i % 3 if i % 5 else None) for i, v in enumerate(vectors)]
    rows += [(100, vectors[0], 1), (3, vectors[3], None), (3, vectors[4], 2), (None, vectors[5], 1), (101, [0.0] * 8, 0), (102, [3e38] * 8, 9), (103, [-1e30] * 8, 9)]
    rows = [(i, np.array(v, np.float32).tolist(), l) for i, v, l in rows]
    bad = [(200, None, 1), (201, [*vectors[1][:7], None], 1), (202, [float("nan"), *vectors[1][1:]], 1), (203, [float("inf"), *vectors[1][1:]], 1), (204, [], 1), (205, [0.5] * 7, 1)]
    frame = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows + bad], SCHEMA13).repartition(4)
    got, books = codes.compress(frame, parts, entries, rounds)
    want, plain = brute_codes(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])), parts, entries, rounds, 256)
    assert Counter((r.id, bytes(r.code), r.error, r.label_error) for r in got.collect()) == Counter(want)
    assert books.tolist() == plain and codes.books_digest(books) == hashlib.sha256(",".join(str(v) for b in plain for e in b for v in e).encode()).hexdigest()


def test_compress_empty_and_arguments(spark):
    none = spark.createDataFrame([], SCHEMA13)
    got, books = codes.compress(none)
    assert got.count() == 0 and got.columns == ["id", "code", "error", "label_error"] and books.size == 0
    with pytest.raises(ValueError):
        codes.compress(none, entries=257)


def test_op13(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()]
    want, books = brute_codes(rows, 16, 64, 2, 256)
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    got = queries.op13_vector_codes(spark, sf).collect()
    assert {(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got} == {(i, c.hex(), g, t, digest) for i, c, g, t in want}
