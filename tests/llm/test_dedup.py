"""SimHash, exact and substring dedup against brute force, with every awkward row."""

import os
import random
import re
import subprocess
import sys
import time

import corpus_pipeline
import numpy as np
import pytest
from fixtures import SCHEMA, classes, documents, fingerprint, jaccard_components, prose, repeats
from pyspark.sql import functions as F

from wattline.llm import _support, components, exact, jaccard, simhash, substring


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA)


def test_fingerprints_and_components(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    rows = documents()
    assert len(got) == len(rows)
    fps = {}
    for r in rows:
        fps.setdefault(fingerprint(r[1]), set()).add(r[0])
    root = classes(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for fp, ids in fps.items():
        least.setdefault(root[fp], set()).update(i for i in ids if i is not None)
    want = sorted((r[0] if r[0] is not None else -1, fingerprint(r[1]), min(least[root[fingerprint(r[1])]], default=-1)) for r in rows)
    assert sorted((r.id if r.id is not None else -1, r.fp % 2**64, -1 if r.component_id is None else r.component_id) for r in got) == want


def test_long_text_in_blocks(monkeypatch):
    text = prose(random.Random(3), 3000)
    monkeypatch.setattr(simhash, "BLOCK", 100)
    assert simhash.fingerprint(text.encode()) == fingerprint(text)


def test_links_at_exactly_two_bits(spark):
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    fps = {s ^ m for s in seeds for m in (0, 1, 3, 7, 1 << 63 | 1, 0b11111)}
    signed = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(sorted(fps))]
    table = spark.createDataFrame(signed, "fp long, rep long")
    roots = {r.node: r.root for r in components.components(simhash.ball_edges(table)).collect()}
    number = {f % 2**64: i for f, i in signed}
    want = classes(list(number), lambda a, b: (a ^ b).bit_count() <= 2)
    groups = {}
    for f, k in want.items():
        groups.setdefault(k, []).append(number[f])
    assert {i: roots.get(i, i) for i in number.values()} == {i: min(g) for g in groups.values() for i in g}


def test_components_of_chains_stars_and_none(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 3), (3, 7), (3, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("fan", [2, 16])
def test_exact(spark, docs, largest, fan):
    rows = documents()
    found = exact.exact_duplicates(docs, largest)
    merged = exact.tree_merge(exact.digest_rows(docs), largest, fan)
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    pick = lambda ids: (max if largest else min)((i for i in ids if i is not None), default=None)
    assert sorted(str((r.keep_id, r.n)) for r in merged.collect()) == sorted(str((pick(v), len(v))) for v in groups.values())
    got = found.collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    assert sorted(str((r.id, r.keep_id, r.group_size)) for r in got) == sorted(str((i, pick(v), len(v))) for v in groups.values() for i in v)
    kept = exact.drop_exact_duplicates(docs, largest)
    assert kept.columns == docs.columns and kept.count() == len(groups)


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("buckets", [1, 64])
def test_substrings(spark, seed, buckets):
    rows = documents(seed)
    got = {}
    for r in substring.cut_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), buckets=buckets).collect():
        got.setdefault(r.id, set()).add((r.n_words, r.n_removed, r.kept))
    want = repeats(list({(r[0], r[1]) for r in rows}))
    for i, (n, kept) in want.items():
        assert got[i] == {(n, n - len(kept), b" ".join(kept).decode())}
    assert all(removed == 0 for _, removed, _ in got[None])


def test_substring_blocks_do_not_matter(spark, monkeypatch):
    rng = random.Random(5)
    passage = prose(rng, 25)
    rows = [(i, prose(rng, 60) + " " + passage + " " + prose(rng, 10)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (sorted(map(tuple, substring.cut_repeats(x).collect())) for x in (df.repartition(1), df.repartition(7)))
    assert a == b and a == sorted((i, n, n - len(k), b" ".join(k).decode()) for i, (n, k) in repeats(rows).items())


@pytest.mark.parametrize("operator", [simhash.near_duplicates, exact.exact_duplicates, substring.cut_repeats, simhash.drop_near_duplicates, exact.drop_exact_duplicates])
def test_empty_table(spark, docs, operator):
    assert operator(docs.where(F.lit(False))).count() == 0


def test_texts_of_one_id_are_linked(spark):
    """Rows (1, A) (5, A) (5, B) (2, B): document 5 links A to B."""
    rng = random.Random(21)
    a, b, c = (prose(rng, 60) for _ in range(3))
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (2, b), (9, c), (7, c), (None, c)], "doc_id long, text string")
    want = {(1, 1), (5, 1), (2, 1), (9, 7), (7, 7), (None, 7)}
    assert {(r.id, r.component_id) for r in simhash.near_duplicates(df).collect()} == want
    assert {(r.id, r.component_id) for r in jaccard.near_duplicates(df).collect()} == want


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_hot_keys_with_and_without_adaptive_execution(spark, adaptive):
    """Half of 3,000 rows have one text: no result changes with the settings of adaptive execution."""
    rows = [(i, "the very same text of some words" if i % 2 else f"text number {i} and {i * i} of {i % 13}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        groups = exact.exact_duplicates(df, largest=True)
        assert "BroadcastHashJoin" in groups._jdf.queryExecution().executedPlan().toString()
        found = {(r.id, r.keep_id, r.group_size) for r in groups.collect()}
        near = {r.id: r.component_id for r in simhash.near_duplicates(df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    assert found == {(i, 2999 if i % 2 else i, 1500 if i % 2 else 1) for i, _ in rows}
    assert len(near) == 3000 and {near[i] for i in range(1, 3000, 2)} == {near[1]}


def test_hub_of_many_near_copies(spark, monkeypatch):
    """A base with copies that are similar to it and not to each other, and texts that only look close."""
    monkeypatch.setattr(jaccard, "LARGE", 10)
    rng = random.Random(22)
    base = prose(rng, 80).split()
    rows = [" ".join(base)]
    for k in [1] * 40 + [2] * 25 + [4] * 25:
        copy = list(base)
        for i in rng.sample(range(len(base)), k):
            copy[i] = prose(rng, 1) + str(rng.random())
        rows.append(" ".join(copy))
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    want = jaccard_components(rows)
    assert {r.id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want
    assert sum(c == 0 for c in want.values()) > 40 and len(set(want.values())) > 10


def test_session_without_a_shared_folder():
    """A local session that names no folder gets one of its own, and it is empty when the session has ended."""
    code = """
import sys, tempfile, os
from wattline.session import session
from wattline.llm import simhash
s = session("bare", "local[2]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"})
df = s.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "")], "doc_id long, text string")
assert sorted((r.id, r.component_id) for r in simhash.near_duplicates(df).collect()) == [(1, 1), (2, 1), (3, 3)]
print("FOLDER", s.sparkContext.getCheckpointDir())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYSPARK_SUBMIT_ARGS"}
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, env=env)
    assert out.returncode == 0, out.stderr[-2000:]
    folder = re.search(r"FOLDER file:(\S+)", out.stdout)[1]
    assert not [f for f in os.listdir(folder) if f.startswith("wattline-")]


def test_written_tables_leave_no_shuffle_files(spark):
    """A chain of written tables holds no shuffle files of the steps behind it, and the session's settings stay."""
    disk = spark._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {f for f in re.findall(r"shuffle_\d+_\d+_\d+\.data", disk.getAllFiles().mkString(" "))}
    was, before = spark.conf.get(_support.CLEANUP, None), files()
    table = spark.range(20_000)
    for step in range(3):
        table = _support.keep(table.repartition(3, F.xxhash64("id", F.lit(step))), "step")
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left
    assert table.count() == 20_000 and spark.conf.get(_support.CLEANUP, None) == was
    twice = spark.range(1000).groupBy(F.expr("id % 7 AS k")).count()
    assert sorted(twice.collect()) == sorted(twice.collect()) and twice.count() == 7


def test_near_dedup_keeps_one_of_each(spark, docs):
    kept = simhash.drop_near_duplicates(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    ids = sorted(r.doc_id for r in kept.collect())
    assert kept.columns == docs.columns and 0 in ids and 12 not in ids and 13 not in ids


@pytest.mark.parametrize("percent", [None, 80])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_near_copies_without_an_id_go(spark, percent, kind):
    """Rows without an id are compared like others: one stays of those that are like no document with an id, repeated rows are one."""
    rng = random.Random(51)
    a, b, c, d = (prose(rng, 400) for _ in range(4))
    near = lambda t: t + " end"
    rows = [(4, near(a)), (3, a), (5, b), (None, a), (None, near(a)), (None, near(b)), (None, c), (None, near(c)), (None, c), (None, c), (None, d), (None, None), (None, " ")]
    rows = [(i if i is None or kind == "long" else str(i), t) for i, t in rows]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3), 5, percent)
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == ["doc_id", "text"] and sorted(str(i) for i, _ in got if i is not None) == ["3", "5"]
    rest = [t for i, t in got if i is None]
    assert len(rest) == 3 and d in rest and sum(t in (c, near(c)) for t in rest) == 1 and sum(t in (None, " ") for t in rest) == 1


@pytest.mark.parametrize("large", [50, 3])
def test_pipeline_stage_finds_similarity_of_four_fifths(spark, monkeypatch, large):
    """Near copies that differ in more than 2 bits of 64 are found, and nothing below 0.8 is."""
    monkeypatch.setattr(jaccard, "LARGE", large)
    rng, rows = random.Random(11), []
    for _ in range(25):
        base = prose(rng, rng.randint(20, 150)).split()
        rows.append(" ".join(base))
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = prose(rng, 1)
            rows.append(" ".join(copy))
    rows += ["", " ", "one two", "One  two", *(prose(rng, 40) + " " + rows[0] for _ in range(5))]
    rows = list(enumerate(rows))
    want = jaccard_components(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id: r.component_id for r in jaccard.near_duplicates(df).collect()} == want
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, df.selectExpr("*", "1 AS n_chars"), "").collect()} == {i for i, c in want.items() if i == c}
    near = {(i, c) for i, c in want.items() if i != c}
    assert sum((fingerprint(rows[i][1]) ^ fingerprint(rows[c][1])).bit_count() > 2 for i, c in near) > 20


def test_pipeline_stage_links_what_meets_in_a_ball(spark, monkeypatch):
    """The first links of the stage are of operator 1's method: similar texts with fingerprints within two bits, and no others that meet."""
    rng, rows = random.Random(31), []
    for _ in range(12):
        base = prose(rng, 400).split()
        rows.append(" ".join(base))
        for at in (0, 399):
            rows.append(" ".join(prose(rng, 1) + str(len(rows)) if i == at else w for i, w in enumerate(base)))
    rows += ["a b c d e", "a b c d e " * 40]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {r.id: r.fp % 2**64 for r in jaccard.prefixes(df, 5, 80, 100, "doc_id", "text").collect()}
    assert prints == {i: simhash.fingerprint(t.encode(), 5) for i, t in rows}
    steps, verified = [], jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda *a: steps.append(verified(*a)) or steps[-1])
    seen = {}
    forget = jaccard.forget
    monkeypatch.setattr(jaccard, "forget", lambda *t: (seen.update({0: steps[0].collect()}) if steps and 0 not in seen else None, forget(*t)))
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, df.selectExpr("*", "1 AS n_chars"), "").collect()} == {i for i, c in jaccard_components(rows).items() if i == c}
    found, want = {(r.a, r.b) for r in seen[0]}, jaccard_components(rows)
    near = {(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 2 and want[i] == want[j]}
    root = classes({i: 1 for i in prints}, lambda a, b: (min(a, b), max(a, b)) in found)
    assert len(near) >= 5 and all(root[i] == root[j] for i, j in near) and all(want[a] == want[b] for a, b in found)


def test_texts_are_sent_only_for_pairs_that_can_be_similar(spark, monkeypatch):
    """Texts with a common passage, whose order by counts is not known, are not sent to be compared; a group of near copies is sent in
    bounded parts until it hangs together, and not as all its pairs."""
    monkeypatch.setattr(jaccard, "common", lambda *a: (np.array([], np.int64), np.array([], np.int64)))
    rng = random.Random(41)
    passage, rows = prose(rng, 30), [" ".join(f"{w}{i}" for w in prose(rng, 95 + i % 7).split()) for i in range(30)]
    rows = [f"{r} {passage}" for r in rows]
    base = prose(rng, 200).split()
    for i in range(20):
        rows.append(" ".join([*base[: 6 * i], f"changed{i}", *base[6 * i + 1 :]]))
    rows = list(enumerate(rows))
    sent, verified = [], jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *a: sent.append(pairs.count()) or verified(pairs, *a))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (10**9, 0):  # all pairs at once, then in parts
        sent.clear()
        monkeypatch.setattr(jaccard, "LEAST_SENT", most, raising=False)
        assert {r.id: r.component_id for r in jaccard.near_duplicates(df).collect()} == jaccard_components(rows)
        assert sum(sent) <= 20 * 19 // 2
    assert len(sent) > 1 and max(sent) < 60 and sum(sent) < 20 * 19 // 2


def test_bits_bound_how_far_sets_are_apart(spark):
    """No similar pair is lost by its bits, whatever the widths; pairs that are far apart are."""
    rng = np.random.default_rng(7)
    sets = [rng.integers(-(2**63), 2**63 - 1, n, np.int64) for n in (1, 2, 63, 64, 65, 129, 500, 1024, 1025, 5000)]
    sets += [s[: max(1, int(len(s) * f))] for s in sets for f in (0.9, 0.8, 0.79, 0.3)]
    rows = [(i, len(s), jaccard.parities(np.unique(s)).tolist()) for i, s in enumerate(map(np.unique, sets))]
    every = spark.createDataFrame(rows, "cls long, n int, bits array<long>")
    pairs = every.selectExpr("cls AS a").join(every.selectExpr("cls AS b")).where("a < b")
    for percent in (80, 30):
        got = {(r.a, r.b): r.n for r in jaccard.possible(pairs, every, percent).collect()}
        far = {}
        for a in range(len(sets)):
            for b in range(a + 1, len(sets)):
                far[a, b] = len(np.intersect1d(sets[a], sets[b])) * (100 + percent) < percent * (rows[a][1] + rows[b][1])
        assert all(p in got for p, f in far.items() if not f)
        assert all(n == rows[a][1] + rows[b][1] for (a, b), n in got.items())
        if percent == 80:
            assert sum(far[p] for p in got) < sum(far.values()) / 20
