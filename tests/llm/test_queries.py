"""The registered queries on whole small tables: contract columns against plain versions, and SQL where it can say them."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from fixtures import classes, fingerprint, repeats
from tokenizers import Tokenizer

from wattline.llm import quality, queries

ON = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.TOKENIZER)


def duck(sql, sf):
    con = duckdb.connect()
    for name in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con.execute(sql).fetchall()


def test_op1(spark, sf, rows):
    fps = {}
    for i, t in rows:
        fps.setdefault(fingerprint(t), []).append(i)
    root, least = classes(fps, lambda a, b: (a ^ b).bit_count() <= 2), {}
    for fp, ids in fps.items():
        least[root[fp]] = min([*ids, least.get(root[fp], min(ids))])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, sf).collect()}
    assert got == {i: (f"{fp:016x}", least[root[fp]]) for fp, ids in fps.items() for i in ids}


def test_op2(spark, sf):
    got = queries.op2_url_filter(spark, sf).collect()
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert {r.page_id for r in got} == set(pages)
    for r in got:
        rest = pages[r.page_id].partition("://")[2] if pages[r.page_id] else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [k for k in queries.RULES if (host == k.split("/")[0] or host.endswith("." + k.split("/")[0])) and path.startswith(k[k.index("/") :])]
        rule = max(fits, key=len) if fits else None
        assert (r.host, r.path, r.rule) == (host, path, rule) and (r.verdict == queries.RULES[rule] if rule else r.verdict in ("allow", "block"))


def test_op3(spark, sf, rows, library):
    want = set()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want |= {(i, p, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 4096))}
    got = queries.op3_best_fit_packing(spark, sf).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        assert [o for o, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1].tolist()] and sum(n for _, n in parts) <= 4096
    assert len(by) == -(-sum(r.length for r in got) // 4096)


def test_op4(spark, sf, rows):
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in queries.op4_substring_dedup(spark, sf).collect()}
    assert got == {(i, n, n - len(k), hashlib.sha256(b" ".join(k)).hexdigest()) for i, (n, k) in repeats(rows).items()}
    assert got == set(duck(queries.oracle_sql()["op4_substring_dedup"], sf))


def test_op5(spark, sf):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in queries.op5_exact_dedup(spark, sf).collect()}
    assert got == set(duck(queries.oracle_sql()["op5_exact_dedup"], sf))


WORDS = r"[^\x20\x09-\x0D]+"
BASE_SQL = rf"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
    g AS (SELECT doc_id, i, i - 1 AS a, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
    again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
    hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM again WHERE n > 1) GROUP BY 1),
    l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS l FROM t),
    b AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
          (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM t JOIN l USING (doc_id) LEFT JOIN hit USING (doc_id))
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b"""


def test_op6(spark):
    """Base columns by SQL; verdicts by the learned list in numpy, on documents that the list was not learned from as well."""
    docs, labels = (spark.read.parquet(f"{ON}/{n}.parquet") for n in ("documents", "labels"))
    got = queries.op6_quality_rules(spark, ON).collect()
    assert {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == set(duck(BASE_SQL, ON)) and len(got) == docs.count()
    rules = quality.decision_list(docs, labels)
    assert rules
    for r in got:
        n = max(r.n_words, 1)
        x = np.array([[r.n_words, r.word_chars / n, r.n_symbols / n, r.n_dup_lines, r.n_repeat_words / n]])
        assert r.kept == (not r.base_failed and not any(quality.covers(x, rule)[0] for rule in rules))


def test_op8(spark, sf, rows):
    got = {r.doc_id: (r.text, r.n_entities) for r in queries.op8_pii(spark, sf).collect()}
    assert set(got) == {i for i, _ in rows} and all((got[i][0] == t) == (got[i][1] == 0) for i, t in rows)


def test_op10(spark, sf, rows, library):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op10_bpe(spark, sf).collect()}
    want = set()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want
