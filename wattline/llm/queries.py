"""The registered query of each training-data operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm import balanced, bpe, codes, exact, html, language, packing, pii, quality, resample, simhash, substring, urls
from wattline.llm._support import table

#: Rules of the URL query.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), RULES).withColumnRenamed("id", "page_id")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER).withColumnRenamed("id", "doc_id")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.cut_repeats(table(spark, sf_dir, "documents"))
    return cut.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_duplicates(table(spark, sf_dir, "documents"), largest=True)
    return found.selectExpr("id AS doc_id", "keep_id", "group_size", "kept", "lower(hex(digest)) AS text_sha256")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


#: One fold in five is never learned from.
HELD_OUT = "coalesce(crc32(CAST(doc_id AS string)) % 5 = 0, false)"


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(f"NOT ({HELD_OUT})"))
    found = language.identify(docs.selectExpr("doc_id", "text", f"{HELD_OUT} AS held_out"), model)
    return found.selectExpr("doc_id", "held_out", "lang_pred", "lang_score AS score")


#: Key of the surrogates of these public tables. Other callers give replace_personal_data() a secret of their own.
PII_KEY = "registered queries"


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY, count_col="n_entities")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    model = html.train(html.sample_pages(pages))
    return html.extract_text(pages, model).selectExpr("id AS page_id", "url", "text", "CAST(length(text) AS long) AS n_chars")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_documents(table(spark, sf_dir, "documents"), TOKENIZER)
    return found.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced.pack_balanced(table(spark, sf_dir, "documents"), TOKENIZER).withColumnRenamed("id", "doc_id")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = codes.compress(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.books_digest(books)).alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_url_filter, op3_best_fit_packing, op4_substring_dedup, op5_exact_dedup, op6_quality_rules, op7_language_id, op8_pii, op9_html_extraction, op10_bpe, op11_karmarkar_karp, op12_importance_resampling, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {
        "op12_importance_resampling": r"""
            WITH bits AS (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i)),
            lookup AS (SELECT list(v ORDER BY i) AS step FROM bits),
            d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
            b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
            dw AS (SELECT doc_id, unnest(ws) AS w FROM d), bw AS (SELECT unnest(ws) AS w FROM b),
            known AS (SELECT w, hex(encode(w)) AS hx FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
            octets AS (SELECT w, list_transform(range(0, len(hx) // 2), lambda i: CAST('0x' || substr(hx, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT)) AS os FROM known),
            cell AS (SELECT w, xor(list_reduce(os, lambda c, o: xor(c >> 8, step[(xor(c, o) & 255) + 1]), 4294967295), 4294967295) % 10000 AS k FROM octets, lookup),
            s AS (SELECT k, count(*) AS n FROM dw JOIN cell USING (w) GROUP BY k), t AS (SELECT k, count(*) AS n FROM bw JOIN cell USING (w) GROUP BY k),
            g AS (SELECT r.k, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM s)::DOUBLE + 10000) / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM t)::DOUBLE + 10000)))) AS BIGINT) AS gain
                  FROM range(10000) r(k) LEFT JOIN s ON r.k = s.k LEFT JOIN t ON r.k = t.k),
            m AS (SELECT doc_id, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM dw JOIN cell USING (w) JOIN g USING (k) GROUP BY doc_id),
            x AS (SELECT doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m USING (doc_id)),
            y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM x),
            z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () * 10 // 100 AS most FROM y WHERE n_features >= 20)
            SELECT doc_id, n_features, weight, score, CASE WHEN r <= most THEN r END AS rank FROM y LEFT JOIN z USING (doc_id)""",
        "op5_exact_dedup": """
            WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
                   row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) = 1 AS kept, sha256(text) AS text_sha256
            FROM t WINDOW g AS (PARTITION BY text)""",
        "op4_substring_dedup": r"""
            WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
            w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM t),
            g AS (SELECT doc_id, i, string_agg(word, ' ') OVER next AS words, count(*) OVER next AS n FROM w
                  WINDOW next AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
            late AS (SELECT doc_id, i FROM g WHERE n = 20 QUALIFY row_number() OVER (PARTITION BY words ORDER BY doc_id, i) > 1),
            gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM late),
            kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS words FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
            SELECT t.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id)""",
    }
