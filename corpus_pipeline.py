"""A training-corpus pipeline: language ID, exact and near dedup, PII, packing.

STAGES holds (name, function); a function takes (spark, docs, sf_dir), docs being what the stage
before has left, and returns a DataFrame. All but the last return the columns of documents.
Null texts, empty texts and texts without letters end at the first stage; every stage accepts repeated rows, null
columns, extra columns and empty tables, as its operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm import exact, language, packing, pii, queries, simhash
from wattline.llm._support import forget, keep, table

#: Mean log-likelihood that an n-gram needs under the document's languages against a uniform background, for any number of them.
LEAST_FIT = 0.0
#: Session setting with the secret that surrogates depend on; without it, that of the registered queries.
KEY_SETTING = "spark.wattline.surrogate.key"
#: Words that a packing worker caches: less than for packing alone, as executors have other stages behind them.
WORDS_HELD = 150_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters that are likelier in their languages than by chance."""
    found = language.identify(docs, language.train(docs))
    return found.where(f"lang_pred != 'und' AND lang_fit > {LEAST_FIT}").select(docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id."""
    return exact.drop_exact_duplicates(docs, largest=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with a similarity of 0.8 or more in five-word shingles, the document with the smallest id. SimHash
    fingerprints that meet in a ball give the first links, verified on the shingles; an exact join those that no ball reaches."""
    return simhash.drop_near_duplicates(docs, size=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates for personal data; n_chars follows the text."""
    replaced = pii.replace_personal_data(docs, spark.conf.get(KEY_SETTING, queries.PII_KEY))
    return replaced.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, queries.TOKENIZER, held=WORDS_HELD).withColumnRenamed("id", "doc_id")


STAGES = [("language ID", language_id), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("PII", personal_data), ("packing", pack)]
#: Learned and iterative stages can't be put in SQL; tests/llm checks run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        forget(before)  # tables of keep() only
    return STAGES[-1][1](spark, docs, sf_dir)
