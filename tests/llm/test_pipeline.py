"""The corpus pipeline: stages on awkward rows, and run() against a brute-force version."""

import random

import corpus_pipeline
import pytest
from fixtures import SCHEMA, documents, jaccard_components
from pyspark.sql import functions as F

from wattline.llm import language, pii


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_takes_anything(spark, name, stage):
    docs = spark.createDataFrame(documents(), SCHEMA)
    for df in (docs, docs.limit(0), docs.withColumn("text", F.lit(None).cast("string")), docs.where("doc_id IS NULL")):
        out = stage(spark, df, "/nowhere")
        out.collect()
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes and out.count() <= df.count()


def test_run_equals_plain_version(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    model = language.train(spark.read.parquet(f"{sf}/documents.parquet"))
    kept = [(i, t) for i, t in docs if (v := model.judge_fit(t))[0] != "und" and v[3] > corpus_pipeline.LEAST_FIT]
    last = {}
    for i, t in kept:
        last[t] = max(i, last.get(t, i))
    unique = [(i, t) for t, i in last.items()]
    stays = {i: t for (i, t), c in zip(unique, map(jaccard_components(unique).get, (i for i, _ in unique)), strict=True) if i == c}
    clean = {r.doc_id: r.text for r in pii.replace_personal_data(spark.createDataFrame(list(stays.items()), "doc_id long, text string"), corpus_pipeline.queries.PII_KEY).collect()}
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == set(clean)
    from wattline.llm.bpe import Automaton, Encoder, crc

    encoder = Encoder(Automaton(open(corpus_pipeline.queries.TOKENIZER, encoding="utf-8").read()))
    want = set()
    for i, data in zip(clean, encoder.encode_all(list(clean.values())), strict=True):
        data += (1).to_bytes(4, "little")
        want |= {(i, p, s // 4, len(data[s : s + 16384]) // 4, crc(data[s : s + 16384])) for p, s in enumerate(range(0, len(data), 16384))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out} == want


def test_language_stage_rejects_what_is_in_no_language(spark, sf):
    """Letters in no learned language end at the first stage; real, short and evenly mixed documents go on."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = {r.lang: r.text[:400] for r in docs.where("length(text) > 500 AND lang IS NOT NULL").collect()}
    rng = random.Random(5)
    junk = ["".join(rng.choice("qxzkjwvp ") for _ in range(300)), "Привет мир, это обычный текст на русском языке.", "这是一个普通的中文文本。", "3f9a" * 50]
    texts = [*one.values(), " ".join(one.values()), " ".join(list(one.values())[:2]), *junk]
    extra = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    both = docs.unionByName(extra, allowMissingColumns=True)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, both, sf).where("doc_id < 0").collect()}
    assert len(one) == 4 and kept == {-1 - i for i in range(len(texts) - len(junk))}
