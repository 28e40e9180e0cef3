"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most 2 bits have a common neighbour at distance 1 or
less from each. So every distinct fingerprint emits itself and its 64 one-bit variants; fingerprints
that share a variant collide, are deduplicated and verified. A variant has at most 65
fingerprints around it, all within 2 bits of each other, so a chain through them in order holds
every link that matters, and no bucket is large however many documents share a fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm import jaccard
from wattline.llm._support import forget, join_by_key, keep, raw, slices
from wattline.llm.balls import ball_edges, bit_counts, majority
from wattline.llm.components import components, repeated_links

BLOCK = 1 << 16


def fingerprint(text: bytes, size: int = 3) -> int:
    """SimHash over word n-grams, repeats included. Very long texts are hashed block by block."""
    words = text.lower().split()  # bytes: ASCII case and white space only
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    n, ones, digest, join = len(words) - size + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, BLOCK):
        stop = min(n, at + BLOCK)
        parts = (words[at + i : stop + i] for i in range(size))
        ones += bit_counts(np.fromiter((digest(join(s), 42) for s in zip(*parts, strict=True)), np.uint64, stop - at))
    return majority(ones, n)


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (the 64-bit fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint(t or b"", size) for t in raw(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps)], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"id {kind}, fp long")


def near_duplicates(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fp, component_id (smallest id reachable over links of at most two
    differing bits, the document itself included).

    Null and empty texts and texts of white space have fingerprint 0 and link like others. Rows that
    repeat an id are one document with several texts: their classes are linked. A null id gets a row, and its text's
    component if that holds other ids, else null. Ties do not arise: components are sets. An empty
    table gives an empty result. Other columns are dropped before use.
    """
    marked = keep(fingerprints(docs, size, id_col, text_col), "fp")
    classes = keep(marked.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    links = keep(ball_edges(classes.where("rep IS NOT NULL")).union(repeated_links(marked, classes, "fp")), "links")
    roots = components(links)
    known = keep(classes.join(roots, classes.rep == roots.node, "left").select("fp", "n", F.coalesce("root", "rep").alias("component_id")), "components")
    forget(links, classes)
    return join_by_key(marked, known, ["fp"], "n").select("id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, size: int = 3, percent: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, the one with the smallest id; all columns kept. Rows without an id are
    documents of their own, known by their texts, and come after all ids: one of them stays where a component has no other. With `percent`,
    documents are linked at a Jaccard similarity of so many hundredths or more of their
    shingles: pairs that meet in a ball are verified on them, and as fingerprints of texts with four fifths of their shingles
    in common mostly differ in more bits than any ball can reach, the exact join in jaccard.py finds the links that are left."""
    unknown, key = docs[id_col].isNull(), id_col
    nameless = docs.where(unknown).limit(1).count()
    if nameless:
        key, text = "_wattline_id", F.unhex(F.sha2(F.coalesce(text_col, F.lit("")), 256))
        docs = docs.withColumn(key, F.struct(unknown.alias("last"), F.col(id_col).alias("id"), F.when(unknown, text).alias("text")))
    found = near_duplicates(docs, size, key, text_col) if percent is None else jaccard.near_duplicates(docs, size, percent, id_col=key, text_col=text_col)
    stays = found.where("id = component_id").selectExpr("id AS _wattline_stays").distinct()
    kept = docs.join(stays, docs[key] == stays["_wattline_stays"], "left_semi")
    if nameless:
        kept = kept.where(F.col(id_col).isNotNull()).union(kept.where(F.col(id_col).isNull()).dropDuplicates([key])).drop(key)
    return kept
