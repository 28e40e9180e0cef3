"""Near-duplicates by the Jaccard similarity of word shingles: an exact set-similarity join.

Sets are put in one global order, rare shingles first. Two sets of similarity t or more share a
shingle within the first n - ceil(t n) + 1 of each (prefix filtering), so buckets of prefix shingles hold every
pair; positions of the shared shingles bound the overlap, then bit vectors of the sets do, and what is left is verified on the whole
sets, a bounded part of the texts at a time. The order comes from counts over a sample that grows with the input: it decides the
cost, never the result. First come the links of operator 1's method: SimHash
fingerprints of the same shingles that meet in a ball (balls.py), verified on the sets; large buckets are linked along
chains with them. Only members of different components are then paired, so that a large group of near copies
costs about its size and not its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm._support import forget, keep, raw, release_slot, slices
from wattline.llm.balls import ball_pairs, bit_counts, majority
from wattline.llm.components import components, repeated_links

#: Buckets with more members than this are linked by pivots and chains first.
LARGE = 50
#: Share of the documents that the global order is counted on at least. A passage in a fixed share of all documents must be met in
#: the sample however many they are, or its shingles count as rare, fill prefixes, and pairs grow with the square of the input.
COUNTED = 0.25
#: Texts that are sent to verify pairs at a time, in shingles: a share of those of all texts, or so many if that is more.
SENT, LEAST_SENT = 0.5, 10_000_000


def hashes(text: bytes, size: int = 5) -> np.ndarray:
    """The unsigned 64-bit hashes of word n-grams in order, repeats included; shorter texts are one shingle."""
    words = text.lower().split()  # bytes: ASCII case and white space only
    n, digest, join = max(1, len(words) - size + 1), xxhash.xxh64_intdigest, b" ".join
    if n == 1:
        return np.array([digest(join(words), 42)], np.uint64)
    return np.fromiter((digest(join(s), 42) for s in zip(*(words[i:] for i in range(size)), strict=False)), np.uint64, n)


def shingles(text: bytes, size: int = 5) -> np.ndarray:
    """The sorted distinct hashes of word n-grams."""
    return np.unique(hashes(text, size).view(np.int64))


def common(docs: DataFrame, size: int, sample: int, id_col: str, text_col: str, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in three or more of about `sample` documents, or of a share COUNTED if that is more, and in how many; the `most` commonest."""
    rows, span = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text"), 1 << 20
    bound = int(min(1.0, max(COUNTED, sample / max(1, rows.count()))) * span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_slot()
        for batch in slices(batches, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t or b"", size) for t in raw(batch, "text")]))], ["g"])

    found = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(span)) < bound).mapInArrow(run, "g long").groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    top = found.orderBy(F.desc("n"), "g").limit(most).toArrow()
    g, n = (top.column(c).to_numpy() for c in ("g", "n"))
    order = np.argsort(g)
    return g[order], n[order]


def parities(h: np.ndarray) -> np.ndarray:
    """A set of hashes as bits, each the parity of how many fall on it: two sets differ in at least as many hashes as bits. There
    are as many bits as hashes, to the next power of two; half of a wider vector XOR the other half is the narrower one."""
    width = 1 << max(6, (len(h) - 1).bit_length())
    odd = np.bincount((h & (width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def prefixes(docs: DataFrame, size: int, percent: int, sample: int, id_col: str, text_col: str) -> DataFrame:
    """id, sig (digest of the set), n, fp (SimHash fingerprint as a signed long), bits (parities() of the set) and prefix (the first shingles in the global order) of
    each row."""
    ranks = docs.sparkSession.sparkContext.broadcast(common(docs, size, sample, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_slot()
        g, count = ranks.value
        for batch in slices(batches, "text", 4 << 20):
            sig, ns, fps, bits, heads = [], [], [], [], []
            for t in raw(batch, "text"):
                h = hashes(t or b"", size)
                fps.append(majority(bit_counts(h), len(h)))
                h = np.unique(h.view(np.int64))
                sig.append(xxhash.xxh3_128_digest(h.tobytes()))
                ns.append(len(h))
                bits.append(parities(h))
                if len(g):
                    at = np.minimum(np.searchsorted(g, h), len(g) - 1)
                    h = h[np.argsort(np.where(g[at] == h, count[at], 0), kind="stable")]
                heads.append(h[: len(h) + (-len(h) * percent) // 100 + 1])
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]).astype(np.int32)), pa.array(np.concatenate(x))) for x in (bits, heads)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sig, pa.binary()), pa.array(ns, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)), *lists], ["id", "sig", "n", "fp", "bits", "prefix"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"id {kind}, sig binary, n int, fp long, bits array<long>, prefix array<long>")


def possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of pairs(a, b) of classes, those that can be similar by their sizes and bits, with n, the shingles of both."""
    for c in "ab":
        pairs = pairs.join(classes.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")), c)
    width = "least(size(bits_a), size(bits_b))"
    folded = "IF(size({0}) = w, {0}, transform(sequence(0, w - 1), i -> aggregate(sequence(0, size({0}) DIV w - 1), 0L, (x, j) -> x ^ {0}[CAST(j * w + i AS int)])))"
    apart = f"aggregate(zip_with({folded.format('bits_a')}, {folded.format('bits_b')}, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)"
    near = pairs.where(f"n_a * 100L >= n_b * {percent}L AND n_b * 100L >= n_a * {percent}L").withColumn("w", F.expr(width))
    return near.where(f"{apart} * {100 + percent}L <= {100 - percent}L * (n_a + n_b)").selectExpr("a", "b", "n_a + n_b AS n")


def linked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> list[DataFrame]:
    """Of pairs(a, b, n) of classes, a written table, links between ids enough for the components that all of their links make: written
    tables. The texts that are sent at a time are bounded (SENT); between, pairs leave whose classes are in one component by then."""
    whole, links, left, turn = max(LEAST_SENT, SENT * (classes.agg(F.sum("n")).first()[0] or 0)), [], pairs, 0
    while total := left.agg(F.sum("n")).first()[0]:
        now = F.pmod(F.xxhash64("a", "b", F.lit(turn)), F.lit(1 << 30)) < F.lit(int(min(1.0, whole / total) * (1 << 30)) + 1)
        links.append(verified(left.where(now).select("a", "b"), classes, docs, size, percent, id_col, text_col))
        if total <= whole:
            break
        roots = components(reduce(DataFrame.union, links))
        parts = keep(classes.join(roots, classes.rep == roots.node).select("cls", "root"), "parts")
        rest = left.where(~now)
        for c in "ab":
            rest = rest.join(parts.select(F.col("cls").alias(c), F.col("root").alias(f"root_{c}")), c, "left")
        rest = keep(rest.where("root_a IS NULL OR root_b IS NULL OR root_a != root_b").select("a", "b", "n"), "left")
        forget(parts, *([left] if turn else []))
        left, turn = rest, turn + 1
    return links


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Of pairs(a, b) of classes, the links (a, b) between ids whose sets are similar, as a written table."""
    kind = docs.schema[id_col].dataType.simpleString()
    wanted = classes.join(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "cls", "left_semi").select("cls", "rep", "sig")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):  # an id can have several texts
            same = [xxhash.xxh3_128_digest(shingles(t or b"", size).tobytes()) == s for t, s in zip(raw(batch, "text"), batch.column("sig").to_pylist(), strict=True)]
            yield batch.select(["cls", "rep", "text"]).filter(pa.array(same))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices([whole], "text_a", 4 << 20):
                keeps = []
                for x, y in zip(raw(batch, "text_a"), raw(batch, "text_b"), strict=True):
                    x, y = shingles(x or b"", size), shingles(y or b"", size)
                    keeps.append(len(np.intersect1d(x, y, assume_unique=True)) * (100 + percent) >= percent * (len(x) + len(y)))
                yield batch.select(["rep_a", "rep_b"]).filter(pa.array(keeps))

    rows = docs.selectExpr(f"`{id_col}` AS rep", f"`{text_col}` AS text").join(wanted, "rep").select("cls", "rep", "text", "sig")
    texts = keep(rows.mapInArrow(own, f"cls long, rep {kind}, text string").dropDuplicates(["cls"]), "texts")
    sides = [texts.select(F.col("cls").alias(c), F.col("rep").alias(f"rep_{c}"), F.col("text").alias(f"text_{c}")) for c in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").where("rep_a != rep_b").select("rep_a", "rep_b", "text_a", "text_b")
    found = keep(both.mapInArrow(similar, f"rep_a {kind}, rep_b {kind}").selectExpr("least(rep_a, rep_b) AS a", "greatest(rep_a, rep_b) AS b").distinct(), "links")
    forget(texts)
    return found


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and component_id (smallest id reachable over links of a Jaccard similarity of
    at least `percent` hundredths, the document itself included).

    Null and empty texts and texts of white space have one set and link. Rows that repeat an id are one document
    with several texts: their classes are linked. A null id gets a row, and its text's component if that holds other ids,
    else null. An empty table gives an empty result. Other columns are dropped before use.
    """
    marked = keep(prefixes(docs, size, percent, sample, id_col, text_col), "prefix")
    classes = marked.groupBy("sig").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.min("fp").alias("fp"), F.first("bits").alias("bits"), F.first("prefix").alias("prefix")).where("rep IS NOT NULL")
    classes = keep(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    marked, wide = keep(marked.select("id", "sig"), "marked"), marked  # prefixes are read from the classes from here on
    forget(wide)
    places = classes.select("cls", "n", F.posexplode("prefix").alias("at", "g"))
    # Most shingles are in one class alone: they are counted by themselves, and leave before pivots are chosen.
    several = keep(places.join(places.groupBy("g").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "g"), "several")
    classes, wide = keep(classes.drop("prefix"), "classes"), classes
    forget(wide)
    # The pivot of a bucket has the fewest shingles before it that are rarer: of near copies, the one they were made from.
    pivots = several.groupBy("g").agg(F.min("n").alias("low"), F.min_by("cls", F.struct("at", -F.col("n"), "cls")).alias("pivot"))
    buckets = keep(several.join(pivots, "g"), "buckets")
    forget(several)
    hot = buckets.where(f"members > {LARGE}")
    order = Window.partitionBy("g", F.expr("pmod(xxhash64(cls), 1 + members DIV 100000)")).orderBy(F.xxhash64("cls", "g"), "cls")
    chains = hot.select("cls", F.lag("cls").over(order).alias("other")).where("other IS NOT NULL").union(hot.where("cls != pivot").select("cls", "pivot"))
    balls = keep(ball_pairs(classes), "balls")
    first = chains.selectExpr("least(cls, other) AS a", "greatest(cls, other) AS b").union(balls).distinct()
    first = keep(possible(first, classes, percent), "chains")
    links = linked(first, classes, docs, size, percent, id_col, text_col)
    forget(first, balls)
    same = keep(repeated_links(marked, classes, "sig"), "same")
    roots = components(reduce(DataFrame.union, links, same))
    parts = classes.join(roots, classes.rep == roots.node, "left").select("cls", F.coalesce("root", "rep").alias("part"))
    # What precedes a shared shingle in one set and is in no other bucket is not in the other set, so it bounds the overlap.
    lone = F.col("at") - F.row_number().over(Window.partitionBy("cls").orderBy("at")) + 1
    member = buckets.join(parts, "cls").select("g", "cls", "n", "at", "part", (F.col("n") - lone).alias("most"), "low")
    member = keep(member.where(f"most * {100 + percent}L >= {percent}L * n + greatest({percent}L * low, {percent * percent}L * n DIV 100)"), "member")
    forget(buckets)
    mixed = member.groupBy("g").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p != q").select("g")
    open_ = keep(member.join(mixed, "g", "left_semi"), "open")
    forget(member)
    x, y = (open_.select("g", *(F.col(c).alias(f"{c}_{s}") for c in ("cls", "n", "at", "part", "most"))) for s in "ab")
    close = f"n_a * 100L >= n_b * {percent}L AND n_b * 100L >= n_a * {percent}L AND least(most_a, most_b) * {100 + percent}L >= {percent}L * (n_a + n_b)"
    met = x.join(y, "g").where(f"part_a < part_b AND {close}")
    shared = met.groupBy(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"), "n_a", "n_b").agg(F.count(F.lit(1)).alias("o"), F.max("at_a").alias("i"), F.max("at_b").alias("j"))
    second = shared.where(f"(o + least(n_a - 1 - i, n_b - 1 - j)) * {100 + percent}L >= {percent}L * (n_a + n_b)").select("a", "b")
    second = keep(possible(second, classes, percent), "pairs")
    forget(open_)
    more = linked(second, classes, docs, size, percent, id_col, text_col)
    roots = components(reduce(DataFrame.union, [*links, *more], same))
    known = keep(classes.join(roots, classes.rep == roots.node, "left").select("sig", F.coalesce("root", "rep").alias("component_id")), "components")
    forget(second, *links, same, *more, classes)
    return marked.join(known, "sig", "left").select("id", "component_id")
