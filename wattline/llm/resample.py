"""Importance resampling towards a target corpus, by SQL expressions only.

Features are runs of words, hashed into a fixed number of buckets. The gain of a bucket is the log ratio of its smoothed
shares in the target and in the corpus; a document's weight is the mean gain of its features. A keyed Gumbel
draw on top of the weight makes the highest scores a sample without replacement, in proportion to exp(weight).

Words are exploded and meet the gains in a broadcast join: the table of gains has one row per bucket, a number that is a
parameter and not the corpus's. A document's features are added up where they were exploded, before anything is shuffled. Ranks
are places in a distributed sort: a row's place within its range, after the rows of the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm._support import keep

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words once A-Z are lower-cased: ASCII that is neither digit nor letter.
BETWEEN = r"[\\x00-/:-`{-\\x7F]+"
#: The most buckets whose gains may be broadcast (16 bytes each).
MOST_BUCKETS = 1 << 20


def words(text: str) -> str:
    """SQL for the array of a text's words; null has none."""
    return f"array_remove(split(translate(coalesce({text}, ''), '{UPPER}', '{UPPER.lower()}'), '{BETWEEN}', -1), '')"


def runs(ws: str, longest: int) -> str:
    """SQL for all runs of 1 to `longest` words of an array, each joined by one blank."""
    longer = [f"IF(size({ws}) >= {n}, transform(sequence(1, greatest(1, size({ws}) - {n - 1})), i -> array_join(slice({ws}, i, {n}), ' ')), array())" for n in range(2, longest + 1)]
    return f"concat({', '.join([ws, *longer])})" if longer else ws


def bucket(feature: str, buckets: int) -> str:
    return f"CAST(crc32(CAST({feature} AS binary)) % {buckets} AS int)"


def bucket_counts(texts: DataFrame, text_col: str, longest: int, buckets: int) -> DataFrame:
    """How often each bucket occurs in all texts: bucket, n. Counted where the words are exploded, then by bucket."""
    features = texts.selectExpr(f"{words(f'`{text_col}`')} AS ws").selectExpr(f"explode({runs('ws', longest)}) AS feature")
    return features.selectExpr(f"{bucket('feature', buckets)} AS bucket").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """bucket, gain (thousandths, floored) for every bucket, those without features included: one row each."""
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must be 1 to {MOST_BUCKETS}: their gains are broadcast")
    s, t = (bucket_counts(x, c, longest, buckets).withColumnRenamed("n", n) for x, c, n in ((docs, text_col, "s"), (target, target_col, "t")))
    every = docs.sparkSession.range(buckets).selectExpr("CAST(id AS int) AS bucket").join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    every = keep(every, "buckets")  # a row per bucket; the corpus is counted once
    total = every.agg(F.sum("s").alias("total_s"), F.sum("t").alias("total_t"))
    ratio = f"((t + 1D) * (total_s + {buckets}D)) / ((s + 1D) * (total_t + {buckets}D))"
    return every.crossJoin(F.broadcast(total)).selectExpr("bucket", f"CAST(floor(1000D * ln({ratio})) AS long) AS gain")


def weigh(docs: DataFrame, gain: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """One row per distinct (id, text): id, digest, n_words, n_features, weight, copies (how many rows it stands for)."""
    rows = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").selectExpr("id", "xxhash64(text) AS digest", "coalesce(length(text), -1) AS size", f"{words('text')} AS ws")
    each = rows.selectExpr("id", "digest", "size", "size(ws) AS n_words", f"posexplode_outer({runs('ws', longest)}) AS (at, feature)")
    met = each.selectExpr("id", "digest", "size", "n_words", "coalesce(at, 0) = 0 AS first", f"{bucket('feature', buckets)} AS bucket").join(F.broadcast(gain), "bucket", "left")
    added = met.groupBy("id", "digest", "size").agg(F.max("n_words").alias("n_words"), F.count("bucket").alias("n"), F.coalesce(F.sum("gain"), F.lit(0)).alias("gain"), F.count(F.when(F.col("first"), 1)).alias("copies"))
    mean = "IF(n = 0, 0L, (gain - pmod(gain, n)) DIV n)"  # floors go down
    return added.selectExpr("id", "digest", "CAST(n_words AS long) AS n_words", "n DIV copies AS n_features", f"{mean} AS weight", "copies")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: str = "2024", longest: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row per document: id, n_features, weight, score, rank (1, 2, ... from the highest score; null where not drawn).

    floor(percent / 100) of the documents with `least_words` words are drawn. Null and empty texts have no features and
    weight 0. Ties go to the smaller id; null ids come last and draw as the empty id. Repeated rows each have a row and a rank of
    their own, in any order among themselves; rows of one id whose texts agree in length and 64-bit hash count as equal.
    An empty corpus gives an empty result; an empty target gives gains against the smoothing alone. Other columns are dropped before use."""
    weighed = weigh(docs, gains(docs, target, text_col, target_col, longest, buckets), id_col, text_col, longest, buckets)
    drawn = f"CAST(conv(substring(sha2(concat('{seed}:', coalesce(CAST(id AS string), '')), 256), 1, 8), 16, 10) AS double)"
    scored = keep(weighed.selectExpr("*", f"weight + CAST(floor(-1000D * ln(-ln(({drawn} + 0.5D) / 4294967296D))) AS long) AS score"), "scored")
    each = scored.selectExpr("id", "digest", "n_words", "n_features", "weight", "score", "explode(sequence(1L, copies)) AS copy")
    by = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("digest"), F.col("copy")]
    # A row's number is its range and its place there: written, so that counting and ranking see the same ranges.
    ordered = each.where(F.col("n_words") >= least_words).repartitionByRange(*by).sortWithinPartitions(*by)
    placed = keep(ordered.select("id", "n_features", "weight", "score", F.monotonically_increasing_id().alias("number")), "placed")
    placed = placed.selectExpr("*", "shiftright(number, 33) AS range", "number & 8589934591L AS place")
    sizes = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1))  # a row per range
    before = Window.partitionBy("one").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.floor(F.sum("n").over(Window.partitionBy("one")) * percent / 100).alias("most"))
    rank = placed.join(F.broadcast(offsets), "range").selectExpr("id", "n_features", "weight", "score", "offset + place + 1 AS rank", "most")
    rest = each.where(F.col("n_words") < least_words).selectExpr("id", "n_features", "weight", "score", "CAST(NULL AS long) AS rank")
    return rank.selectExpr("id", "n_features", "weight", "score", "IF(rank <= most, rank, NULL) AS rank").unionByName(rest)
