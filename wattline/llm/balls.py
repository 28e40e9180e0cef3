"""Meet-in-the-middle ball hashing of 64-bit SimHash fingerprints: links between those that differ in at most 2 bits.

Two such fingerprints have a common neighbour at distance 1 or less from each. So every distinct fingerprint
emits itself and its 64 one-bit variants; fingerprints that share a variant collide, are deduplicated and verified.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm._support import join_by_key, keep

BLOCK = 1 << 16


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the unsigned 64-bit hashes have each bit set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for part in range(0, len(bits), 255):  # sums of 255 bits fit a byte
            ones += np.add.reduce(bits[part : part + 255], axis=0, dtype=np.uint8)
    return ones


def majority(ones: np.ndarray, n: int) -> int:
    """The fingerprint whose bits are set in over half of n hashes."""
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def ball_edges(classes: DataFrame) -> DataFrame:
    """classes(fp, rep), one row per distinct fingerprint -> links (a, b) between reps."""
    masks = F.array(F.lit(0).cast("long"), *(F.lit(x).cast("long") for x in (*(1 << i for i in range(63)), -(1 << 63))))
    near = classes.select("fp", "rep", F.explode(masks).alias("mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp", "rep")
    order = Window.partitionBy("variant").orderBy("fp")
    pairs = near.select("fp", "rep", F.lag("fp").over(order).alias("fp2"), F.lag("rep").over(order).alias("rep2")).where("fp2 IS NOT NULL")
    verified = pairs.where("bit_count(fp ^ fp2) <= 2 AND rep != rep2")
    return verified.selectExpr("least(rep, rep2) AS a", "greatest(rep, rep2) AS b").distinct()


def ball_pairs(classes: DataFrame) -> DataFrame:
    """classes(cls, fp), a fingerprint being that of any number of classes -> pairs (a, b) of classes: those of one
    fingerprint with its smallest class, and the smallest ones of fingerprints within two bits."""
    prints = keep(classes.groupBy("fp").agg(F.min("cls").alias("rep"), F.count(F.lit(1)).alias("n")), "prints")
    same = join_by_key(classes.select("fp", "cls"), prints, ["fp"], "n").where("cls != rep").selectExpr("rep AS a", "cls AS b")
    return ball_edges(prints).union(same)
