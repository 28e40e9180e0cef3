"""Connected components by alternating large-star and small-star steps, with lineage cut each step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm._support import forget, join_by_key, keep


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of comparable ids, a != b -> (node, root) for every node of an edge, root being
    the smallest node it reaches. Repeated and two-way edges count once; no edges, no rows.

    Each step groups by node only for a minimum (pre-aggregated before the shuffle) and joins that
    minimum back from a written table: by broadcast for hubs, whose rows so stay where they are, by shuffle for the other nodes.
    Ends when a whole round changes nothing; rounds grow with the logarithm of the diameter.
    """
    now = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(xxhash64(v, u) % 1000003)")).first()
        if seen == before or not seen[0]:
            return now.selectExpr("u AS node", "v AS root").union(now.selectExpr("v AS node", "v AS root").distinct())
        before = seen
        two_way = now.union(now.selectExpr("v AS u", "u AS v"))
        least = keep(two_way.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.when(F.col("v") > F.col("u"), 1)).alias("n")), "least")
        large = keep(join_by_key(two_way.where("v > u"), least, ["u"], "n").selectExpr("v AS u", "m AS v").distinct(), "large")
        low = keep(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "low")
        small = join_by_key(large, low, ["u"], "n").where("v != m").selectExpr("v AS u", "m AS v").union(low.selectExpr("u", "m AS v"))
        after = keep(small.distinct(), "edges")
        forget(now, least, large, low)
        now = after


def repeated_links(marked: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """Links (a, b) between the classes that texts of one id are in: marked(id, key) rows, classes(key, rep).

    Ids whose rows all have one key, nearly all of them, leave after one pre-aggregated pass."""
    several = marked.where("id IS NOT NULL").groupBy("id").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).where("lo != hi").select("id")
    reps = marked.join(several, "id", "left_semi").select("id", key).distinct().join(classes.select(key, "rep"), key).select("id", "rep").distinct()
    first = reps.groupBy("id").agg(F.min("rep").alias("a"))
    return reps.join(first, "id").where("rep != a").selectExpr("a", "rep AS b").distinct()
