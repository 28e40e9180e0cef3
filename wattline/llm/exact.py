"""Exact deduplication by tree-merge of sorted digest runs.

Each task first makes a run of the digests of its own rows. Runs are then exchanged in rounds over
a binomial tree of radix `fan`: a run's owner is written in digits, and round r sends each entry to
the owner whose r-th digit is that of the digest, where up to `fan` runs meet and are merged in
order (a multiway merge), keeping for each digest the identifier that stays and the count. After the
last round an owner holds a range of digests from all runs. There are as many owners as tasks that make runs, so an
owner never receives more than `fan` entries for one digest, and a text that a third of all rows share is merged a
few at a time at every level. Spark's exchange does not keep runs in order: each round's merge is a sort of
what has arrived and one pass over equal neighbours. Entries agree only if SHA-256, byte length and a second hash agree (the verification).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm._support import forget, join_by_key, keep


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, row (a number of its own for every row), digest, n_bytes, check; null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(text).alias("check")
    )


def tree_merge(rows: DataFrame, largest: bool = False, fan: int = 16) -> DataFrame:
    """rows of digest_rows() -> digest, n_bytes, check, keep_id, keep_row, n: one entry per text.
    Keeps the smallest id, or the largest; null ids only if there is no other; among rows with the
    same id the first."""
    owners, rounds = (rows.select(F.spark_partition_id().alias("task")).agg(F.max("task")).first()[0] or 0) + 1, 1
    while fan**rounds < owners:
        rounds += 1
    order = "struct(id IS {} NULL AS known, id, {} AS by)".format(*(("NOT", "-row") if largest else ("", "row")))
    best = "max" if largest else "min"
    key = ["digest", "n_bytes", "check"]
    runs = rows.selectExpr(*key, f"{order} AS best", "1L AS n", f"CAST(pmod(spark_partition_id(), {fan**rounds}) AS long) AS owner", f"CAST(conv(hex(substring(digest, 1, 4)), 16, 10) AS long) % {fan**rounds} AS home")
    for r in range(rounds):
        unit = fan**r
        digit = "CAST(floor({} / {unit}) AS long) % {fan}"
        merged = f"owner + CAST({digit.format('home', unit=unit, fan=fan)} - {digit.format('owner', unit=unit, fan=fan)} AS long) * {unit}"
        runs = runs.withColumn("owner", F.expr(merged)).groupBy("owner", *key, "home").agg(F.expr(f"{best}(best) AS best"), F.sum("n").alias("n"))
    sign = "-" if largest else ""
    return runs.selectExpr(*key, "best.id AS keep_id", f"{sign}best.by AS keep_row", "n")


def exact_duplicates(docs: DataFrame, largest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest (binary SHA-256).

    Null and empty texts are equal. A repeated row (same id and text) counts in the group and only
    the first listed stays. A null id stays only in a group without other ids. An empty table gives
    an empty result. Other columns are dropped before use; very long texts are hashed in place and
    only their digests move.
    """
    rows = keep(digest_rows(docs, id_col, text_col), "digests")
    groups = keep(tree_merge(rows, largest), "groups")
    key = ["digest", "n_bytes", "check"]
    return join_by_key(rows, groups, key, "n").selectExpr("id", "keep_id", "n AS group_size", "row = keep_row AS kept", "digest")


def drop_exact_duplicates(docs: DataFrame, largest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without exact duplicates, all columns kept; which row of a text stays is as in
    exact_duplicates(). Rows that repeat both id and text are one row afterwards."""
    rows = keep(digest_rows(docs, id_col, text_col), "digests")
    groups = keep(tree_merge(rows, largest).selectExpr("digest AS _wattline_digest", "n_bytes AS _wattline_n_bytes", "check AS _wattline_check", "keep_id AS _wattline_keep"), "groups")
    again = rows.groupBy("id", "digest").count().where("count > 1").limit(1).count()
    forget(rows)
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = docs.withColumns({"_wattline_digest": F.unhex(F.sha2(text, 256)), "_wattline_n_bytes": F.octet_length(text).cast("long"), "_wattline_check": F.xxhash64(text)})
    same = [marked[c] == groups[c] for c in ("_wattline_digest", "_wattline_n_bytes", "_wattline_check")]
    stays = marked.join(groups, [*same, marked[id_col].eqNullSafe(groups["_wattline_keep"])], "left_semi")
    if again:
        stays = stays.dropDuplicates([id_col, "_wattline_digest", "_wattline_n_bytes", "_wattline_check"])
    return stays.drop("_wattline_digest", "_wattline_n_bytes", "_wattline_check")
