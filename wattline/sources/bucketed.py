"""Facts and dimensions laid out by the same key, so that they join where they lie.

A table is written once in buckets of its join key, each sorted by it. Two tables with the same number of buckets by the
same key are then joined, and either is aggregated by the key, without moving a row: no exchange, no sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from wattline.scratch import new_path

#: Bytes of a bucket to aim at: what a task sorts and joins in memory.
BUCKET_BYTES = 256 << 20


def buckets_for(total_bytes: int, least: int = 1, bucket_bytes: int = BUCKET_BYTES) -> int:
    """A power of two, so that tables of different sizes still share their buckets' borders."""
    need = max(least, -(-total_bytes // bucket_bytes))
    return 1 << (need - 1).bit_length()


def write_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int, path: str | None = None) -> DataFrame:
    """Write df as the table `name` in `buckets` buckets of `keys`, one file each, and read it back. Without a path the table lies in
    the shared folder until the driver ends. A table of this name is replaced; a null in a key is a value like others."""
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    rows = df.repartition(buckets, *keys)  # as a bucket is: otherwise every task writes to every bucket
    rows.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path or new_path(spark, name)).format("parquet").mode("overwrite").saveAsTable(name)
    return spark.table(name)


def drop_bucketed(spark: SparkSession, *names: str) -> None:
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
