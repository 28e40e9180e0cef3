"""Helpers shared by the training-data operators: table access, cutting lineage, Arrow plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder. A
    local session that names neither gets one of its own; elsewhere that is an error."""
    context = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not place:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='wattline-')}")
        place = context.getCheckpointDir()
    return place


#: Setting by which a query's shuffle files go when it has ended, and not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and what
    is read later survives the loss of any executor. The table is deleted when the driver ends, or by forget(). The write's
    shuffle files go with it: nothing reads them after it, and a chain of tables would otherwise hold those of all its steps."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wattline-{tag}-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._wattline_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables that keep() returned and that nothing reads any more; other frames are left alone."""
    for df in tables:
        if path := getattr(df, "_wattline_path", None):
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that `column` (string or binary) has about `most` bytes in each; a longer
    single value stays whole. Bounds what a Python worker holds at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def raw(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def join_by_key(rows: DataFrame, table: DataFrame, keys: list[str], n: str) -> DataFrame:
    """rows joined with table, which has one row for each of their keys and in column n how many of the rows have it.

    Keys with more than a thousandth of all rows, fewer than a thousand whatever the input, are broadcast, so that no task gets
    all rows of one key; the others are joined by a shuffle. `rows` is read twice and should be a written table."""
    least = rows.count() // 1000 + 1
    hot = table.where(F.col(n) > least)
    common = rows.join(F.broadcast(hot), keys)
    return common.unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(F.col(n) <= least), keys))


def hash_sample(df: DataFrame, n: int, *keys: str, distinct: bool = False) -> DataFrame:
    """At most n rows, chosen by a hash of `keys`. A threshold from the row count leaves about 2 n rows before
    anything is ordered, so no task and not the driver sees n rows of every partition. With `distinct`, rows that agree in
    all columns are one, with their number as column n, however often they occur."""
    h, span = F.xxhash64(*keys), 1 << 40
    total = df.agg(F.approx_count_distinct(h, 0.02)).first()[0] if distinct else df.count()
    if total > 2 * n:
        df = df.where(F.pmod(h, F.lit(span)) < int(2 * n / total * span))
    if distinct:
        df = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    return df.orderBy(h, *keys).limit(n)


_SLOT: dict[str, object] = {}


def process_slot(key: str, make: Callable[[], object]) -> object:
    """The one object that a Python worker keeps from task to task (caches, never results); asking
    for another key lets it go."""
    if key not in _SLOT:
        _SLOT.clear()
        _SLOT[key] = make()
    return _SLOT[key]


def release_slot() -> None:
    _SLOT.clear()
