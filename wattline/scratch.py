"""Tables written on the way: lineage ends there, and what is read later survives the loss of any executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


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


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder; what is written there is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/wattline-{tag}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back. The table is deleted when the driver ends, or by forget()."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
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
