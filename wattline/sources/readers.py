"""Readers and sinks of the trace formats. Paths may be anything that Spark's readers open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattline import constants as C
from wattline import schemas


def trace_table(spark: SparkSession, root: str, name: str, cell: str | None = None) -> DataFrame:
    """A table stored partitioned by cell (and pdu); a cell is a partition filter, not another table."""
    df = spark.read.parquet(f"{root}/{name}")
    return df if cell is None else df.where(F.col("cell") == cell)


def power_table(spark: SparkSession, root: str, cell: str | None = None, pdu_prefix: str | None = None) -> DataFrame:
    """Wildcard scan: cells and prefixes of unit names prune partitions."""
    df = trace_table(spark, root, "power", cell)
    return df if pdu_prefix is None else df.where(F.col("pdu").startswith(pdu_prefix))


def read_json_records(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Newline-delimited records of a trace table under its schema."""
    return spark.read.schema(schemas.TABLES[name]).json(path)


def read_power_csv(spark: SparkSession, path: str) -> DataFrame:
    """Unit files (gzip or plain CSV with a header), without the mapping file, with wall-clock time.
    Ordered by unit and time only where an operator asks for it."""
    columns = "time BIGINT, cell STRING, pdu STRING, measured_power_util DOUBLE, production_power_util DOUBLE, bad_measurement_data STRING, bad_production_power_data STRING"
    raw = spark.read.schema(columns).option("header", True).option("pathGlobFilter", "*.csv*").csv(path)
    raw = raw.where(~F.input_file_name().contains("machine_to_pdu_mapping"))
    flags = {c: F.lower(c).isin("1", "1.0", "true", "t") for c in ("bad_measurement_data", "bad_production_power_data")}
    return with_wall_clock(raw.withColumns(flags))


def with_wall_clock(power: DataFrame, start: str = "2019-05-01 00:00:00", zone: str = "US/Pacific") -> DataFrame:
    """`ts`: microseconds since 600 s before the trace's start, as an absolute time."""
    begin = F.to_utc_timestamp(F.lit(start), zone)
    return power.withColumn("ts", F.timestamp_micros(F.unix_micros(begin) + F.col("time") - C.TRACE_START_US))


def read_mapping_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MACHINE_TO_PDU).option("header", True).csv(path)


def read_legacy_tasks(spark: SparkSession, path: str) -> DataFrame:
    """The seven-hour trace: six columns parted by blanks."""
    return spark.read.schema(schemas.LEGACY_TASKS).option("sep", " ").option("header", False).option("comment", "#").csv(path)


def read_exploration_log(spark: SparkSession, path: str) -> DataFrame:
    """Tree exploration logs: file, line, op, a, b, t, execution_id (running count of Start in a file).
    A log is one ordered run of lines, so it is windowed by file."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"), F.split(F.trim("value"), r"\s+").alias("w")).where("w[0] != ''")
    ordered = Window.partitionBy("file").orderBy("line")
    op = F.col("w")[0]
    whole = lambda i: F.get("w", F.lit(i)).try_cast("long")
    timed = F.when(op == "End", F.get("w", F.lit(1)).try_cast("double"))
    return lines.select(
        "file", "line", op.alias("op"), F.when(op != "End", whole(1)).alias("a"), F.when(op == "AddNode", whole(2)).alias("b"), timed.alias("t"),
        F.sum(F.when(op == "Start", 1).otherwise(0)).over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("execution_id"),
    )


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Objects under a path: path and length, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def changed(have: DataFrame, want: DataFrame, have_root: str = "", want_root: str = "") -> DataFrame:
    """Objects to fetch again: missing here, or of another length (what an idempotent ingest copies). Objects are the same
    if their paths below the two roots are."""
    below = lambda df, root: df.withColumn("name", F.regexp_replace(F.when(F.col("path").startswith(root), F.substring("path", len(root) + 1, 1 << 30)).otherwise(F.col("path")), "^/+", ""))
    mine = below(have, have_root).selectExpr("name", "length AS held")
    return below(want, want_root).join(mine, "name", "left").where("held IS NULL OR held != length").select("path", "length", "held")


def require_whole(have: DataFrame, want: DataFrame, have_root: str = "", want_root: str = "") -> None:
    """Fail loudly on a truncated copy."""
    bad = [r.path for r in changed(have, want, have_root, want_root).limit(5).collect()]
    if bad:
        raise ValueError(f"missing or truncated: {bad}")


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    df.write.partitionBy(*by).mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A table of write_csv() with the columns and types of `like`."""
    return spark.read.schema(like.schema).option("header", True).csv(path)


def pick(df: DataFrame, **values: object) -> DataFrame:
    """Rows that have all these values; None picks nulls."""
    for name, value in values.items():
        df = df.where(F.col(name).eqNullSafe(F.lit(value)))
    return df


def smallest(df: DataFrame, n: int, *by: str) -> DataFrame:
    """The n rows first in order of `by`, nulls last: a top-n, no global sort."""
    return df.orderBy(*(F.col(c).asc_nulls_last() for c in by)).limit(n)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; larger ones are refused, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])
