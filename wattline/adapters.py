"""The trace roles on the driver's synthetic tables (and their DuckDB twins for the oracles).

Values are whole numbers, binary fractions or the same few operations on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hours that the synthetic power panel has at least (it goes on to the last event), and its number of units.
STEPS, UNITS = 720, 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = "(CAST(datediff(l_shipdate, DATE'1995-01-01') AS bigint) * 86400 + (l_orderkey % 288) * 300) * 1000000"
    return table(spark, sf_dir, "lineitem").selectExpr(
        f"{start} AS start_time", f"{start} + 300000000 - IF(l_quantity < 3, 1, 0) AS end_time", "l_orderkey AS collection_id", "l_linenumber AS instance_index", "l_suppkey AS machine_id",
        "CASE l_linenumber % 3 WHEN 1 THEN 0L WHEN 2 THEN IF(l_suppkey % 2 = 0, 0L, 5L) END AS alloc_collection_id",
        "named_struct('cpus', CAST(l_quantity / 64 AS float), 'memory', CAST(l_quantity / 128 AS float)) AS average_usage",
    )


def instance_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS collection_id", "l_linenumber AS instance_index", "l_suppkey AS machine_id", "CASE l_linenumber % 3 WHEN 1 THEN 0L WHEN 2 THEN IF(l_suppkey % 2 = 0, 0L, 5L) END AS alloc_collection_id",
        "l_partkey", "explode(array(0, 3)) AS type",
    ).selectExpr("collection_id", "instance_index", "machine_id", "alloc_collection_id", "type", "CAST(IF(l_partkey % 11 = 0, NULL, (l_partkey * 7 + instance_index * 31 + type) % 361 - 1) AS int) AS priority")


def machine_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "explode(array(0, 1)) AS k")
    return rows.selectExpr(
        "k * 1000000L AS time", "s_suppkey AS machine_id", "k + 1 AS type",
        "IF(s_suppkey % 17 = 0 AND k = 0, NULL, named_struct('cpus', CAST((s_suppkey % 4 + 1) / 4D + k / 8D AS float), 'memory', CAST((s_suppkey % 3 + 1) / 2D AS float))) AS capacity",
    )


def machine_to_pdu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a repeated row for every tenth machine."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.selectExpr("s_suppkey AS machine_id", "concat('pdu', s_suppkey % 6) AS pdu", "chr(97 + CAST(n_regionkey % 2 AS int)) AS cell")
    return rows.unionAll(rows.where("machine_id % 10 = 0"))


def power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An hourly panel of six units without gaps: an hour without events is a flagged reading.
    Unit 0 is never flagged, unit 4 always."""
    hour = "timestampdiff(HOUR, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)"
    events = table(spark, sf_dir, "events")
    seen = events.selectExpr(f"user_id % {UNITS} AS k", f"{hour} AS step", "CAST(round(value * 100) AS bigint) AS cents").groupBy("k", "step").agg(F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("n"))
    grid = events.selectExpr(f"max({hour}) AS last").selectExpr(f"explode(sequence(0L, greatest({STEPS - 1}L, coalesce(last, 0L)))) AS step").selectExpr("step", f"explode(sequence(0L, {UNITS - 1}L)) AS k")
    rows = grid.join(seen, ["k", "step"], "left")
    load = "0.3D + coalesce(cents, 0L) / (coalesce(cents, 0L) + 200000D) * 0.6D"  # every event counts, and a ratio stays below 1
    return rows.selectExpr(
        "chr(97 + CAST(k % 3 AS int)) AS cell", "concat(IF(k = 5, 'mvpp', 'pdu'), k) AS pdu", "concat(chr(97 + CAST(k % 3 AS int)), '/', IF(k = 5, 'mvpp', 'pdu'), k) AS unit", "step",
        "600000000 + step * 3600000000 AS time", "timestampadd(HOUR, CAST(step AS int), TIMESTAMP_NTZ'2024-01-01 00:00:00') AS ts",
        f"{load} AS measured_power_util", f"({load}) * 0.5D + coalesce(n, 0L) % 4 * 0.05D AS production_power_util",
        "n IS NULL AS bad_measurement_data", "k = 4 OR (k != 0 AND coalesce(n, 0L) < 2) AS bad_production_power_data",
    )


USAGE_SQL = """usage AS (SELECT (date_diff('day', TIMESTAMP '1995-01-01', l_shipdate) * 86400 + (l_orderkey % 288) * 300) * 1000000 AS start_time,
  (date_diff('day', TIMESTAMP '1995-01-01', l_shipdate) * 86400 + (l_orderkey % 288) * 300) * 1000000 + 300000000 - CASE WHEN l_quantity < 3 THEN 1 ELSE 0 END AS end_time,
  l_orderkey AS collection_id, l_linenumber AS instance_index, l_suppkey AS machine_id,
  CASE l_linenumber % 3 WHEN 1 THEN 0 WHEN 2 THEN CASE WHEN l_suppkey % 2 = 0 THEN 0 ELSE 5 END END AS alloc_collection_id,
  l_quantity / 64 AS cpus, l_quantity / 128 AS memory FROM lineitem),
instance_events AS (SELECT l_orderkey AS collection_id, l_linenumber AS instance_index, l_suppkey AS machine_id,
  CASE l_linenumber % 3 WHEN 1 THEN 0 WHEN 2 THEN CASE WHEN l_suppkey % 2 = 0 THEN 0 ELSE 5 END END AS alloc_collection_id, t.type,
  CAST(CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE (l_partkey * 7 + l_linenumber * 31 + t.type) % 361 - 1 END AS INTEGER) AS priority FROM lineitem, (VALUES (0), (3)) AS t(type))"""
MACHINES_SQL = """machine_events AS (SELECT s_suppkey AS machine_id, k.k, CASE WHEN s_suppkey % 17 = 0 AND k.k = 0 THEN NULL ELSE (s_suppkey % 4 + 1) / 4.0::DOUBLE + k.k / 8.0::DOUBLE END AS cpus,
  CASE WHEN s_suppkey % 17 = 0 AND k.k = 0 THEN NULL ELSE (s_suppkey % 3 + 1) / 2.0::DOUBLE END AS memory FROM supplier, (VALUES (0), (1)) AS k(k)),
one_mapping AS (SELECT s_suppkey AS machine_id, 'pdu' || (s_suppkey % 6) AS pdu, chr(CAST(97 + n_regionkey % 2 AS INTEGER)) AS cell FROM supplier JOIN nation ON s_nationkey = n_nationkey),
mapping AS (SELECT * FROM one_mapping UNION ALL SELECT * FROM one_mapping WHERE machine_id % 10 = 0)"""
POWER_SQL = f"""seen AS (SELECT user_id % {UNITS} AS k, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 3600000000 AS step, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents, count(*) AS n FROM events GROUP BY ALL),
last AS (SELECT greatest({STEPS - 1}, max((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 3600000000)) AS last FROM events),
grid AS (SELECT k, step FROM (SELECT unnest(range(0, last + 1)) AS step FROM last), range({UNITS}) AS t(k)),
power AS (SELECT chr(CAST(97 + k % 3 AS INTEGER)) AS cell, CASE WHEN k = 5 THEN 'mvpp' ELSE 'pdu' END || k AS pdu, chr(CAST(97 + k % 3 AS INTEGER)) || '/' || CASE WHEN k = 5 THEN 'mvpp' ELSE 'pdu' END || k AS unit, step,
  600000000 + step * 3600000000 AS time, TIMESTAMP '2024-01-01' + to_hours(CAST(step AS INTEGER)) AS ts,
  0.3::DOUBLE + coalesce(cents, 0) / (coalesce(cents, 0) + 200000.0::DOUBLE) * 0.6::DOUBLE AS u,
  (0.3::DOUBLE + coalesce(cents, 0) / (coalesce(cents, 0) + 200000.0::DOUBLE) * 0.6::DOUBLE) * 0.5::DOUBLE + coalesce(n, 0) % 4 * 0.05::DOUBLE AS p,
  n IS NULL AS badm, k = 4 OR (k != 0 AND coalesce(n, 0) < 2) AS badp FROM grid LEFT JOIN seen USING (k, step))"""
