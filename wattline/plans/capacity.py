"""Registered queries on capacity, tiers and distributions, and their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline import adapters as A
from wattline import constants as C
from wattline.functions import scalars as S
from wattline.operators import capacity as Q
from wattline.operators import sketches as K
from wattline.scratch import keep
from wattline.sources import bucketed as T

U, M, P = A.USAGE_SQL, A.MACHINES_SQL, A.POWER_SQL
TIER_SQL = "CASE WHEN priority BETWEEN 0 AND 99 THEN '1_free' WHEN priority BETWEEN 100 AND 115 THEN '2_beb' WHEN priority BETWEEN 116 AND 119 THEN '3_mid' ELSE '4_prod' END"
TOP = "(alloc_collection_id IS NULL OR alloc_collection_id = 0)"
SAMPLES = f"samples AS (SELECT start_time AS time, collection_id, instance_index, machine_id, cpus AS cpu_usage, memory AS memory_usage FROM usage WHERE {TOP} AND end_time - start_time >= 300000000)"
PRIORITY = f"prio AS (SELECT collection_id, instance_index, machine_id, max(priority) AS priority FROM instance_events WHERE {TOP} GROUP BY ALL)"
CAPS = "caps AS (SELECT machine_id, max(cpus) AS cpu_cap, max(memory) AS memory_cap FROM machine_events GROUP BY 1)"
MACHINE_USE = "muse AS (SELECT time // 300000000 * 300000000 AS time, machine_id, sum(cpu_usage) AS cpu_usage, sum(memory_usage) AS memory_usage FROM samples GROUP BY 1, 2)"


#: Added before rounding on both sides, so that an exact half never falls to either side by a last bit.
NUDGE = 3.7e-10


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits, negative zero to zero: what two engines agree on."""
    return df.select(*((F.round(F.col(c) + F.lit(NUDGE), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr} + {NUDGE}::DOUBLE, {digits}) + 0.0 AS {name}"


def _machine(s, d):
    return Q.machine_usage(A.usage(s, d), A.machine_events(s, d))


def _bucketed(s, d):
    """Usage and instance events in buckets of the instance, as a warehouse would hold them."""
    usage, events = A.usage(s, d), A.instance_events(s, d)
    n = T.buckets_for(64 << 20, s.sparkContext.defaultParallelism)
    tag = uuid.uuid4().hex
    return T.write_bucketed(usage, f"usage_{tag}", Q.INSTANCE, n), T.write_bucketed(events, f"events_{tag}", Q.INSTANCE, n)


#: Rank error that a sketch of all hours may have.
SKETCH_ERROR = 0.01
UTIL = ["cpu_util", "memory_util"]


def _sketched(s, d):
    """Capped utilization sketched by hour and machine group, merged to hours, and these to all: points with their rank errors."""
    m = keep(_machine(s, d), "machine-use")
    rows = Q.capped_utilization(m, "time", "machine_id")
    hours = keep(K.sketched(rows, [S.bucket("time", C.HOUR_US).alias("hour_index"), (F.col("machine_id") % 4).alias("part")], UTIL), "sketches")
    whole = K.merged(K.merged(hours, ["hour_index"], UTIL), [], UTIL)
    found = K.rank_errors(K.points(whole, [], UTIL), rows, UTIL)
    return found.select("label", "i", "y", "size", (F.col("error") <= SKETCH_ERROR).alias("within"))


QUERIES = {
    "capacity_shapes": lambda s, d: rounded(Q.capacity_shapes(A.machine_events(s, d)).select(F.col("cpus").cast("double").alias("cpus"), F.col("memory").cast("double").alias("memory"), "num_machines")),
    "distinct_collections": lambda s, d: Q.distinct_collections(A.usage(s, d)),
    "cell_capacity_sum_of_max": lambda s, d: rounded(Q.cell_capacity(A.machine_events(s, d))),
    "usage_with_tier": lambda s, d: rounded(Q.usage_with_tier(A.usage(s, d), A.instance_events(s, d)).fillna({"priority": -2})),
    "hourly_tier_utilization": lambda s, d: rounded(Q.hourly_tier_utilization(A.usage(s, d), A.instance_events(s, d), A.machine_events(s, d)), 9),
    "usage_with_tier_bucketed": lambda s, d: rounded(Q.usage_with_tier(*_bucketed(s, d)).fillna({"priority": -2})),
    "hourly_tier_utilization_bucketed": lambda s, d: rounded(Q.hourly_tier_utilization(*_bucketed(s, d), A.machine_events(s, d)), 9),
    "machine_capacity": lambda s, d: rounded(Q.machine_capacity(A.machine_events(s, d))),
    "top_level_usage": lambda s, d: rounded(Q.top_level_usage(A.usage(s, d))),
    "machine_usage_vs_capacity": lambda s, d: rounded(_machine(s, d)),
    "utilization_quantiles_exact": lambda s, d: rounded(Q.utilization_quantiles(_machine(s, d), exact=True)),
    "utilization_quantiles_approx": lambda s, d: rounded(Q.utilization_quantiles(_machine(s, d))),
    "utilization_sketches": lambda s, d: rounded(_sketched(s, d)),
    "unit_average": lambda s, d: rounded(Q.unit_average(A.power(s, d), "b", "pdu1")),
    "cell_min_max": lambda s, d: rounded(Q.power_extremes(A.power(s, d), "cell"), 9),
    "cell_unit_min_max_ordered": lambda s, d: rounded(Q.power_extremes(A.power(s, d), "cell", "pdu").orderBy("cell", "pdu"), 9),
    "first_n_by_time": lambda s, d: rounded(Q.first_by_time(A.power(s, d), "c", "mvpp5", 15 * 24).select("time", "measured_power_util", "production_power_util"), 9),
    "fold_channels": lambda s, d: rounded(Q.fold_channels(A.power(s, d), ["unit", "step"], ["measured_power_util", "production_power_util"]), 9),
    "machines_in_pdu": lambda s, d: Q.machines_in_pdu(A.machine_to_pdu(s, d), "pdu1"),
    "semi_join_capacity": lambda s, d: rounded(Q.pdu_capacity(A.machine_events(s, d), A.machine_to_pdu(s, d), "pdu0")),
    "tier_usage_join_power_hourly": lambda s, d: rounded(Q.pdu_hourly_tiers_and_power(A.usage(s, d), A.instance_events(s, d), A.machine_events(s, d), A.machine_to_pdu(s, d), _shifted(s, d), "b", "pdu1"), 9),
    "tier_usage_join_power_daily": lambda s, d: rounded(Q.cell_daily_tiers_and_power(A.usage(s, d), A.instance_events(s, d), A.machine_events(s, d), A.machine_to_pdu(s, d), _shifted(s, d), "b"), 9),
    "histogram_by_unit": lambda s, d: rounded(Q.power_histogram(A.power(s, d)), 3),
    "histogram_by_cell": lambda s, d: rounded(Q.power_histogram(A.power(s, d), "production_power_util", "%", "cell"), 3),
    "histogram_cdf": lambda s, d: rounded(Q.histogram_cdf(Q.power_histogram(A.power(s, d)))),
    "tier_counts": lambda s, d: A.instance_events(s, d).groupBy(S.tier("priority").alias("tier"), S.two_way_tier("priority").alias("two_way")).agg(F.count(F.lit(1)).alias("n")),
}


def _shifted(s, d):
    """Power within the span of the usage facts: they start years apart in the synthetic tables."""
    return A.power(s, d).withColumn("time", F.col("time") + F.lit(700 * 86400 * 1_000_000))


SHIFTED = "shifted AS (SELECT * REPLACE (time + 60480000000000 AS time) FROM power)"
CDF = "SELECT '{0}' AS label, i, i / 100.0 AS y, quantile_cont({1}, i / 100.0) AS x FROM util, range(101) AS t(i) GROUP BY i"
ORACLES = {
    "capacity_shapes": f"WITH {M} SELECT {r('cpus', 'cpus')}, {r('memory', 'memory')}, count(DISTINCT machine_id) AS num_machines FROM machine_events GROUP BY cpus, memory",
    "distinct_collections": f"WITH {U} SELECT count(DISTINCT collection_id) AS num_collections FROM usage",
    "cell_capacity_sum_of_max": f"WITH {M}, {CAPS} SELECT {r('sum(cpu_cap)', 'cpu_capacity')}, {r('sum(memory_cap)', 'memory_capacity')} FROM caps",
    "usage_with_tier": f"WITH {U}, {SAMPLES}, {PRIORITY} SELECT time, collection_id, instance_index, machine_id, coalesce(priority, -2) AS priority, {TIER_SQL} AS tier, {r('cpu_usage', 'cpu_usage')}, {r('memory_usage', 'memory_usage')} FROM samples JOIN prio USING (collection_id, instance_index, machine_id)",
    "hourly_tier_utilization": f"""WITH {U}, {M}, {SAMPLES}, {PRIORITY}, {CAPS}, cap AS (SELECT sum(cpu_cap) AS c, sum(memory_cap) AS m FROM caps)
        SELECT CAST(floor(time / 3600000000.0) AS BIGINT) AS hour_index, {TIER_SQL} AS tier, {r('sum(cpu_usage) / (12 * any_value(c))', 'avg_cpu_usage', 9)}, {r('sum(memory_usage) / (12 * any_value(m))', 'avg_memory_usage', 9)}
        FROM samples JOIN prio USING (collection_id, instance_index, machine_id), cap GROUP BY 1, 2""",
    "machine_capacity": f"WITH {M}, {CAPS} SELECT machine_id, {r('cpu_cap', 'cpu_cap')}, {r('memory_cap', 'memory_cap')} FROM caps",
    "top_level_usage": f"WITH {U}, {SAMPLES} SELECT time // 300000000 * 300000000 AS time, collection_id, instance_index, machine_id, {r('cpu_usage', 'cpu_usage')}, {r('memory_usage', 'memory_usage')} FROM samples",
    "machine_usage_vs_capacity": f"WITH {U}, {M}, {SAMPLES}, {CAPS}, {MACHINE_USE} SELECT time, machine_id, {r('cpu_usage', 'cpu_usage')}, {r('memory_usage', 'memory_usage')}, {r('cpu_cap', 'cpu_capacity')}, {r('memory_cap', 'memory_capacity')} FROM muse JOIN caps USING (machine_id)",
    "utilization_quantiles_exact": f"""WITH {U}, {M}, {SAMPLES}, {CAPS}, {MACHINE_USE}, util AS (SELECT CASE WHEN cpu_usage > cpu_cap THEN 1.0 ELSE cpu_usage / cpu_cap END AS cpu, CASE WHEN memory_usage > memory_cap THEN 1.0 ELSE memory_usage / memory_cap END AS memory FROM muse JOIN caps USING (machine_id)),
        qs AS (SELECT list_transform(range(101), i -> i / 100.0::DOUBLE) AS p),
        q AS (SELECT {', '.join(f'quantile_cont(cpu, {i / 100}) AS c{i}, quantile_cont(memory, {i / 100}) AS m{i}' for i in range(101))} FROM util),
        l AS (SELECT 'CPU' AS label, [{', '.join(f'c{i}' for i in range(101))}] AS x FROM q UNION ALL SELECT 'Memory', [{', '.join(f'm{i}' for i in range(101))}] FROM q)
        SELECT label, CAST(i AS INTEGER) AS i, round(i / 100.0::DOUBLE, 6) + 0.0 AS y, round(x[i + 1], 6) + 0.0 AS x FROM l, range(101) AS t(i)""",
    "unit_average": f"WITH {P} SELECT {r('avg(p)', 'average_production_power_util')} FROM power WHERE cell = 'b' AND pdu = 'pdu1'",
    "cell_min_max": f"WITH {P} SELECT cell, {r('min(u)', 'min_util', 9)}, {r('max(u)', 'max_util', 9)} FROM power GROUP BY 1",
    "cell_unit_min_max_ordered": f"WITH {P} SELECT cell, pdu, {r('min(u)', 'min_util', 9)}, {r('max(u)', 'max_util', 9)} FROM power GROUP BY 1, 2 ORDER BY 1, 2",
    "first_n_by_time": f"WITH {P} SELECT time, {r('u', 'measured_power_util', 9)}, {r('p', 'production_power_util', 9)} FROM power WHERE cell = 'c' AND pdu = 'mvpp5' ORDER BY time LIMIT 360",
    "fold_channels": f"WITH {P} SELECT unit, step, 'measured_power_util' AS channel, {r('u', 'value', 9)} FROM power UNION ALL SELECT unit, step, 'production_power_util', {r('p', 'value', 9)} FROM power",
    "machines_in_pdu": f"WITH {M} SELECT machine_id FROM mapping WHERE pdu = 'pdu1'",
    "semi_join_capacity": f"WITH {M} SELECT {r('sum(c)', 'cpu_capacity')} FROM (SELECT max(cpus) AS c FROM machine_events WHERE machine_id IN (SELECT machine_id FROM mapping WHERE pdu = 'pdu0') GROUP BY machine_id)",
    "tier_usage_join_power_hourly": f"""WITH {U}, {M}, {P}, {SHIFTED}, {SAMPLES}, mine AS (SELECT machine_id FROM mapping WHERE pdu = 'pdu1'),
        prio AS (SELECT collection_id, instance_index, machine_id, max(priority) AS priority FROM instance_events WHERE {TOP} AND machine_id IN (FROM mine) GROUP BY ALL),
        cap AS (SELECT sum(c) AS c FROM (SELECT max(cpus) AS c FROM machine_events WHERE machine_id IN (FROM mine) GROUP BY machine_id)),
        h AS (SELECT CAST(floor(time / 3600000000.0) AS BIGINT) AS hour_index, {TIER_SQL} AS tier, {r('sum(cpu_usage) / (12 * any_value(c))', 'avg_cpu_usage', 9)} FROM samples JOIN prio USING (collection_id, instance_index, machine_id), cap GROUP BY 1, 2),
        w AS (SELECT CAST(floor(time / 3600000000.0) AS BIGINT) AS hour_index, pdu, {r('avg(u)', 'avg_measured_power_util', 9)}, {r('avg(p)', 'avg_production_power_util', 9)} FROM shifted WHERE cell = 'b' AND pdu = 'pdu1' GROUP BY 1, 2)
        SELECT * FROM h JOIN w USING (hour_index)""",
    "tier_usage_join_power_daily": f"""WITH {U}, {M}, {P}, {SHIFTED}, {SAMPLES}, {PRIORITY}, {CAPS}, mine AS (SELECT machine_id, pdu FROM mapping WHERE cell = 'b'),
        cap AS (SELECT pdu, sum(cpu_cap) AS c FROM caps JOIN mine USING (machine_id) GROUP BY 1),
        t AS (SELECT time, pdu, CASE WHEN priority < 120 THEN 'cappable' ELSE 'production' END AS tier, cpu_usage FROM samples JOIN prio USING (collection_id, instance_index, machine_id) JOIN mine USING (machine_id)),
        h AS (SELECT CAST(floor(time / 86400000000.0) AS BIGINT) AS day_index, pdu, tier, {r('sum(cpu_usage) / (12 * 24 * any_value(c))', 'avg_cpu_usage', 9)} FROM t JOIN cap USING (pdu) GROUP BY 1, 2, 3),
        w AS (SELECT CAST(floor((time - 6e8 + 3e8) / 86400000000.0) AS BIGINT) AS day_index, pdu, {r('avg(u)', 'avg_measured_power_util', 9)}, {r('avg(p)', 'avg_production_power_util', 9)} FROM shifted WHERE cell = 'b' AND pdu LIKE 'pdu%' GROUP BY 1, 2)
        SELECT * FROM h JOIN w USING (pdu, day_index)""",
    "histogram_by_unit": f"WITH {P} SELECT round(CAST(round(u / 0.0001) AS BIGINT) * 0.0001::DOUBLE, 3) + 0.0 AS bins, count(*) AS counts FROM power WHERE NOT badm AND NOT badp AND pdu LIKE 'pdu%' AND cell NOT IN ('i', 'j') GROUP BY 1",
    "histogram_by_cell": f"WITH {P} SELECT round(CAST(round(p / 0.0001) AS BIGINT) * 0.0001::DOUBLE, 3) + 0.0 AS bins, count(*) AS counts FROM power WHERE NOT badm AND NOT badp AND cell LIKE '%' AND cell NOT IN ('i', 'j') GROUP BY 1",
    "histogram_cdf": f"WITH {P}, h AS (SELECT round(CAST(round(u / 0.0001) AS BIGINT) * 0.0001::DOUBLE, 3) AS bins, count(*) AS counts FROM power WHERE NOT badm AND NOT badp AND pdu LIKE 'pdu%' GROUP BY 1) SELECT {r('bins', 'bins')}, {r('sum(counts) OVER (ORDER BY bins) / sum(counts) OVER ()', 'share')} FROM h",
    "tier_counts": f"WITH {U} SELECT {TIER_SQL} AS tier, CASE WHEN priority < 120 THEN 'cappable' ELSE 'production' END AS two_way, count(*) AS n FROM instance_events GROUP BY 1, 2",
}
ORACLES["utilization_sketches"] = f"""WITH {U}, {M}, {SAMPLES}, {CAPS}, {MACHINE_USE}, n AS (SELECT count(*) FILTER (cpu_cap IS NOT NULL) AS cpu, count(*) FILTER (memory_cap IS NOT NULL) AS memory FROM muse JOIN caps USING (machine_id)),
        l AS (SELECT 'cpu_util' AS label, cpu AS size FROM n UNION ALL SELECT 'memory_util', memory FROM n) SELECT label, CAST(i AS INTEGER) AS i, {r('i / 100.0::DOUBLE', 'y')}, size, true AS "within" FROM l, range(101) AS t(i)"""
ORACLES |= {f"{name}_bucketed": ORACLES[name] for name in ("usage_with_tier", "hourly_tier_utilization")}
