"""Capacity, tiered utilization, distributions, and power against compute.

Facts are narrowed and filtered before they are joined, events are aggregated to one row per instance
before the join, and small one-row or per-unit capacities are joined, not collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline import constants as C
from wattline.functions import scalars as S
from wattline.operators.ranked import quantiles

INSTANCE = ["collection_id", "instance_index", "machine_id"]


def capacity_shapes(machine_events: DataFrame) -> DataFrame:
    """Machines per shape."""
    return machine_events.groupBy(F.col("capacity.cpus").alias("cpus"), F.col("capacity.memory").alias("memory")).agg(F.count_distinct("machine_id").alias("num_machines"))


def distinct_collections(events: DataFrame) -> DataFrame:
    return events.agg(F.count_distinct("collection_id").alias("num_collections"))


def machine_capacity(machine_events: DataFrame) -> DataFrame:
    """The largest capacity that a machine ever had."""
    return machine_events.groupBy("machine_id").agg(F.max("capacity.cpus").cast("double").alias("cpu_cap"), F.max("capacity.memory").cast("double").alias("memory_cap"))


def cell_capacity(machine_events: DataFrame) -> DataFrame:
    """Sum over machines of their maximum: one row."""
    return machine_capacity(machine_events).agg(F.sum("cpu_cap").alias("cpu_capacity"), F.sum("memory_cap").alias("memory_capacity"))


def machines_in_pdu(mapping: DataFrame, pdu: str) -> DataFrame:
    return mapping.where(F.col("pdu") == pdu).select("machine_id")


def pdu_capacity(machine_events: DataFrame, mapping: DataFrame, pdu: str) -> DataFrame:
    """Semi-join: repeated mappings count once."""
    return cell_capacity(machine_events.join(machines_in_pdu(mapping, pdu), "machine_id", "left_semi")).select("cpu_capacity")


def top_level_samples(usage: DataFrame) -> DataFrame:
    """Full-length samples outside alloc sets, narrowed."""
    kept = usage.where(S.top_level() & S.whole_sample())
    return kept.select(F.col("start_time").alias("time"), *INSTANCE, F.col("average_usage.cpus").cast("double").alias("cpu_usage"), F.col("average_usage.memory").cast("double").alias("memory_usage"))


def instance_priority(events: DataFrame) -> DataFrame:
    return events.where(S.top_level()).groupBy(*INSTANCE).agg(F.max("priority").alias("priority"))


def usage_with_tier(usage: DataFrame, events: DataFrame, tier: Column | None = None) -> DataFrame:
    """Each sample with its instance's priority and tier."""
    joined = top_level_samples(usage).join(instance_priority(events), INSTANCE)
    return joined.select("time", *INSTANCE, "priority", (S.tier("priority") if tier is None else tier).alias("tier"), "cpu_usage", "memory_usage")


def hourly_tier_utilization(usage: DataFrame, events: DataFrame, machine_events: DataFrame) -> DataFrame:
    """Share of the cell's capacity by hour and tier. The one-row capacity joins the aggregated hours."""
    hours = usage_with_tier(usage, events).groupBy(S.bucket("time", C.HOUR_US).alias("hour_index"), "tier").agg(F.sum("cpu_usage").alias("cpu"), F.sum("memory_usage").alias("memory"))
    cap = cell_capacity(machine_events)  # one row
    share = lambda x, y: S.ratio(F.col(x), C.SAMPLES_PER_HOUR * F.col(y))
    return hours.join(F.broadcast(cap)).select("hour_index", "tier", share("cpu", "cpu_capacity").alias("avg_cpu_usage"), share("memory", "memory_capacity").alias("avg_memory_usage"))


def top_level_usage(usage: DataFrame, width: int = C.MIN_SAMPLE_US) -> DataFrame:
    """Samples with their time floored to five minutes."""
    return top_level_samples(usage).withColumn("time", S.bucket("time", width) * F.lit(width))


def machine_usage(usage: DataFrame, machine_events: DataFrame) -> DataFrame:
    """Usage of each machine and five minutes beside its capacity; aggregated before the join."""
    sums = top_level_usage(usage).groupBy("time", "machine_id").agg(F.sum("cpu_usage").alias("cpu_usage"), F.sum("memory_usage").alias("memory_usage"))
    return sums.join(machine_capacity(machine_events), "machine_id").select("time", "machine_id", "cpu_usage", "memory_usage", F.col("cpu_cap").alias("cpu_capacity"), F.col("memory_cap").alias("memory_capacity"))


def capped_utilization(machine: DataFrame, *kept: str) -> DataFrame:
    capped = lambda u, c: F.when(F.col(u) > F.col(c), 1.0).otherwise(S.ratio(u, c))
    return machine.select(*kept, capped("cpu_usage", "cpu_capacity").alias("cpu_util"), capped("memory_usage", "memory_capacity").alias("memory_util"))


def cdf_points(arrays: DataFrame, **labels: str) -> DataFrame:
    """Quantile arrays to a tall frame: label, y (rank share), x (value)."""
    parts = [arrays.select(F.lit(label).alias("label"), F.posexplode(c).alias("i", "x"), F.size(c).alias("n")) for c, label in labels.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("label", "i", (F.col("i") / (F.col("n") - 1)).alias("y"), "x")


def utilization_quantiles(machine: DataFrame, exact: bool = False, n: int = 100) -> DataFrame:
    """CDF of capped utilization at n + 1 points: a mergeable sketch by default; exact by counting values in ranges."""
    u, columns = capped_utilization(machine), {"cpu_util": "CPU", "memory_util": "Memory"}
    if not exact:
        return cdf_points(u.agg(*(S.quantile_points(c, n).alias(c) for c in columns)), **columns)
    parts = [quantiles(u, c, [i / n for i in range(n + 1)]).select(F.lit(label).alias("label"), "i", (F.col("i") / n).alias("y"), F.col("value").alias("x")) for c, label in columns.items()]
    return parts[0].unionByName(parts[1])


def unit_average(power: DataFrame, cell: str, pdu: str) -> DataFrame:
    return power.where((F.col("cell") == cell) & (F.col("pdu") == pdu)).agg(F.avg("production_power_util").alias("average_production_power_util"))


def power_extremes(power: DataFrame, *by: str) -> DataFrame:
    return power.groupBy(*by).agg(F.min("measured_power_util").alias("min_util"), F.max("measured_power_util").alias("max_util"))


def first_by_time(power: DataFrame, cell: str, pdu: str, n: int = 15 * C.DAY) -> DataFrame:
    """The first n readings of a unit (a top-n, no global sort)."""
    return power.where((F.col("cell") == cell) & (F.col("pdu") == pdu)).orderBy("time").limit(n)


def fold_channels(power: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """Wide to long."""
    return power.unpivot(keys, channels, "channel", "value")


def power_by(power: DataFrame, index: Column, name: str) -> DataFrame:
    return power.groupBy(index.alias(name), "pdu").agg(F.avg("measured_power_util").alias("avg_measured_power_util"), F.avg("production_power_util").alias("avg_production_power_util"))


def pdu_hourly_tiers_and_power(usage: DataFrame, events: DataFrame, machine_events: DataFrame, mapping: DataFrame, power: DataFrame, cell: str, pdu: str) -> DataFrame:
    """A unit's tiers by hour beside its power. Times are bucketed, never joined raw; neither is shifted."""
    mine = machines_in_pdu(mapping, pdu)
    here = lambda df: df.join(mine, "machine_id", "left_semi")  # noqa: E731  before the large join, on both of its sides
    rows = usage_with_tier(here(usage), here(events))
    hours = rows.groupBy(S.bucket("time", C.HOUR_US).alias("hour_index"), "tier").agg(F.sum("cpu_usage").alias("cpu"))
    hours = hours.join(F.broadcast(pdu_capacity(machine_events, mapping, pdu))).select("hour_index", "tier", S.ratio("cpu", C.SAMPLES_PER_HOUR * F.col("cpu_capacity")).alias("avg_cpu_usage"))
    seen = power.where((F.col("cell") == cell) & (F.col("pdu") == pdu))
    return hours.join(power_by(seen, S.bucket("time", C.HOUR_US), "hour_index"), "hour_index")


def cell_daily_tiers_and_power(usage: DataFrame, events: DataFrame, machine_events: DataFrame, mapping: DataFrame, power: DataFrame, cell: str) -> DataFrame:
    """All units of a cell by day: cappable and production load beside power. Joins (not semi-joins) with the
    mapping, so repeated mappings count as often as listed; only the power's time is shifted."""
    machines = mapping.where(F.col("cell") == cell).select("machine_id", "pdu")
    cap = machine_capacity(machine_events).join(machines, "machine_id").groupBy("pdu").agg(F.sum("cpu_cap").alias("cpu_capacity"))
    here = lambda df: df.join(machines, "machine_id", "left_semi")  # noqa: E731  before the large join, on both of its sides
    rows = usage_with_tier(here(usage), here(events), S.two_way_tier("priority")).join(machines, "machine_id")
    days = rows.groupBy(S.bucket("time", C.DAY_US).alias("day_index"), "pdu", "tier").agg(F.sum("cpu_usage").alias("cpu")).join(cap, "pdu")
    days = days.select("day_index", "pdu", "tier", S.ratio("cpu", 12 * 24 * F.col("cpu_capacity")).alias("avg_cpu_usage"))
    seen = power.where((F.col("cell") == cell) & F.col("pdu").startswith("pdu"))
    return days.join(power_by(seen, S.bucket(F.col("time") + F.lit(C.POWER_SHIFT_US), C.DAY_US), "day_index"), ["pdu", "day_index"])


def power_histogram(power: DataFrame, channel: str = "measured_power_util", like: str = "pdu%", by: str = "pdu", excluded: tuple[str, ...] = C.EXCLUDED_CELLS) -> DataFrame:
    """Readings per bin of trusted data. One aggregation: counts by unit and bin only add up again."""
    kept = power.where(~F.col("bad_measurement_data") & ~F.col("bad_production_power_data") & F.col(by).like(like) & ~F.col("cell").isin(*excluded))
    return kept.groupBy(S.histogram_bin(channel).alias("bins")).agg(F.count(F.lit(1)).alias("counts"))


def histogram_cdf(histogram: DataFrame) -> DataFrame:
    """Running share of counts over the (few) bins of a histogram."""
    order = Window.orderBy("bins")
    return histogram.select("bins", (F.sum("counts").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("counts").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("share"))
