"""Registered queries on readers and on the streaming forms (run bounded here)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattline import adapters as A
from wattline import constants as C
from wattline.operators import panel as W
from wattline.plans.capacity import rounded
from wattline.sources import readers as R
from wattline.streaming import windows as S


def wall_clock(s, d):
    """Trace time to wall-clock time, as hour and weekday in the trace's zone."""
    p = R.with_wall_clock(A.power(s, d).select("unit", "step", "time"))
    return p.select("unit", "step", ((F.unix_micros("ts") - F.unix_micros(F.to_utc_timestamp(F.lit("2019-05-01 00:00:00"), "US/Pacific"))) / 1_000_000).cast("long").alias("seconds"))


def missing_objects(s, d):
    have = A.table(s, d, "nation").selectExpr("concat('a/', n_name) AS path", "CAST(n_nationkey AS bigint) AS length").where("length % 3 != 0")
    want = A.table(s, d, "nation").selectExpr("concat('b/', n_name) AS path", "CAST(n_nationkey + IF(n_nationkey % 5 = 0, 1, 0) AS bigint) AS length")
    return R.changed(have, want, "a", "b").select("path", "length", F.coalesce("held", F.lit(-1)).alias("held"))


def sessions(s, d):
    x = S.sessions(A.table(s, d, "events"))
    return x.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


def wildcard(s, d):
    """Units by prefix over all cells."""
    return A.power(s, d).where(F.col("pdu").startswith("pdu")).groupBy("cell").agg(F.count_distinct("pdu").alias("units"), F.count(F.lit(1)).alias("n"))


def dense(s, d):
    """The panel has every step of every unit (raises otherwise)."""
    p = A.power(s, d)
    W.require_dense(p, ["measured_power_util", "production_power_util"])
    return p.groupBy("unit").agg(F.count_distinct("step").alias("steps"))


QUERIES = {
    "wall_clock": wall_clock,
    "missing_objects": missing_objects,
    "tumbling_windows": lambda s, d: rounded(S.tumbling(A.table(s, d, "events").withColumn("value", F.round(F.col("value") * 100).cast("long"))).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "total")),
    "session_windows": sessions,
    "wildcard_scan": wildcard,
    "dense_panel": dense,
}
ORACLES = {
    "wall_clock": f"WITH {A.POWER_SQL} SELECT unit, step, (time - {C.TRACE_START_US}) // 1000000 AS seconds FROM power",
    "missing_objects": """WITH w AS (SELECT n_name, n_nationkey + CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 0 END AS length FROM nation), h AS (SELECT n_name, n_nationkey AS held FROM nation WHERE n_nationkey % 3 != 0)
        SELECT 'b/' || n_name AS path, length::BIGINT AS length, coalesce(held, -1)::BIGINT AS held FROM w LEFT JOIN h USING (n_name) WHERE held IS NULL OR held != length""",
    "tumbling_windows": "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS total FROM events GROUP BY 1, 2",
    "session_windows": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events),
        k AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g), n AS (SELECT user_id, sid, count(*) AS n FROM k GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM n GROUP BY 1""",
    "wildcard_scan": f"WITH {A.POWER_SQL} SELECT cell, count(DISTINCT pdu) AS units, count(*) AS n FROM power WHERE pdu LIKE 'pdu%' GROUP BY 1",
    "dense_panel": f"WITH {A.POWER_SQL} SELECT unit, count(DISTINCT step) AS steps FROM power GROUP BY 1",
}
