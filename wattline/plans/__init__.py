"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wattline.plans import capacity, panel, sources

Query = Callable[[SparkSession, str], DataFrame]
PLANS = (capacity, panel, sources)


def queries() -> dict[str, Query]:
    return {name: q for plan in PLANS for name, q in plan.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for plan in PLANS for name, sql in plan.ORACLES.items()}
