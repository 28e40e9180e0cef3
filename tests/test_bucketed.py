"""Tables in buckets of the join key: the same rows, and no exchange of the usage facts."""

import pytest
from pyspark.sql import functions as F

from wattline import adapters as A
from wattline.operators import capacity as Q
from wattline.plans import capacity as P
from wattline.sources import bucketed as T


@pytest.fixture
def tables(spark, sf):
    T.drop_bucketed(spark, "usage_b", "events_b", "more_b")
    yield T.write_bucketed(A.usage(spark, sf), "usage_b", Q.INSTANCE, 8), T.write_bucketed(A.instance_events(spark, sf), "events_b", Q.INSTANCE, 8)
    T.drop_bucketed(spark, "usage_b", "events_b", "more_b")


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def without_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return before


def test_the_fact_does_not_move(spark, sf, tables):
    before = without_broadcast(spark)
    try:
        moved = plan_of(Q.usage_with_tier(A.usage(spark, sf), A.instance_events(spark, sf)))
        kept = plan_of(Q.usage_with_tier(*tables))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    final = lambda p: p.split("== Initial Plan ==")[0]
    assert final(moved).count("Exchange hashpartitioning") >= 2
    assert "Exchange" not in final(kept) and "Bucketed: true" in kept and "SortMergeJoin" in kept


def test_hours_move_only_aggregated(spark, sf, tables):
    before = without_broadcast(spark)
    try:
        plan = plan_of(Q.hourly_tier_utilization(*tables, A.machine_events(spark, sf))).split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "collection_id" not in "".join(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)


def test_same_rows(spark, sf, tables):
    a, b = (sorted(map(repr, Q.usage_with_tier(*t).collect())) for t in (tables, (A.usage(spark, sf), A.instance_events(spark, sf))))
    assert a == b and len(a) > 100


def test_one_file_a_bucket(spark, tables):
    files = tables[0].select(F.input_file_name().alias("f")).distinct().count()
    assert files <= 8


def test_buckets_are_powers_of_two():
    assert [T.buckets_for(n, 1, 100) for n in (0, 1, 100, 101, 250, 1000)] == [1, 1, 1, 2, 4, 16] and T.buckets_for(5, 6, 100) == 8


def test_tables_of_unlike_bucket_numbers_share_borders(spark, sf, tables):
    more = T.write_bucketed(A.instance_events(spark, sf), "more_b", Q.INSTANCE, 16)
    assert Q.usage_with_tier(tables[0], more).count() == Q.usage_with_tier(*tables).count()


def test_nulls_in_keys_are_kept(spark):
    rows = [(None, 1), (2, None), (2, 3), (None, None)]
    T.drop_bucketed(spark, "nulls_b")
    got = T.write_bucketed(spark.createDataFrame(rows, "a long, b long"), "nulls_b", ["a", "b"], 4).collect()
    T.drop_bucketed(spark, "nulls_b")
    assert sorted(map(repr, got)) == sorted(map(repr, spark.createDataFrame(rows, "a long, b long").collect()))


def test_registered(spark, sf):
    assert P.QUERIES["usage_with_tier_bucketed"](spark, sf).count() == P.QUERIES["usage_with_tier"](spark, sf).count()
