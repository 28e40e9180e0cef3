"""Coupling, virtual sensors, faults, scores, readers."""

import gzip

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattline.functions import scalars as S
from wattline.operators import capacity as Q
from wattline.operators import evaluate as E
from wattline.operators import fleet as L
from wattline.operators import panel as W
from wattline.sources import readers as R


def long(spark, m, name="x"):
    n, k = m.shape
    return spark.createDataFrame(pd.DataFrame({"unit": np.tile([f"a/p{i:02d}" for i in range(k)], n), "step": np.repeat(np.arange(n), k), name: m.ravel()}))


def test_independent_and_identical_units(spark):
    rng = np.random.default_rng(0)
    walk = np.cumsum(rng.normal(size=(1500, 8)), axis=0)
    apart, same = long(spark, walk), long(spark, np.tile(walk[:, :1], (1, 8)))
    assert L.effective_units(L.increments(apart, "x"), "x").first().n_eff > 0.9 * 8
    assert L.effective_units(L.increments(same, "x"), "x").first().n_eff < 1.05
    assert abs(L.reserve_inflation(apart, "x", 1).first().reserve_inflation - 1) < 0.1
    values = L.spectrum(L.increments(apart, "x"), "x")
    assert values.sum() == pytest.approx(8) and L.effective_units(L.increments(apart, "x"), "x").first().n_eff == pytest.approx(values.sum() ** 2 / (values**2).sum(), rel=1e-6)


def test_virtual_sensor_follows_its_peers_and_sees_a_bias(spark):
    rng = np.random.default_rng(1)
    common = np.cumsum(rng.normal(0, 0.02, 400))
    m = 0.6 + common[:, None] + rng.normal(0, 0.002, (400, 5))
    rebuilt = L.virtual_sensors(long(spark, m), "x", 250, bad=None)
    r2 = E.errors(rebuilt.where("step >= 250"), "y", "pred", ["unit"]).toPandas()
    assert (r2.r2 > 0.9).all()
    found = {(r.fault, r.magnitude): r.detection_rate for r in L.inject_faults(L.residual_scores(rebuilt, 250), 250, 400, [0, 40, 80], (0.0, 0.05), 30, 1 / 50).collect()}
    assert found["bias", 0.05] == 1.0 and found["bias", 0.0] < 1.0 and ("stuck", None) in found


def test_auc_by_pairs(spark):
    rng = np.random.default_rng(2)
    y, s = rng.integers(0, 2, 200), rng.integers(0, 12, 200).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s, "id": np.arange(200)}))
    pairs = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    assert E.auc(df, "y", "s").first().auc == pytest.approx(np.mean(pairs))
    assert E.auc(df.where("y = 1"), "y", "s").first().auc is None


def test_rand_index(spark):
    df = spark.createDataFrame([(i, i % 3, (i % 3) * 7, i % 2) for i in range(30)], "id int, a int, b int, c int")
    assert E.adjusted_rand(df, "a", "b").first()[0] == pytest.approx(1.0)
    assert abs(E.adjusted_rand(df, "a", "c").first()[0]) < 0.1
    assert L.permutation_level([i % 3 for i in range(30)], [i % 2 for i in range(30)], 200) < 0.3


def test_episodes(spark):
    flags = [1, 1, 0, 1, 0, 0, 1, 1, 1]
    df = spark.createDataFrame([("a", "p", i, i, bool(f)) for i, f in enumerate(flags)], "cell string, pdu string, step int, ts int, f boolean")
    assert sorted((r.n_intervals, r.start, r.end) for r in W.episodes(df, "f").collect()) == [(1, 3, 3), (2, 0, 1), (3, 6, 8)]


def test_tiers_and_rounding(spark):
    got = spark.createDataFrame([(p,) for p in (-1, 0, 99, 100, 115, 116, 119, 120, None)], "p int").select("p", S.tier("p").alias("t"), S.two_way_tier("p").alias("w")).collect()
    assert [r.t for r in got] == ["4_prod", "1_free", "1_free", "2_beb", "2_beb", "3_mid", "3_mid", "4_prod", "4_prod"]
    assert got[-1].w == "production" and got[0].w == "cappable"
    r = spark.sql("SELECT 2.5D AS x, -2.5D AS y, 0D AS z").select(S.rounded_long("x"), S.rounded_long("y"), S.ratio("x", "z"), S.bucket("y", 2)).first()
    assert tuple(r) == (3, -3, None, -2)


def test_join_counts_repeated_mappings_and_semi_join_does_not(spark):
    machines = spark.createDataFrame([(1, (1.0, 1.0))], "machine_id long, capacity struct<cpus: float, memory: float>")
    mapping = spark.createDataFrame([(1, "pdu1", "a")] * 2, "machine_id long, pdu string, cell string")
    assert Q.pdu_capacity(machines, mapping, "pdu1").first().cpu_capacity == 1.0


def test_readers(spark, tmp_path):
    (tmp_path / "power").mkdir()
    rows = "time,cell,pdu,measured_power_util,production_power_util,bad_measurement_data,bad_production_power_data\n900000000,a,pdu1,0.5,0.4,False,True\n600000000,a,pdu1,0.6,0.4,0,1\n"
    with gzip.open(tmp_path / "power/cella_pdu1.csv.gz", "wt") as f:
        f.write(rows)
    with gzip.open(tmp_path / "power/machine_to_pdu_mapping.csv.gz", "wt") as f:
        f.write("machine_id,pdu,cell\n1,pdu1,a\n")
    got = R.read_power_csv(spark, f"file://{tmp_path}/power").orderBy("time").collect()
    assert [r.time for r in got] == [600000000, 900000000] and [r.bad_production_power_data for r in got] == [True, True]
    assert R.read_mapping_csv(spark, f"file://{tmp_path}/power/machine_to_pdu_mapping.csv.gz").first().pdu == "pdu1"
    assert R.listing(spark, f"file://{tmp_path}/power").count() == 2
    (tmp_path / "v1.txt").write_text("90000 1 2 0 0.5 0.25\n90300 1 3 1 0 0\n")
    assert R.read_legacy_tasks(spark, f"file://{tmp_path}/v1.txt").agg(F.sum("NrmlTaskCores")).first()[0] == 0.5
    (tmp_path / "eta.txt").write_text("AddNode 0 1\nStart\nExplore 1\nTransition 1\nEnd 2.5\nStart\nEnd 1.0\n")
    log = R.read_exploration_log(spark, f"file://{tmp_path}/eta.txt").orderBy("line").collect()
    assert [r.execution_id for r in log] == [0, 1, 1, 1, 1, 2, 2] and log[4].t == 2.5 and (log[0].a, log[0].b) == (0, 1)
    R.write_csv(spark.range(3).toDF("x"), f"file://{tmp_path}/out")
    assert R.markdown(spark.read.option("header", True).csv(f"file://{tmp_path}/out").orderBy("x")).count("\n") == 4
    have = spark.createDataFrame([("x/a", 1)], "path string, length long")
    with pytest.raises(ValueError):
        R.require_whole(have, spark.createDataFrame([("y/a", 2)], "path string, length long"))


def test_streaming_equals_batch(spark, sf, tmp_path):
    from wattline.streaming.windows import tumbling

    events = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    events.write.mode("overwrite").parquet(f"{tmp_path}/in")
    stream = tumbling(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("tumbled").outputMode("complete").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("tumbled").count() == tumbling(events).count()


def test_trace_tables_and_sinks(spark, tmp_path):
    """Partitioned tables, records in JSON, results written and read back, rows picked."""
    root = f"file://{tmp_path}/trace"
    power = spark.createDataFrame([(600, "a", "pdu1", 0.5, 0.4, False, True), (900, "a", "mvpp2", 0.6, 0.4, False, False), (600, "b", "pdu1", 0.7, None, True, False)], "time long, cell string, pdu string, u double, p double, m boolean, b boolean")
    R.write_partitioned(power, f"{root}/power", "cell", "pdu")
    assert R.trace_table(spark, root, "power").count() == 3 and R.trace_table(spark, root, "power", "a").count() == 2
    assert [r.u for r in R.power_table(spark, root, "a", "pdu").collect()] == [0.5] and R.power_table(spark, root, pdu_prefix="pdu").count() == 2
    plan = R.power_table(spark, root, "a", "pdu")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan
    (tmp_path / "events.json").write_text('{"time": 1, "machine_id": 7, "type": 1, "capacity": {"cpus": 0.5, "memory": 0.25}}\n{"time": 2, "machine_id": 7, "extra": 1}\n')
    events = R.read_json_records(spark, f"file://{tmp_path}/events.json", "machine_events").orderBy("time").collect()
    assert events[0].capacity.cpus == 0.5 and events[1].capacity is None and events[1].platform_id is None
    result = spark.createDataFrame([("a", 1, 0.5), ("b", 2, None)], "unit string, n int, x double")
    R.write_csv(result, f"file://{tmp_path}/result")
    again = R.read_results(spark, f"file://{tmp_path}/result", result)
    assert again.dtypes == result.dtypes and sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, result.collect()), key=str)
    R.write_json(result, f"file://{tmp_path}/json")
    assert spark.read.schema(result.schema).json(f"file://{tmp_path}/json").count() == 2
    assert [r.n for r in R.pick(result, unit="b", x=None).collect()] == [2] and R.pick(result, unit="b", n=1).count() == 0
    assert [r.unit for r in R.smallest(result, 1, "x", "n").collect()] == ["a"]


def test_equal_names_in_two_folders_are_two_objects(spark):
    have = spark.createDataFrame([("/copy/a/x", 1), ("/copy/b/x", 2)], "path string, length long")
    want = spark.createDataFrame([("/from/a/x", 1), ("/from/b/x", 3), ("/from/c/x", 2)], "path string, length long")
    got = sorted((r.path, r.held) for r in R.changed(have, want, "/copy", "/from").collect())
    assert got == [("/from/b/x", 2), ("/from/c/x", None)]
