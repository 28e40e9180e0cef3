"""Sketches as columns: merged ones see what their parts saw, and ranks are off by no more than is said."""

import numpy as np
from pyspark.sql import functions as F

from wattline.operators import sketches as K


def test_merged_sketches_of_parts(spark, tmp_path):
    df = spark.range(60_000).selectExpr("id % 24 AS hour", "id % 5 AS cell", "pmod(xxhash64(id), 1000) / 7D AS x", "IF(id % 10 = 0, NULL, CAST(id AS double)) AS z").repartition(9)
    K.sketched(df, ["cell", "hour"], ["x", "z"]).write.parquet(f"file://{tmp_path}/sketches")  # sketches are data
    parts = spark.read.parquet(f"file://{tmp_path}/sketches")
    assert parts.count() == 120
    whole = K.merged(K.merged(parts, ["cell"], ["x", "z"]), [], ["x", "z"])
    got = K.points(whole, [], ["x", "z"], 20).toPandas()
    assert set(got[got.label == "x"]["size"]) == {60_000} and set(got[got.label == "z"]["size"]) == {54_000}
    errors = K.rank_errors(K.points(whole, [], ["x", "z"], 20), df, ["x", "z"]).toPandas()
    assert len(errors) == 42 and errors["error"].notna().all() and errors["error"].max() < 0.01
    exact = df.agg(F.percentile("z", [i / 20 for i in range(21)])).first()[0]
    assert np.allclose(got[got.label == "z"].sort_values("i")["x"], exact, atol=600)


def test_empty_groups_have_no_points(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None)], "k string, x double")
    got = K.points(K.sketched(df, ["k"], ["x"]), ["k"], ["x"], 2).orderBy("i").collect()
    assert [(r.k, r.i, r.x) for r in got] == [("a", 0, 1.0), ("a", 1, 1.0), ("a", 2, 2.0)]
    assert K.points(K.sketched(df.limit(0), ["k"], ["x"]), ["k"], ["x"]).count() == 0
