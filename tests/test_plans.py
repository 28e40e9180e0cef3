"""Every registered query against its oracle, and that all run."""

import duckdb
import pytest

from wattline import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Slow learners are run once elsewhere.
SLOW = {"kmeans_scan", "gbt_ceiling", "meter_only_headroom", "gbt_forecast", "importances"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None else round(v, 9) + 0.0 if isinstance(v, float) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(set(plans.oracles())))
def test_oracle(spark, sf, duck, name):
    df = plans.queries()[name](spark, sf)
    got = rows(df.columns, df.collect())
    found = duck.execute(plans.oracles()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    want = rows(names, found.fetchall())
    assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want]


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracles()) - SLOW))
def test_runs(spark, sf, name):
    assert plans.queries()[name](spark, sf).count() > 0


def test_every_oracle_has_a_query():
    assert set(plans.oracles()) <= set(plans.queries())
