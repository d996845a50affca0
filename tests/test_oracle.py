"""Every query with SQL gives the same rows in both engines, and not trivially."""

import math
import os

import duckdb
import pandas as pd
import pytest

from chronofold import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, str | bool):
            return v
        return int(v) if float(v) == int(v) else round(float(v), 9)

    return sorted((tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_commit_ts_is_unique(spark):
    from chronofold.plans import views

    c = views.changes(spark, SF)
    assert c.count() == c.select("commit_ts").distinct().count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
