"""Every query of the driver's tables against its SQL in DuckDB, as the driver compares them."""

import os

import duckdb
import pandas as pd
import pytest

from wayfare.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def canonical(frame):
    def value(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        return repr(round(v, 9)) if isinstance(v, float) else str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(value(v) for v in row) for row in frame.itertuples(index=False)), key=lambda r: [(x is None, x or "") for x in r])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, duck, name):
    ours, theirs = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_stream_upsert_holds_each_event_once(spark):
    rows = registry.QUERIES["stream_upsert"](spark, SF).collect()
    assert sum(r.n for r in rows) == sum(r.ids for r in rows) == spark.read.parquet(f"{SF}/events.parquet").count()


def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.columns == ["id", "start_at", "end_at", "category"] and 0 < found.count() <= 100
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
