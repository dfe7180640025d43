"""Every query of the core against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from emberframe.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CORE = registry()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def canon(df: pd.DataFrame) -> list:
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "~"
        if hasattr(v, "isoformat"):
            return str(pd.Timestamp(v))
        return f"{float(v):.8g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return sorted(tuple(text(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(CORE.sql))
def test_query(spark, con, name):
    """Queries without SQL are tested in test_properties.py."""
    got = CORE.queries[name](spark, DATA)
    want = con.sql(CORE.sql[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got.toPandas()) == canon(want)
