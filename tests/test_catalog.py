"""Every query of the catalogue against its DuckDB twin, at the smallest scale."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from docscreen.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in ("customer", "orders", "part", "events", "nation", "documents", "embeddings"):
        c.execute(f"create view {n} as select * from '{SF}/{n}.parquet'")
    return c


def normal(x: pd.DataFrame) -> pd.DataFrame:
    x = x[sorted(x.columns)].copy()
    for k in x.columns:
        if x[k].dtype == object:
            x[k] = x[k].map(lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else str(v))
        elif x[k].dtype.kind in "fiu" or str(x[k].dtype).startswith("Int"):
            x[k] = x[k].astype(float).round(6)
        x[k] = x[k].astype(str).replace({"nan": "None", "<NA>": "None", "NaT": "None", "True": "1.0", "False": "0.0"})
    return x.sort_values(list(x.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, duck, name):
    pd.testing.assert_frame_equal(normal(QUERIES[name](spark, SF).toPandas()), normal(duck.execute(ORACLES[name]).df()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
