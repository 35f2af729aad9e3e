"""Every registered query of the metric engine against its DuckDB equivalent."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from metricloom.oracles import ORACLES
from metricloom.queries import QUERIES


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return ""
        if isinstance(v, float):
            return repr(round(v, 6))
        return str(v).replace(" 00:00:00", "")

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, sf_dir, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.sql(ORACLES[name]).df())



def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and "material" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
