"""Each query of the catalogue against DuckDB on the smallest data."""

import math
import os

import duckdb
import pytest

from loamfield.plans import catalogue

DATA = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    rel = con.execute(catalogue.ORACLES[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
