"""Every relational query against its SQL in another engine, over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from rowloom.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    cell = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = canonical(df.columns, df.collect())
    found = duck.sql(ORACLE_SQL[name])
    want = canonical(found.columns, found.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
