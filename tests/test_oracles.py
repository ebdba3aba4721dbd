"""Every registered query with SQL gives the same rows as the SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from claimlens.plans import catalog

QUERIES, ORACLES = catalog.load()
# Kept short here; tools/check_oracles.py runs all of them.
KEYS = ["A1", "A3", "A5", "A6", "A7", "A9", "F1", "F2", "F12", "F13", "J1", "J2", "J5", "J9", "L2", "L5", "P2", "P3", "P5", "P7", "P8", "T3", "T12", "T13",
        "V3", "V4", "V6", "W1", "B1", "R1", "R3", "R3_chain", "E2", "E6", "E7", "E10", "E11", "E12", "S8", "S12", "S19", "T17", "P9", "P11", "P11_full", "P11_augmented"]


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([cell(v[i]) for i in order] for v in values)


@pytest.mark.parametrize("key", KEYS)
def test_matches_sql(spark, data, con, key):
    df = QUERIES[key](spark, data)
    result = con.execute(ORACLES[key])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, result.fetchall())


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
