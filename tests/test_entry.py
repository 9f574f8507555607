"""The driver's contract, and SQL twins on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from strandloom.plans import queries as core


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("set memory_limit='4GB'")
    for p in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def value(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return round(v, 5) if math.isfinite(v) else str(v)
    return float(v) if isinstance(v, int) and abs(v) < 2**53 else str(v)


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_core_query_equals_sql(spark, duck, small, name):
    df = core.QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = sorted((tuple(value(r[c]) for c in cols) for r in df.collect()), key=str)
    res = duck.execute(core.ORACLE[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(value(r[i]) for i in at) for r in res.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE)))
def test_other_core_queries_run(spark, small, name):
    core.QUERIES[name](spark, small).collect()


def test_entry(spark):
    assert entry.entry(spark).columns == ["multiplicity", "kmers"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
