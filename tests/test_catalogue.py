"""Every query with an oracle against DuckDB at the smallest scale, and the shape of the registry."""

import datetime
import glob
import os
import subprocess
import sys

import duckdb
import pytest
from conftest import ROOT, SF

from tidemark.plans import catalogue


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return float(v) if hasattr(v, "as_tuple") else v


def same(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return abs(a - b) <= 2e-5 + 1e-9 * abs(b)
    return a == b


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    key = lambda r: tuple((x is None, str(round(x, 3) if isinstance(x, float) else x)) for x in r)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=key)
    sql = "select " + ", ".join(f'"{c}"' for c in cols) + f" from ({catalogue.ORACLE_SQL[name]})"
    want = sorted((tuple(map(plain, r)) for r in duck.sql(sql).fetchall()), key=key)
    assert len(got) == len(want)
    assert all(same(x, y) for a, b in zip(got, want) for x, y in zip(a, b))


def test_rows_only_queries_run(spark):
    for name in set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL):
        assert catalogue.QUERIES[name](spark, SF).count() > 0, name


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 40 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_flagship(spark):
    assert catalogue.flagship(spark, SF).count() > 0
