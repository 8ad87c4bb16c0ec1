"""Every query that has SQL gives the same columns and rows in Spark and in DuckDB."""

import math
import os
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = [p.stem for p in Path(SF_DIR).glob("*.parquet")]
CORE = [name for name in entry.oracle_sql() if not name.startswith("op")]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return con


def plain(x):
    """A value as both engines write it."""
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark, db, name, sf_dir=SF_DIR):
    """What only one engine has: (columns, rows of Spark, rows of DuckDB)."""
    df = entry.queries()[name](spark, sf_dir)
    got = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    if sorted(df.columns) != sorted(columns):
        return sorted(df.columns), sorted(columns), None
    a, b = rows_of(df.columns, df.collect()), rows_of(columns, got.fetchall())
    return (columns, a - b, b - a) if a != b else None


@pytest.mark.parametrize("name", CORE)
def test_same_rows(spark, db, name):
    assert differences(spark, db, name) is None


def test_names_and_entry(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert entry.entry(spark).columns == queries["search_hybrid"](spark, SF_DIR).columns
