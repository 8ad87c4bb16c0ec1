"""The operators' queries that have SQL, and the pipeline's rows, over whole tables."""

import duckdb
import pytest
from test_oracle import SF_DIR, TABLES, differences

import __spark_entry__ as entry


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    assert differences(spark, con, name) is None
