"""Every query with SQL gives DuckDB's rows."""

import math
import os

import duckdb
import pytest

from tessella.plans import registry

DATA = "/root/testdata/sf0.001"


def plain(value):
    return ("nan" if math.isnan(value) else round(value, 6)) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{file}')")
    got = registry.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    want = con.execute(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert rows == sorted((tuple(plain(v) for v in r) for r in want), key=repr)
    assert rows
