"""Every registered query with SQL gives the rows that DuckDB gives for that SQL."""

import decimal
import math
from pathlib import Path

import duckdb
import pytest
from quillon.plans import QUERIES, SQL, Tables


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 8)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](Tables(spark, sf_dir))
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    if name not in SQL:
        assert got
        return
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert sorted(duck.sql(SQL[name]).columns) == columns
    expected = sorted((tuple(map(plain, r)) for r in duck.sql(f"select {quoted} from ({SQL[name]})").fetchall()), key=repr)
    assert got == expected


def test_most_queries_have_sql():
    assert len(SQL) > 0.95 * len(QUERIES)
