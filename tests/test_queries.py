"""Every registered query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from quantloom.plans.registry import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value if isinstance(value, (int, str, bool, type(None))) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    if name not in ORACLE_SQL:
        assert columns
        return
    result = con.sql(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
