"""Every query with SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from placelink import flows as Q

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(str(tuple(round(float(x), 7) if type(x).__name__ in ("float", "Decimal") else x for x in r)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, db, name):
    df = Q.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = plain(df.select(*(f"`{c}`" for c in columns)).collect())
    if name in Q.ORACLES:
        want = db.sql(Q.ORACLES[name])
        assert sorted(want.columns) == columns
        assert got == plain(want.select(*(f'"{c}"' for c in columns)).fetchall())
