"""Every query with SQL gives the same rows in Spark and in DuckDB."""

import math

import pytest

from textloom.plans import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_rows(spark, sf_dir, duck, name):
    df = Q.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    mine = [tuple(map(plain, r)) for r in df.select(*columns).collect()]
    got = duck.execute(Q.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == columns
    theirs = [tuple(plain(r[names.index(c)]) for c in columns) for r in got.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(mine, key=key) == sorted(theirs, key=key)
    assert mine
