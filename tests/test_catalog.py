import os

import duckdb
import pytest

import __spark_entry__
from lectern import storage
from lectern.plans import catalog
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def compare(spark, query, sql):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    with storage.lifetime(spark) as written:
        df = query(spark, DATA)
        cols = sorted(df.columns)
        got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert not any(map(os.path.exists, written))
    if sql is None:
        assert got
        return
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in done.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    compare(spark, catalog.QUERIES[name], catalog.ORACLES.get(name))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
