"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from ridgeline.plans import catalog, registry  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET threads = 2")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, str | bool):
        return v
    if isinstance(v, list | tuple):
        return str(v)
    return None if math.isnan(float(v)) else float(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    columns = sorted(df.columns)
    assert columns == sorted(con.sql(sql).columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(columns).toPandas().itertuples(index=False)), key=repr)
    want = sorted((tuple(plain(v) for v in r) for r in con.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({sql})").fetchall()), key=repr)
    assert got == want
