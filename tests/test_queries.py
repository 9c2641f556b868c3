"""Every registered query against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from skemaforge.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(rows):
    def one(x):
        return None if x is None or isinstance(x, float) and math.isnan(x) else round(x, 9) if isinstance(x, float) else x

    return sorted((tuple(one(x) for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    sql = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({registry.ORACLES[name]})")
    assert sorted(sql.columns) == columns
    assert plain(df.select(*columns).collect()) == plain(sql.fetchall())


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
