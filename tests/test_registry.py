"""Every query with an oracle agrees with DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from fathomry.plans import registry

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def rows(df):
    cols = sorted(df.columns)
    value = lambda v: round(v, 5) + 0.0 if isinstance(v, float) and not math.isnan(v) else str(v)
    return cols, sorted(([value(v) for v in r] for r in df[cols].values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_oracle(spark, duck, sf, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    spark.catalog.clearCache()
    assert rows(got) == rows(duck.sql(registry.SQL[name]).df())
    assert len(got) > 0


def test_entry_point():
    import __spark_entry__ as e

    assert set(registry.SQL) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
