"""Every registered query against its SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import datetime
import math

import duckdb
import pytest

from tickforge import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return str(v) if isinstance(v, datetime.date) else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, tiny, duck, name):
    df = registry.queries()[name](spark, tiny)
    found = duck.execute(registry.oracle_sql()[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([c[0] for c in found.description], found.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_has_rows(spark, tiny, name):
    assert registry.queries()[name](spark, tiny).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["timestamp", "mean", "n", "growth", "drawdown"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
