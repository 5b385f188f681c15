"""Every registered query against its oracle, as values that don't depend on row order."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

from .conftest import DATA


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}") + 0.0
    return float(value) if isinstance(value, int) and not isinstance(value, bool) else str(value) if value is not None else None


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(([plain(r[i]) for i in order] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    wanted = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in wanted.description]
    rows = table(got.columns, [tuple(r) for r in got.collect()])
    assert rows[1] and rows == table(names, wanted.fetchall())
