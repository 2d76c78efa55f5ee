"""Each query of the catalog against its DuckDB SQL, rows, names and types, at the smallest scale."""

import os

import duckdb
import pytest

from phaselens.plans import catalog

DATA = "/root/testdata/sf0.001"
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    found = catalog.queries()[name](spark, DATA)
    got = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in got.description]
    types = {d[0]: str(d[1]) for d in got.description}
    assert sorted(names) == sorted(found.columns)
    assert {c: TYPES[t] for c, t in found.dtypes} == types
    order = sorted(names)
    expected = sorted(repr(tuple(r[names.index(c)] for c in order)) for r in got.fetchall())
    assert sorted(repr(tuple(r[c] for c in order)) for r in found.collect()) == expected


def test_entry_points_without_llm():
    import __spark_entry__

    assert set(catalog.oracle_sql()) <= set(__spark_entry__.oracle_sql())
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
