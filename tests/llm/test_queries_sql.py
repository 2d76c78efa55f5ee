"""Registered queries against their DuckDB SQL at the smallest scale."""

import os

import duckdb
import pytest

from phaselens.llm import queries as llm

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    found = llm.queries()[name](spark, DATA)
    got = con.execute(llm.oracle_sql()[name])
    names = [d[0] for d in got.description]
    order = sorted(names)
    assert order == sorted(found.columns)
    expected = sorted(repr(tuple(r[names.index(c)] for c in order)) for r in got.fetchall())
    assert sorted(repr(tuple(r[c] for c in order)) for r in found.collect()) == expected
