"""Queries against their DuckDB texts."""

from pathlib import Path

import duckdb
import pytest

from campusflow.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_and_sql_agree(spark, name):
    con = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    expected = con.execute(ORACLES[name])
    names = [c[0] for c in expected.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in found.collect()) == sorted(
        repr(tuple(r[k] for k in order)) for r in expected.fetchall()
    )


def test_every_operator_has_a_query():
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))
