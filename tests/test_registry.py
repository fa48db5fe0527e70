"""Every checked query against DuckDB on the smallest test tables."""

from __future__ import annotations

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from campusflow.operators.filters import StudentFilter
from campusflow.plans import engagement, overview
from testbed.registry import QUERIES
from testbed.views import SOURCE_SCHEMAS, RecordTables, oracle

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in SOURCE_SCHEMAS:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(row[i]) for i in order) for row in rows)


def assert_equal(df, duck, text):
    answer = duck.execute(text)
    columns = [c[0] for c in answer.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.collect(), df.columns) == canonical(answer.fetchall(), columns)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(queries()) and set(QUERIES) <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    assert_equal(queries()[name](spark, SF_DIR), duck, oracle_sql()[name])


# ---- properties that hold for any selection -----------------------------------------------

SELECTIONS = [
    StudentFilter(),
    StudentFilter(genders=["Female"]),
    StudentFilter(statuses=["BUILDING", "MACHINERY"], programmes=["NATION_3", "NATION_4", "NATION_19"]),
    StudentFilter(programmes=[]),
]


@pytest.mark.parametrize("selection", SELECTIONS, ids=str)
def test_totals_agree_under_any_selection(spark, selection):
    tables = RecordTables(spark, SF_DIR)
    kpi = overview.kpi_row(tables, selection).first()
    per_programme = overview.students_per_programme(tables, selection).collect()
    assert sum(r.Students for r in per_programme) == kpi.students
    shares = [r.Share for r in overview.gender_share(tables, selection).collect()]
    assert abs(sum(shares) - (1 if shares else 0)) < 1e-9
    outcome = engagement.engagement_outcome(tables, selection).agg({"Events": "sum", "*": "count"}).first()
    assert outcome["count(1)"] == kpi.enrollments  # the pair is unique in these tables
    assert (outcome["sum(Events)"] or 0) <= kpi.lms_events


def test_unknown_words_in_an_oracle_text_stay(duck):
    assert oracle("SELECT 1 AS x FROM Department").startswith("WITH Department AS")


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("check_")))
def test_every_rule_finds_a_row(spark, name):
    assert [r.RuleID for r in queries()[name](spark, SF_DIR).collect() if not r.Violations] == []


def test_orphans_are_there(spark):
    assert queries()["orphan_enrollments"](spark, SF_DIR).count() and queries()["orphan_results"](spark, SF_DIR).count()
