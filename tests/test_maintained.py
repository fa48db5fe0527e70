"""Kept sums against full recomputation, the plans of a refresh, and which files a change rewrites."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from campusflow.operators import maintained
from campusflow.operators.filters import StudentFilter
from campusflow.plans import engagement, finance, marks, overview
from campusflow.sources import partitions
from tests.test_random import random_records

FILTERS = [StudentFilter(), StudentFilter(statuses=["Active"], genders=["Female", "Male"]), StudentFilter(programmes=[])]


@pytest.fixture(scope="module")
def records(make):
    return random_records(make, 4)


def rows(df) -> list[str]:
    return sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


def assert_figures(states, tables):
    """Every figure from the states equals the analytic over the tables."""
    programme = tables["Programme"]
    for choice in FILTERS:
        for ours, theirs in (
            (maintained.students_per_programme, overview.students_per_programme),
            (maintained.gender_share, overview.gender_share),
            (maintained.status_distribution, overview.status_distribution),
            (maintained.programme_gender, overview.programme_gender),
            (maintained.programme_gender_wide, overview.programme_gender_wide),
            (maintained.programme_marks, marks.programme_marks),
            (maintained.kpi_row, overview.kpi_row),
        ):
            assert rows(ours(states, programme, choice)) == rows(theirs(tables, choice)), ours.__name__
    assert rows(maintained.programme_performance(states, programme)) == rows(marks.programme_performance(tables))
    assert rows(maintained.grade_distribution(states)) == rows(marks.grade_distribution(tables))
    assert rows(maintained.payment_methods(states)) == rows(finance.payment_methods(tables))
    assert rows(maintained.activity_types(states)) == rows(engagement.activity_types(tables))
    assert rows(maintained.course_enrolment(states, tables)) == rows(marks.course_enrolment(tables))


def assert_states(states, tables):
    for name, state in maintained.summarise(tables).items():
        assert rows(states[name]) == rows(state), name


def test_figures_of_fresh_states(records):
    assert_figures(maintained.summarise(records), records)


def test_every_change_merges_to_the_full_sums(spark, make, records, tmp_path):
    states = maintained.StoredStates.create(spark, maintained.summarise(records), str(tmp_path / "states"), parts=4)
    tables = dict(records)

    new = make("Student", [{"StudentID": f"NEW{n}", "ProgrammeID": 1 + n % 3, "FirstName": "A", "LastName": "B", "Gender": "Female", "Status": "Active"} for n in range(7)])
    tables["Student"] = tables["Student"].unionByName(new)
    states.put(maintained.appended(states, new))
    assert_states(states, tables)

    old = tables["Student"].filter("StudentID LIKE '%3%'")
    moved = old.withColumns({"ProgrammeID": F.lit(2), "Status": F.lit("Graduated")})
    tables["Student"] = tables["Student"].join(old.select("StudentID"), "StudentID", "left_anti").unionByName(moved)
    states.put(maintained.updated(states.naming(moved), moved))
    assert_states(states, tables)

    person = [r.StudentID for r in tables["Student"].orderBy("StudentID").limit(3).collect()]
    asked = make("Enrollment", [(900 + n, person[n % 3], 1 + n, dt.date(2026, 1, 1), "Enrolled") for n in range(6)] + [(999, "nobody", 1, dt.date(2026, 1, 1), None)])
    tables["Enrollment"] = tables["Enrollment"].unionByName(asked)
    states.put(maintained.enrolled(states.naming(asked), asked))
    assert_states(states, tables)

    results = make("AssessmentResult", [(900 + n, 900 + n, Decimal(50 + n), Decimal(60) if n else None, "A" if n % 2 else "F") for n in range(6)])
    tables["AssessmentResult"] = tables["AssessmentResult"].unionByName(results)
    states.put(maintained.marked(states.naming(asked), results, asked))
    assert_states(states, tables)

    payments = make("FeePayment", [(900, person[0], Decimal("10.50"), dt.date(2026, 1, 2), "Cash", Decimal("3.25")), (901, person[1], Decimal(1), dt.date(2026, 1, 2), None, None)])
    events = make("LMSActivity", [(900, person[0], 1, dt.datetime(2026, 1, 2), "new kind", 5), (901, None, None, None, None, None)])
    tables |= {"FeePayment": tables["FeePayment"].unionByName(payments), "LMSActivity": tables["LMSActivity"].unionByName(events)}
    states.put(maintained.paid(states, payments) | maintained.active(states, events))
    assert_states(states, tables)
    assert_figures(states, tables)

    nothing = tables["Student"].limit(0)
    assert states.put(maintained.updated(states.naming(nothing), nothing)) == []
    assert_states(states, tables)


def test_a_cell_without_students_is_gone(spark, make, records):
    states = maintained.summarise(records)
    everyone = records["Student"].withColumn("Status", F.lit("Withdrawn"))
    cube = maintained.updated(states, everyone)["cube"]
    assert {r.Status for r in cube.collect()} == {"Withdrawn"}


def test_a_refresh_scans_no_old_fact(spark, records, tmp_path):
    for name, table in records.items():
        table.write.parquet(str(tmp_path / "tables" / name))
    tables = {name: spark.read.parquet(str(tmp_path / "tables" / name)) for name in records}
    states = maintained.StoredStates.create(spark, maintained.summarise(tables), str(tmp_path / "states"), parts=4)
    batch = spark.createDataFrame(records["Enrollment"].limit(5).collect(), records["Enrollment"].schema)
    for state in maintained.enrolled(states.naming(batch), batch).values():
        plan = state._jdf.queryExecution().optimizedPlan().toString()
        files = [f for f in state.inputFiles()]
        assert files and all("/states/" in f for f in files), plan


def test_only_touched_partitions_are_rewritten(spark, make, tmp_path):
    folder = str(tmp_path / "students")
    students = spark.range(2000).select(F.concat(F.lit("S"), "id").alias("StudentID"), F.lit(1).alias("ProgrammeID"), F.lit("x").alias("Status"))
    partitions.save_partitioned(students, folder, "StudentID", 64)
    before = set(partitions.partition_files(spark, folder))
    changed = students.filter("StudentID IN ('S1','S2','S3','S4','S5','S6','S7','S8','S9')").withColumn("Status", F.lit("y"))
    added = changed.limit(1).withColumn("StudentID", F.lit("new"))
    touched = partitions.rewrite_changed(spark, folder, changed.unionByName(added), "StudentID", 64)
    after = set(partitions.partition_files(spark, folder))
    assert 1 <= len(touched) <= 10
    assert len(before - after) <= 10 and len(before & after) >= 54
    expected = {r.StudentID: r.Status for r in students.collect()} | {f"S{n}": "y" for n in range(1, 10)} | {"new": "y"}
    assert {r.StudentID: r.Status for r in partitions.read_partitioned(spark, folder).collect()} == expected
    found = partitions.stored_rows(spark, folder, changed, "StudentID", 64)
    assert {r.StudentID for r in found.collect()} == {f"S{n}" for n in range(1, 10)}
    assert partitions.rewrite_changed(spark, folder, changed.limit(0), "StudentID", 64) == []
