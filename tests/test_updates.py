"""Batch changes: append, update, enrol."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from campusflow.operators.updates import append_students, enrol_students, update_students


def batch(spark, rows, **types):
    schema = StructType().add("Place", LongType())
    for name, kind in types.items():
        schema = schema.add(name, kind)
    return spark.createDataFrame([(n, *row) for n, row in enumerate(rows)], schema)


def reasons(change):
    return {r.Place: r.Reasons.split(",") for r in change.rejected.collect()}


INT, TEXT = IntegerType(), StringType()
NEW = dict(ProgrammeID=INT, FirstName=TEXT, LastName=TEXT, Email=TEXT, AdmissionYear=INT, Gender=TEXT)


@pytest.fixture
def with_ids(tables, make):
    """Students with ids of the running pattern, and one outside it."""
    ids = ["UG2026001", "UG2026041", "UG2025007", "UG2024999", "X1"]
    rows = [
        {"StudentID": i, "ProgrammeID": 1, "FirstName": "A", "LastName": "B", "Email": f"{i}@x", "Status": "Active"}
        for i in ids
    ]
    return tables | {"Student": make("Student", rows)}


def test_append_continues_the_numbers_of_each_year(spark, with_ids):
    new = batch(
        spark,
        [
            (1, "N0", "Q", "a@x", 2026, "Male"),
            (1, "N1", "Q", "b@x", 2025, None),
            (2, "N2", "Q", None, 2026, "Other"),
            (2, "N3", "Q", None, 2024, "Other"),
            (3, "N4", "Q", "c@x", 2030, "Female"),
        ],
        **NEW,
    )
    change = append_students(with_ids, new, ["Place"])
    added = {r.FirstName: (r.StudentID, r.Status) for r in change.accepted.collect()}
    assert added == {
        "N0": ("UG2026042", "Active"),
        "N1": ("UG2025008", "Active"),
        "N2": ("UG2026043", "Active"),
        "N3": ("UG20241000", "Active"),  # wider past 999
        "N4": ("UG2030001", "Active"),
    }
    assert change.rejected.count() == 0 and change.table.count() == 10
    assert change.table.columns == with_ids["Student"].columns


def test_append_without_a_year_uses_the_current_one(spark, with_ids):
    change = append_students(with_ids, batch(spark, [(1, "N", "Q", None, None, None)], **NEW), ["Place"])
    row = change.accepted.first()
    assert row.AdmissionYear is None and row.StudentID.startswith(f"UG{dt.date.today().year}")


def test_append_refuses_rows_that_break_rules(spark, with_ids):
    new = batch(
        spark,
        [
            (9, "no programme", "Q", None, 2026, None),
            (1, None, "Q", None, 2026, None),
            (1, "gender and year", "Q", None, 1999, "?"),
            (1, "taken", "Q", "X1@x", 2026, None),
            (1, "first", "Q", "same@x", 2026, None),
            (1, "second", "Q", "same@x", 2026, None),
            (None, "bad but first", "Q", "late@x", 2026, None),
            (1, "valid after bad", "Q", "late@x", 2026, None),
        ],
        **NEW,
    )
    change = append_students(with_ids, new, ["Place"])
    assert reasons(change) == {
        0: ["Student.ProgrammeID.foreign_key"],
        1: ["Student.FirstName.not_null"],
        2: ["Student.Gender.domain", "Student.AdmissionYear.range"],
        3: ["Student.Email.unique"],
        5: ["Student.Email.unique"],
        6: ["Student.ProgrammeID.not_null"],
    }
    assert sorted(r.FirstName for r in change.accepted.collect()) == ["first", "valid after bad"]
    assert sorted(r.StudentID for r in change.accepted.collect()) == ["UG2026042", "UG2026043"]


def test_append_keeps_a_given_missing_status(spark, with_ids):
    new = batch(spark, [(1, "N", "Q", None, 2026, None)], **NEW).withColumn("Status", F.lit(None).cast("string"))
    assert append_students(with_ids, new, ["Place"]).accepted.first().Status is None


UPDATE = dict(StudentID=TEXT, Status=TEXT, ProgrammeID=INT)


def test_update_changes_status_and_programme(spark, tables):
    asked = batch(
        spark,
        [
            ("S01", "Graduated", None),
            ("S02", None, 3),
            ("S03", "Active", 1),
            ("nobody", "Active", None),
            ("S04", "?", None),
            ("S05", "Active", 77),
            (None, "Active", None),
        ],
        **UPDATE,
    )
    change = update_students(tables, asked, ["Place"])
    got = {r.StudentID: (r.Status, r.ProgrammeID) for r in change.table.collect()}
    assert len(got) == 8
    assert (got["S01"], got["S02"], got["S03"]) == (("Graduated", 1), ("Active", 3), ("Active", 1))
    assert (got["S04"], got["S05"], got["S06"]) == (("Active", 3), ("Active", 3), (None, 4))
    assert reasons(change) == {
        3: ["Update.StudentID.foreign_key"],
        4: ["Student.Status.domain"],
        5: ["Student.ProgrammeID.foreign_key"],
        6: ["Update.StudentID.not_null"],
    }
    assert sorted(r.StudentID for r in change.accepted.collect()) == ["S01", "S02", "S03"]
    assert change.table.columns == tables["Student"].columns


def test_update_last_value_holds_and_missing_changes_nothing(spark, tables):
    asked = batch(spark, [("S01", "Withdrawn", 2), ("S01", "Suspended", None), ("S01", None, None)], **UPDATE)
    row = update_students(tables, asked, ["Place"]).table.filter("StudentID = 'S01'").first()
    assert (row.Status, row.ProgrammeID) == ("Suspended", 2)


def test_update_twice_is_update_once(spark, tables):
    asked = batch(spark, [("S01", "Graduated", 2), ("S06", "Active", None)], **UPDATE)
    once = update_students(tables, asked, ["Place"]).table
    twice = update_students(tables | {"Student": once}, asked, ["Place"]).table
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_update_of_status_alone(spark, tables):
    asked = batch(spark, [("S01", "Graduated")], StudentID=TEXT, Status=TEXT)
    row = update_students(tables, asked, ["Place"]).table.filter("StudentID = 'S01'").first()
    assert (row.Status, row.ProgrammeID) == ("Graduated", 1)


ENROL = dict(StudentID=TEXT, CourseOfferingID=INT)


def test_enrol_numbers_after_the_largest_key(spark, tables):
    asked = batch(
        spark,
        [
            ("S07", 1),
            ("S01", 3),
            ("S07", 1),  # asked for twice
            ("S01", 1),  # enrolled already
            ("nobody", 1),
            ("S07", 99),
            (None, 1),
        ],
        **ENROL,
    )
    change = enrol_students(tables, asked, ["Place"])
    added = [(r.EnrollmentID, r.StudentID, r.CourseOfferingID) for r in change.accepted.collect()]
    assert sorted(added) == [(9, "S07", 1), (10, "S01", 3)]
    row = change.accepted.first()
    assert row.EnrollmentStatus == "Active" and row.EnrollmentDate is not None
    pair = "Enrollment.StudentID+CourseOfferingID.unique"
    assert reasons(change) == {
        2: [pair],
        3: [pair],
        4: ["Enrollment.StudentID.foreign_key"],
        5: ["Enrollment.CourseOfferingID.foreign_key"],
        6: ["Enrollment.StudentID.not_null"],
    }
    assert change.table.count() == 10 and change.table.schema == tables["Enrollment"].schema


def test_enrol_into_an_empty_table_starts_at_one(spark, tables):
    empty = tables | {"Enrollment": tables["Enrollment"].limit(0)}
    change = enrol_students(empty, batch(spark, [("S01", 1)], **ENROL), ["Place"])
    assert [r.EnrollmentID for r in change.accepted.collect()] == [1]


def test_rows_of_equal_order_still_have_a_first(spark, tables):
    asked = batch(spark, [("S07", 1)] * 5 + [("S07", 2)], **ENROL).withColumn("Place", F.lit(0))
    change = enrol_students(tables, asked, ["Place"])
    pairs = sorted((r.StudentID, r.CourseOfferingID) for r in change.accepted.collect())
    assert pairs == [("S07", 1), ("S07", 2)] and change.rejected.count() == 4
    assert "_arrival" not in change.rejected.columns
