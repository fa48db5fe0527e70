"""A local session and a small, valid set of invented records."""

from __future__ import annotations

import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from campusflow.schema import SCHEMAS  # noqa: E402
from campusflow.session import tuned  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
    )
    session = tuned(builder).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def nullable(schema: StructType) -> StructType:
    return StructType([StructField(f.name, f.dataType, True) for f in schema])


@pytest.fixture(scope="session")
def make(spark):
    """Build a records table from dicts or tuples; columns not given are NULL."""

    def build(table: str, rows: list, only: list[str] | None = None) -> DataFrame:
        schema = nullable(SCHEMAS[table])
        if only:
            schema = StructType([schema[c] for c in only])
        full = [tuple(r.get(c) for c in schema.names) if isinstance(r, dict) else tuple(r) for r in rows]
        return spark.createDataFrame(full, schema)

    return build


def D(text: str) -> Decimal:
    return Decimal(text)


DAY = dt.date(2026, 1, 15)


@pytest.fixture(scope="session")
def tables(make):
    """Ten invented students around the edge cases the analytics must survive."""
    students = [
        # id, programme, first, last, gender, status
        ("S01", 1, "Ada", "Quist", "Female", "Active"),
        ("S02", 1, "Ben", "O'Dell", "Male", "Active"),
        ("S03", 2, "Cy", "Marsh", "Male", "Graduated"),
        ("S04", 3, "Di", "Noor", "Female", "Active"),
        ("S05", 3, "Eli", "Ward", None, "Active"),  # no gender
        ("S06", 4, "Fay", "Lund", "Other", None),  # no status
        ("S07", 2, "Gil", "Roth", "Male", "Withdrawn"),  # no enrollment
        ("S08", 1, None, "Vance", "Female", "Active"),  # no first name
    ]
    programmes = [
        (1, 1, "P-ONE", "Ma'at Studies"),
        (2, 1, "P-TWO", "Glass Blowing"),
        (3, 2, "P-THREE", "Tidal Maps"),
        (4, 2, "P-FOUR", "Tidal Maps"),  # a second programme of that name
    ]
    enrollments = [
        # id, student, offering
        (1, "S01", 1),
        (2, "S01", 2),
        (3, "S02", 1),
        (4, "S03", 2),
        (5, "S04", 1),
        (6, "S05", 1),
        (7, "S06", 2),
        (8, "S08", 3),
    ]
    results = [
        # id, enrollment, coursework, exam, grade
        (1, 1, D("50.00"), D("50.01"), "A"),
        (2, 3, None, D("50.01"), "I"),
        (3, 4, D("40.00"), D("70.00"), "B"),
        (4, 5, D("70.00"), D("30.00"), "F"),
        (5, 6, D("20.00"), D("10.00"), None),
        (6, 7, D("90.00"), D("95.50"), "Z"),  # off the scale
        (7, 8, D("50.00"), D("50.00"), "D"),
    ]
    payments = [
        # id, student, paid, method, balance
        (1, "S01", D("100.00"), "Card", D("500.00")),
        (2, "S01", D("50.50"), "Bank", D("200.00")),
        (3, "S02", D("10.00"), "Card", D("300.00")),
        (4, "S02", D("10.00"), "Cash", D("-300.00")),
        (5, "S03", D("999.99"), None, D("0.00")),
        (6, "S04", D("1.00"), "Card", None),
        (7, "S05", D("2.00"), "Bank", D("0.01")),
    ]
    activity = [
        # id, student, offering, type, minutes
        (1, "S01", 1, "Login", 30),
        (2, "S01", 1, "Forum", 15),
        (3, "S01", 3, "Login", 99),  # pair not enrolled
        (4, "S02", 1, "PageView", None),
        (5, "S04", 1, "Login", 60),
        (6, "S04", None, "Login", 7),  # no offering
        (7, "S07", 2, "Forum", 5),  # student without enrollment
        (8, "S08", 3, "Login", 61),
    ]
    stamp = dt.datetime(2026, 2, 1, 10, 0)
    return {
        "Department": make("Department", [(1, "Craft", "Arts", "Hall 1"), (2, "Sea", "Science", None)]),
        "Programme": make("Programme", [(*p, "BSc", 3) for p in programmes]),
        "Course": make("Course", [(1, 1, "C1", "Kilns", 3), (2, 1, "C2", "Tides", 2), (3, 2, "C3", "Kilns", None)]),
        "Lecturer": make("Lecturer", [("L1", 1, "Ivo Tan", "Senior", "ivo@example.edu")]),
        "Semester": make("Semester", [(1, "First", dt.date(2026, 1, 1), dt.date(2026, 5, 1))]),
        "Student": make(
            "Student",
            [
                (i, p, first, last, g, DAY, f"{i.lower()}@example.edu", "0" + i[1:], 2026, status)
                for i, p, first, last, g, status in students
            ],
        ),
        "Admission": make("Admission", [(1, 1, "Jo Pike", DAY, "Pending")]),
        "CourseOffering": make("CourseOffering", [(n, n, "L1", 1, "2025/2026") for n in (1, 2, 3)]),
        "Enrollment": make("Enrollment", [(*e, DAY, "Active") for e in enrollments]),
        "AssessmentResult": make("AssessmentResult", results),
        "FeePayment": make("FeePayment", [(i, s, paid, DAY, m, b) for i, s, paid, m, b in payments]),
        "LMSActivity": make("LMSActivity", [(i, s, o, stamp, kind, n) for i, s, o, kind, n in activity]),
    }


@pytest.fixture(scope="session")
def rows():
    """Rows of a frame as plain tuples, in result order."""
    return lambda df, *columns: [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
