"""Analytics and checks against DuckDB on random records that break most rules.

Keys that other tables refer to stay unique, as both engines of the original
data enforce primary keys.  Everything else may be missing, repeated or
dangling.
"""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import duckdb
import pytest

from testbed.registry import QUERIES, TEXTS

NAMES = [
    "filter_values", "kpi_row", "kpi_row_chosen", "students_per_programme", "gender_split", "share_of_total",
    "status_distribution", "programme_gender", "programme_gender_wide", "filter_students", "student_programme",
    "programme_totals", "grade_summary", "programme_marks", "programme_marks_chosen", "programme_marks_all",
    "programme_performance", "grade_distribution", "grade_ranks", "score_scatter", "grade_quadrants", "credit_load",
    "student_courses", "course_enrolment", "engagement_outcome", "top_engagement", "engagement_q3",
    "early_warning", "activity_types", "payment_methods", "payment_totals", "outstanding_worklist",
    "outstanding_q4", "outstanding_max", "total_revenue", "check_not_null", "check_unique", "check_foreign_key",
    "check_domain", "check_range", "check_length", "failing_rows", "orphan_enrollments", "orphan_results",
    "row_count_summary", "load_literals", "next_key",
]


def random_records(make, seed: int) -> dict:
    rnd = random.Random(seed)

    def maybe(value, share=0.1):
        return None if rnd.random() < share else value

    def money(low, high):
        return Decimal(rnd.randint(low, high)) / 100

    def student():
        # A third of everything belongs to one student.
        return maybe("S1" if rnd.random() < 0.3 else f"S{rnd.randint(1, 45)}", 0.03)

    def offering():
        return rnd.randint(1, 9)

    day = dt.date(2026, 1, 1)
    grades = ["A", "B+", "B", "C+", "C", "D+", "D", "F", "I", "Z"]
    return {
        "Department": make("Department", [(n, rnd.choice("xyz"), maybe("f"), None) for n in (1, 2, 3)]),
        "Programme": make(
            "Programme",
            [
                (n, maybe(rnd.randint(1, 4)), f"P{n}", maybe(rnd.choice(["NATION_1", "NATION_2", "NATION_4"])),
                 maybe(rnd.choice(["BSc", "?"])), maybe(rnd.randint(-1, 3)))
                for n in range(1, 7)
            ],
        ),
        "Course": make(
            "Course",
            [
                (n, rnd.randint(1, 4), maybe(rnd.choice(["C1", "C2", "C3", "a code too long"])),
                 maybe(rnd.choice(["Kilns", "Tides"])), maybe(rnd.randint(0, 7)))
                for n in range(1, 6)
            ],
        ),
        "Lecturer": make("Lecturer", [(f"L{n}", n, "x", None, maybe(rnd.choice("ab"))) for n in (1, 2, 3)]),
        "Semester": make("Semester", [(n, "s", day, maybe(day + dt.timedelta(rnd.randint(-1, 1)))) for n in (1, 2)]),
        "Student": make(
            "Student",
            [
                (f"S{n}", maybe(rnd.randint(1, 7)), maybe(f"F{n % 5}"), f"L{n}",
                 maybe(rnd.choice(["Female", "Male", "Other", "?"]), 0.2), None, maybe(f"e{n % 30}"), None,
                 maybe(rnd.randint(1998, 2003)), maybe(rnd.choice(["BUILDING", "MACHINERY", "FURNITURE", "gone"])))
                for n in range(1, 41)
            ],
        ),
        "CourseOffering": make(
            "CourseOffering",
            [(n, rnd.randint(1, 6), f"L{rnd.randint(1, 4)}", rnd.randint(1, 2), "2025/2026") for n in range(1, 9)],
        ),
        "Enrollment": make(
            "Enrollment",
            [(n, student(), offering(), maybe(day), maybe(rnd.choice("FOP"))) for n in range(1, 201)],
        ),
        "AssessmentResult": make(
            "AssessmentResult",
            [
                (n, maybe(rnd.randint(1, 220), 0.03), maybe(money(-50, 10050)), maybe(money(0, 10000)),
                 maybe(rnd.choice(grades)))
                for n in range(1, 181)
            ],
        ),
        "FeePayment": make(
            "FeePayment",
            [
                (n, student(), maybe(money(-5, 99999)), day, maybe(rnd.choice(["1-URGENT", "2-HIGH", "x"])),
                 maybe(money(-50000, 50000)))
                for n in range(1, 151)
            ],
        ),
        "LMSActivity": make(
            "LMSActivity",
            [
                (n, student(), maybe(offering()), maybe(dt.datetime(2026, 2, 1)),
                 maybe(rnd.choice(["signup", "view", "error"])), maybe(rnd.randint(-2, 90)))
                for n in range(1, 401)
            ],
        ),
    }


@pytest.fixture(scope="module", params=[1, 2, 3])
def records(request, make):
    tables = random_records(make, request.param)
    connection = duckdb.connect()
    for name, df in tables.items():
        arrow = df.toArrow()
        connection.register(name, arrow)
    return tables, connection


@pytest.mark.parametrize("name", NAMES)
def test_random_records(records, spark, name):
    tables, connection = records

    class Records(dict):
        def damaged(self):
            """These records break the rules already."""
            return self

    given = Records(tables)
    given.spark = spark
    answer = connection.execute(TEXTS[name])
    columns = [c[0] for c in answer.description]
    expected = sorted(tuple(map(str, row)) for row in answer.fetchall())
    df = QUERIES[name](given)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(str(row[c]) for c in columns) for row in df.collect()) == expected
