"""Every rule broken once, bounds of every range, and NULL in every optional place."""

from __future__ import annotations

import datetime as dt
from collections import Counter
from decimal import Decimal
from functools import reduce

import pytest
from pyspark.sql import DataFrame

from campusflow.operators import quality
from campusflow.operators.keycounts import KeyCounts
from campusflow.operators.quality import check_rules
from campusflow.schema import DOMAINS, PRIMARY_KEYS, SCHEMAS, Rule, contract_rules

DAY = dt.date(2026, 3, 1)
VALID = 60  # valid rows per table; fewer where a row needs a parent row of its own
VALID_ROWS = {"CourseOffering": 50, "Enrollment": 40, "AssessmentResult": 20}


def good_row(table: str, n: int) -> dict:
    """A valid row with key ``n``; parents are found among the first 60 rows."""
    p = 1 + n % 20
    return {
        "Department": dict(DepartmentID=n, DepartmentName=f"Dept {n}", Faculty="Arts", OfficeLocation="Hall"),
        "Programme": dict(ProgrammeID=n, DepartmentID=p, ProgrammeCode=f"P{n}", ProgrammeName="Maps",
                          DegreeType="BSc", DurationYears=3),
        "Course": dict(CourseID=n, DepartmentID=p, CourseCode=f"C{n}", CourseTitle="Kilns", CreditHours=3),
        "Lecturer": dict(LecturerID=f"L{n}", DepartmentID=p, LecturerName="Ivo", Rank="Senior", Email=f"l{n}@x"),
        "Semester": dict(SemesterID=n, SemesterName="First", StartDate=DAY, EndDate=DAY + dt.timedelta(1)),
        "Student": dict(StudentID=f"S{n}", ProgrammeID=p, FirstName="Ada", LastName="Q", Gender="Female",
                        DateOfBirth=DAY, Email=f"s{n}@x", PhoneNumber="01", AdmissionYear=2026, Status="Active"),
        "Admission": dict(AdmissionID=n, ProgrammeID=p, ApplicantName="Jo", AdmissionDate=DAY,
                          AdmissionStatus="Pending"),
        "CourseOffering": dict(CourseOfferingID=n, CourseID=1 + (n - 1) % 60, LecturerID=f"L{p}", SemesterID=p,
                               AcademicYear="2025/2026"),
        "Enrollment": dict(EnrollmentID=n, StudentID=f"S{1 + (n - 1) % 60}", CourseOfferingID=p, EnrollmentDate=DAY,
                           EnrollmentStatus="Active"),
        "AssessmentResult": dict(ResultID=n, EnrollmentID=n, CourseworkScore=Decimal(50), ExamScore=Decimal(50),
                                 FinalGrade="B"),
        "FeePayment": dict(PaymentID=n, StudentID=f"S{p}", AmountPaid=Decimal(1), PaymentDate=DAY,
                           PaymentMethod="Card", Balance=Decimal(0)),
        "LMSActivity": dict(ActivityID=n, StudentID=f"S{p}", CourseOfferingID=p,
                            LoginTimestamp=dt.datetime(2026, 3, 1), ActivityType="Login", DurationMinutes=1),
    }[table]


def good_rows(table: str) -> list[dict]:
    return [good_row(table, n) for n in range(1, VALID_ROWS.get(table, VALID) + 1)]


# One value on the wrong side and the allowed edges of every range rule.
RANGE_EDGES = {
    "DurationYears": ([0, -1], [1]),
    "CreditHours": ([0, 7], [1, 6]),
    "AdmissionYear": ([1999, 2101], [2000, 2100]),
    "CourseworkScore": ([Decimal("-0.01"), Decimal("100.01")], [Decimal(0), Decimal(100)]),
    "ExamScore": ([Decimal("-0.01"), Decimal("100.01")], [Decimal(0), Decimal(100)]),
    "AmountPaid": ([Decimal("-0.01")], [Decimal(0)]),
    "DurationMinutes": ([-1], [0]),
}


def unknown_parent(rule: Rule):
    return "nobody" if rule.columns[0] in ("StudentID", "LecturerID") else 999_999


def break_rule(rule: Rule, row: dict) -> dict:
    """Change one valid row with a fresh key so that it breaks just this rule."""
    first = good_row(rule.table, 1)
    column = rule.columns[0]
    if rule.kind == "not_null":
        return row | {column: None}
    if rule.kind in ("primary_key", "unique"):
        return row | {c: first[c] for c in rule.columns}
    if rule.kind == "foreign_key":
        return row | {column: unknown_parent(rule)}
    if rule.kind == "domain":
        return row | {column: "?"}
    if rule.kind == "range":
        if column == "StartDate":
            return row | {"EndDate": row["StartDate"]}
        return row | {column: RANGE_EDGES[column][0][0]}
    return row | {column: "x" * (rule.width + 1)}


@pytest.fixture(scope="module")
def sound(make):
    return {table: make(table, good_rows(table)) for table in SCHEMAS}


def counts(df):
    return {r.RuleID: r.Violations for r in df.collect()}


def test_contract_has_the_expected_rules():
    kinds = Counter(rule.kind for rule in contract_rules())
    del kinds["length"]
    assert kinds == {
        "not_null": 32, "primary_key": 12, "unique": 8, "foreign_key": 14, "domain": 8, "range": 8,
    }


def test_sound_tables_break_nothing(sound):
    got = counts(quality.check_rules(sound))
    assert len(got) == len(contract_rules()) and set(got.values()) == {0}


@pytest.mark.parametrize(
    "kinds", [("not_null",), ("primary_key", "unique"), ("foreign_key",), ("domain", "range"), ("length",)]
)
def test_each_rule_broken_once_is_reported_once(sound, make, kinds):
    # Keys too long for their column would also miss their parent, so their
    # references are not checked here; NULL keys of unique columns pass.
    broken = dict(sound)
    chosen = [r for r in contract_rules() if r.kind in kinds]
    for table in SCHEMAS:
        start = VALID_ROWS.get(table, VALID)
        bad = [
            break_rule(rule, good_row(table, start + i))
            for i, rule in enumerate((r for r in chosen if r.table == table), start=1)
        ]
        if bad:
            broken[table] = sound[table].unionByName(make(table, bad))
    got = counts(quality.check_rules(broken, chosen))
    assert got == {rule.rule_id: 1 for rule in chosen}


def test_range_edges(make, sound):
    for rule in (r for r in contract_rules() if r.kind == "range" and r.columns[0] in RANGE_EDGES):
        column = rule.columns[0]
        wrong, right = RANGE_EDGES[column]
        rows = [good_row(rule.table, n) | {column: v} for n, v in enumerate(wrong + right + [None], start=1)]
        df = make(rule.table, rows)
        assert counts(quality.check_range({rule.table: df}, [rule])) == {rule.rule_id: len(wrong)}
        assert quality.failing_rows({rule.table: df}, rule).count() == len(wrong)


def test_missing_values_pass_value_rules_references_and_unique(make, sound):
    nullable = {
        "Lecturer": ["Email"],
        "Student": ["Email", "Gender", "AdmissionYear", "Status"],
        "LMSActivity": ["CourseOfferingID", "ActivityType", "DurationMinutes"],
        "AssessmentResult": ["CourseworkScore", "ExamScore", "FinalGrade"],
    }
    tables = dict(sound)
    for table, columns in nullable.items():
        start = VALID_ROWS.get(table, VALID)
        extra = [good_row(table, start + i) | dict.fromkeys(columns) for i in (1, 2)]
        tables[table] = sound[table].unionByName(make(table, extra))
    assert set(counts(quality.check_rules(tables)).values()) == {0}


def test_missing_primary_key_is_a_violation(make):
    rows = [good_row("Semester", n) for n in (1, 2)] + [good_row("Semester", 3) | {"SemesterID": None}] * 2
    tables = {"Semester": make("Semester", rows)}
    rule = Rule("Semester", "primary_key", ("SemesterID",))
    assert counts(quality.check_unique(tables, [rule])) == {rule.rule_id: 2}
    assert quality.failing_rows(tables, rule).count() == 2


def test_rules_of_one_table_read_it_once(sound):
    rules = [r for r in contract_rules() if r.table == "Student" and r.kind in quality.ROW_KINDS]
    plan = quality.check_rules(sound, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1


def test_failing_rows_per_kind(make, sound):
    extra = [good_row("Enrollment", 41) | {"StudentID": "nobody"}, good_row("Enrollment", 42) | {"StudentID": "S1"}]
    extra[1]["CourseOfferingID"] = good_row("Enrollment", 1)["CourseOfferingID"]
    tables = sound | {"Enrollment": sound["Enrollment"].unionByName(make("Enrollment", extra))}
    by_id = {r.rule_id: r for r in contract_rules()}
    dangling = quality.failing_rows(tables, by_id["Enrollment.StudentID.foreign_key"])
    assert [r.EnrollmentID for r in dangling.collect()] == [41]
    repeated = quality.failing_rows(tables, by_id["Enrollment.StudentID+CourseOfferingID.unique"])
    assert sorted(r.EnrollmentID for r in repeated.collect()) == [1, 42]


def test_orphans(make, sound):
    bad = make("Enrollment", [good_row("Enrollment", 41) | {"StudentID": "nobody"}])
    tables = sound | {"Enrollment": sound["Enrollment"].unionByName(bad)}
    assert [r.EnrollmentID for r in quality.orphan_enrollments(tables).collect()] == [41]
    assert quality.orphan_results(tables).count() == 0
    short = tables | {"Enrollment": tables["Enrollment"].filter("EnrollmentID > 2")}
    found = quality.orphan_results(short)
    assert found.columns == ["EnrollmentID"] + [c for c in SCHEMAS["AssessmentResult"].names if c != "EnrollmentID"]
    assert sorted(r.EnrollmentID for r in found.collect()) == [1, 2]


def test_row_count_summary(tables):
    got = {r.TableName: r.RowCount for r in quality.row_count_summary(tables).collect()}
    assert "Admission" not in got and len(got) == 11
    assert (got["Student"], got["LMSActivity"], got["Lecturer"]) == (8, 8, 1)


def test_domain_lists_name_real_columns():
    assert all(column in SCHEMAS[table].names for table, column in DOMAINS)
    assert list(PRIMARY_KEYS.values()) == [schema.names[0] for schema in SCHEMAS.values()]


# ---- batches against stored counts ------------------------------------------------------


def test_a_batch_is_judged_without_the_tables(spark, tables, make, tmp_path):
    rules = [r for r in contract_rules() if r.table in ("Student", "Programme", "Enrollment")]
    for name, table in tables.items():
        table.write.parquet(str(tmp_path / "tables" / name))
    stored = {name: spark.read.parquet(str(tmp_path / "tables" / name)) for name in tables}
    counts = KeyCounts.create(spark, stored, rules, str(tmp_path / "counts"), parts=4)
    batch = {
        "Student": make("Student", [{"StudentID": i, "ProgrammeID": p, "Gender": "?"} for i, p in (("S01", 1), ("S90", 99), ("S90", 2), (None, 3))]),
        "Programme": make("Programme", [{"ProgrammeID": 98}, {"ProgrammeID": 1}]),
        "Enrollment": make("Enrollment", [{"EnrollmentID": 1, "StudentID": "S01", "CourseOfferingID": 1}, {"EnrollmentID": 77, "StudentID": "gone", "CourseOfferingID": 9}]),
    }

    def every(*parts):
        return {n: reduce(DataFrame.unionByName, [p[n] for p in (tables, *parts) if n in p]) for n in tables}

    def told(report):
        return sorted((r.RuleID, r.Violations) for r in report.collect())

    report = counts.check(batch)
    assert told(report) == told(check_rules(every(batch), rules))
    assert all("/counts/" in f for f in report.inputFiles())
    assert len(counts.add(batch)) <= 4
    later = {"Student": make("Student", [{"StudentID": "gone", "ProgrammeID": 98}]), "Programme": make("Programme", [{"ProgrammeID": 99}])}
    assert told(counts.check(later)) == told(check_rules(every(batch, later), rules))
    counts.add(later)
    assert told(counts.report()) == told(check_rules(every(batch, later), rules))
    assert told(counts.check({})) == told(counts.report())
