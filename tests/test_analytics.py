"""Named analytics on the invented records."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from campusflow.functions import grade_rank, weighted_mark
from campusflow.operators.filters import StudentFilter, filter_students, search_students, students_with_programme
from campusflow.plans import engagement, finance, marks, overview

ALL_GENDERS = StudentFilter(genders=["Female", "Male", "Other"])


def D(text):
    return Decimal(text)


def ids(df):
    return sorted(r.StudentID for r in df.collect())


# ---- filter ---------------------------------------------------------------------


def test_missing_gender_never_matches_a_selection(tables):
    assert "S05" not in ids(students_with_programme(tables, ALL_GENDERS))
    assert "S05" in ids(students_with_programme(tables))


def test_missing_status_never_matches_a_selection(tables):
    chosen = StudentFilter(statuses=["Active", "Graduated", "Withdrawn", "Suspended"])
    assert "S06" not in ids(students_with_programme(tables, chosen))


def test_empty_selection_is_nothing_and_no_selection_is_everything(tables):
    for part in ("programmes", "statuses", "genders"):
        assert ids(students_with_programme(tables, StudentFilter(**{part: []}))) == []
    assert len(ids(students_with_programme(tables, StudentFilter()))) == 8


def test_quote_in_a_programme_name(tables):
    assert ids(students_with_programme(tables, StudentFilter(programmes=["Ma'at Studies"]))) == ["S01", "S02", "S08"]


def test_filters_combine(tables):
    chosen = StudentFilter(programmes=["Tidal Maps"], statuses=["Active"], genders=["Female", "Male"])
    assert ids(filter_students(students_with_programme(tables), chosen)) == ["S04"]


def test_search_matches_id_name_and_email_literally(tables):
    assert ids(search_students(tables, "s03")) == ["S03"]
    assert ids(search_students(tables, "ben o'd")) == ["S02"]
    assert ids(search_students(tables, "%")) == []
    assert ids(search_students(tables, "vance")) == ["S08"]  # no first name
    assert ids(search_students(tables, "@EXAMPLE", StudentFilter(statuses=["Graduated"]))) == ["S03"]
    assert [r.StudentID for r in search_students(tables).collect()] == [f"S0{n}" for n in range(1, 9)]


# ---- student mix ------------------------------------------------------------------


def test_filter_values_are_sorted_and_genders_leave_out_missing(tables, rows):
    values = overview.filter_values(tables)
    assert rows(values["ProgrammeName"]) == [("Glass Blowing",), ("Ma'at Studies",), ("Tidal Maps",)]
    assert rows(values["Gender"]) == [("Female",), ("Male",), ("Other",)]
    assert rows(values["Status"])[-1] == (None,)


def test_students_per_programme_merges_one_name(tables, rows):
    assert rows(overview.students_per_programme(tables)) == [
        ("Ma'at Studies", 3),
        ("Tidal Maps", 3),
        ("Glass Blowing", 2),
    ]


def test_student_without_enrollment_counts_as_student(tables, rows):
    assert ("Glass Blowing", 2) in rows(marks.programme_totals(tables), "ProgrammeName", "TotalStudents")


def test_gender_split_and_shares(tables, rows):
    assert rows(overview.gender_split(tables, ALL_GENDERS)) == [("Female", 3), ("Male", 3), ("Other", 1)]
    shares = rows(overview.gender_share(tables, ALL_GENDERS), "Gender", "Share")
    assert abs(sum(s for _, s in shares) - 1) < 1e-12 and abs(dict(shares)["Other"] - 1 / 7) < 1e-12


def test_status_distribution(tables, rows):
    assert rows(overview.status_distribution(tables)) == [
        ("Active", 5),
        ("Graduated", 1),
        ("Withdrawn", 1),
        (None, 1),
    ]


def test_programme_gender_long_and_wide(tables, rows):
    long = set(rows(overview.programme_gender(tables, ALL_GENDERS)))
    assert long == {
        ("Ma'at Studies", "Female", 2),
        ("Ma'at Studies", "Male", 1),
        ("Glass Blowing", "Male", 2),
        ("Tidal Maps", "Female", 1),
        ("Tidal Maps", "Other", 1),
    }
    wide = rows(overview.programme_gender_wide(tables, ALL_GENDERS), "ProgrammeName", "Male", "Female", "Other")
    assert set(wide) == {("Ma'at Studies", 1, 2, 0), ("Glass Blowing", 2, 0, 0), ("Tidal Maps", 0, 1, 1)}


def test_kpi_scopes(tables):
    row = overview.kpi_row(tables, StudentFilter(genders=["Female"])).collect()[0]
    assert (row.students, row.enrollments) == (3, 4)
    assert (row.results, row.lms_events, row.outstanding) == (7, 8, D("700.01"))
    none = overview.kpi_row(tables, StudentFilter(genders=[])).collect()[0]
    assert (none.students, none.enrollments, none.results) == (0, 0, 7)


def test_kpi_of_empty_tables(tables):
    empty = {name: df.limit(0) for name, df in tables.items()}
    row = overview.kpi_row(empty).collect()[0]
    assert tuple(row) == (0, 0, 0, None, D("0.00"), 0)


# ---- marks ----------------------------------------------------------------------------


def test_weighted_mark_is_exact_and_missing_score_has_none(tables, rows):
    got = dict(rows(tables["AssessmentResult"].select("ResultID", weighted_mark())))
    assert got[1] == D("50.006") and got[2] is None


def test_rounding_half_away_from_zero(spark):
    df = spark.sql("SELECT CAST(71.125 AS DECIMAL(8,3)) AS a, CAST(2.675 AS DECIMAL(8,3)) AS b")
    assert tuple(df.select(F.round("a", 2), F.round("b", 2)).collect()[0]) == (D("71.13"), D("2.68"))


def test_programme_marks(tables, rows):
    # Ma'at Studies has three results but two marks, 50.006 and 50.00.
    assert rows(marks.programme_marks(tables)) == [
        ("Glass Blowing", 58.0, 1),
        ("Tidal Maps", 51.1, 3),
        ("Ma'at Studies", 50.0, 3),
    ]


def test_average_skips_missing_marks_but_counts_results(tables, rows):
    only = StudentFilter(programmes=["Ma'at Studies"], genders=["Male"])
    assert rows(marks.programme_marks(tables, only)) == [("Ma'at Studies", None, 1)]


def test_programme_performance(tables, rows):
    got = {r[0]: r[1:] for r in rows(marks.programme_performance(tables))}
    assert got["Ma'at Studies"] == (3, D("50.00"), 1, 0)
    assert got["Tidal Maps"] == (3, D("51.10"), 0, 1)


def test_grade_summary_keeps_enrollments_without_result(tables, rows):
    got = {r.EnrollmentID: r for r in marks.grade_summary(tables).collect()}
    assert len(got) == 8
    assert got[2].FinalGrade is None and got[2].WeightedMark is None
    assert got[1].WeightedMark == D("50.01") and got[1].FullName == "Ada Quist"
    assert got[8].FullName is None  # a missing part makes the whole name missing


def test_enrollment_without_result_is_no_result(tables):
    assert marks.score_scatter(tables).count() == 7


def test_grade_distribution_order(tables, rows):
    got = rows(marks.grade_distribution(tables))
    assert [g for g, _ in got] == ["A", "B", "D", "F", "I", "Z", None]


def test_grade_rank_of_off_scale_values(spark, rows):
    df = spark.createDataFrame([("A",), ("F",), ("I",), (None,), ("a",)], "FinalGrade string")
    assert [r[0] for r in rows(df.select(grade_rank()))] == [1, 8, 9, 9, 9]


def test_grade_quadrants(tables, rows):
    # S01 and S08 sit on the line, which counts as passed; the result with a missing score is left out.
    assert dict(rows(marks.grade_quadrants(tables))) == {
        "both": 3,
        "coursework only": 1,
        "exam only": 1,
        "neither": 1,
    }


def test_credit_load(tables, rows):
    got = rows(marks.credit_load(tables), "StudentID", "CoursesTaken", "TotalCreditHours")
    assert got == [
        ("S01", 2, 5),
        ("S02", 1, 3),
        ("S04", 1, 3),
        ("S05", 1, 3),
        ("S03", 1, 2),
        ("S06", 1, 2),
        ("S08", 1, None),
    ]
    assert rows(marks.credit_load(tables, limit=2), "StudentID") == [("S01",), ("S02",)]


def test_course_enrolment_merges_titles(tables, rows):
    assert rows(marks.course_enrolment(tables)) == [("Kilns", 5), ("Tides", 3)]


def test_student_listings(tables, rows):
    assert marks.student_programme(tables).count() == 8
    assert ("Ada", "Quist", 2, "Tides") in rows(marks.student_courses(tables))


# ---- engagement ---------------------------------------------------------------------


def test_engagement_is_anchored_on_enrollment(tables, rows):
    got = {
        (r.StudentID, r.CourseOfferingID): (r.Events, r.Minutes, r.FinalGrade)
        for r in engagement.engagement_outcome(tables).collect()
    }
    assert got == {
        ("S01", 1): (2, 45, "A"),
        ("S01", 2): (0, 0, None),
        ("S02", 1): (1, 0, "I"),
        ("S03", 2): (0, 0, "B"),
        ("S04", 1): (1, 60, "F"),
        ("S05", 1): (0, 0, None),
        ("S06", 2): (0, 0, "Z"),
        ("S08", 3): (1, 61, "D"),
    }


def test_activity_outside_enrollments_still_counts_as_activity(tables, rows):
    assert rows(engagement.activity_types(tables)) == [("Login", 5), ("Forum", 2), ("PageView", 1)]


def test_repeated_results_fan_out_like_sql(tables, make, rows):
    extra = make("AssessmentResult", [(8, 1, None, None, "A"), (9, 1, None, None, "B")])
    doubled = tables | {"AssessmentResult": tables["AssessmentResult"].unionByName(extra)}
    got = engagement.engagement_outcome(doubled).filter("StudentID = 'S01' AND CourseOfferingID = 1")
    assert set(rows(got, "Events", "Minutes", "FinalGrade")) == {(4, 90, "A"), (2, 45, "B")}


def test_top_engagement_breaks_ties_by_key(tables, make, rows):
    pairs = [(100 + n, f"S{n % 2 + 1:02d}", 10 + n // 2) for n in range(16)]
    day = tables["Enrollment"].first().EnrollmentDate
    stamp = tables["LMSActivity"].first().LoginTimestamp
    tied = tables | {
        "CourseOffering": make("CourseOffering", [(n, 1, "L1", 1, "x") for n in range(10, 18)]),
        "Enrollment": make("Enrollment", [(i, s, o, day, "Active") for i, s, o in pairs]),
        "LMSActivity": make("LMSActivity", [(i, s, o, stamp, "Login", 20) for i, s, o in pairs]),
    }
    got = rows(engagement.top_engagement(tied), "StudentID", "CourseOfferingID", "Minutes")
    expected = sorted((s, o, 20) for _, s, o in pairs)[:15]
    assert got == expected


def test_engagement_q3_and_early_warning(tables, rows):
    top = rows(engagement.engagement_q3(tables, limit=3), "StudentID", "TotalMinutes")
    assert top == [("S08", 61), ("S04", 60), ("S01", 45)]
    assert ids(engagement.early_warning(tables)) == ["S04", "S08"]
    assert ids(engagement.early_warning(tables, minimum_minutes=61)) == ["S08"]
    assert ids(engagement.early_warning(tables, grades=["A"], minimum_minutes=45)) == ["S01"]


# ---- finance ------------------------------------------------------------------------


def test_two_meanings_of_outstanding(tables, rows):
    work = rows(finance.outstanding_worklist(tables), "StudentID", "Paid", "Outstanding")
    assert work == [("S01", D("150.50"), D("700.00")), ("S05", D("2.00"), D("0.01"))]
    assert rows(finance.outstanding_q4(tables), "StudentID", "OutstandingBalance") == [
        ("S01", D("700.00")),
        ("S05", D("0.01")),
    ]
    largest = dict(rows(finance.outstanding_max(tables), "StudentID", "OutstandingBalance"))
    assert largest == {"S01": D("500.00"), "S02": D("300.00"), "S05": D("0.01")}


def test_worklist_follows_the_filter(tables):
    assert ids(finance.outstanding_worklist(tables, ALL_GENDERS)) == ["S01"]


def test_payments(tables, rows):
    assert rows(finance.payment_methods(tables)) == [
        (None, 1, D("999.99")),
        ("Card", 3, D("111.00")),
        ("Bank", 2, D("52.50")),
        ("Cash", 1, D("10.00")),
    ]
    assert sorted(rows(finance.payment_totals(tables)), key=str) == sorted(
        [(None, 1, D("999.99")), ("Card", 3, D("111.00")), ("Bank", 2, D("52.50")), ("Cash", 1, D("10.00"))], key=str
    )
    assert rows(finance.total_revenue(tables)) == [(D("1173.49"),)]
