"""Marks, grades and enrollment listings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusflow.functions import (
    PASS_MARK,
    count_where,
    full_name,
    grade_rank,
    largest_first,
    mean_of,
    rounded_double,
    weighted_mark,
)
from campusflow.operators.filters import NO_FILTER, StudentFilter, chosen_ids, students_with_programme, top_students

Tables = Mapping[str, DataFrame]


def with_course(df: DataFrame, tables: Tables, *columns: str) -> DataFrame:
    """Add columns of the course behind each row's offering.

    Offerings and courses are joined one after the other: each is then judged
    for broadcasting by its own size, where the size of their join would only
    be guessed, and far too large.
    """
    offering = tables["CourseOffering"].select("CourseOfferingID", "CourseID")
    course = tables["Course"].select("CourseID", *columns)
    return df.join(offering, "CourseOfferingID").join(course, "CourseID")


def _results_of_students(tables: Tables, selection: StudentFilter = NO_FILTER) -> DataFrame:
    """Results with their student; those of the selected students where a filter is set."""
    enrollment = tables["Enrollment"].select("EnrollmentID", "StudentID")
    chosen = chosen_ids(tables, selection)
    if chosen is not None:
        enrollment = enrollment.join(chosen, "StudentID", "left_semi")
    return tables["AssessmentResult"].join(enrollment, "EnrollmentID")


def grade_summary(tables: Tables) -> DataFrame:
    """One row per enrollment with student, programme, course, scores and weighted mark."""
    enrollment = tables["Enrollment"].select("EnrollmentID", "StudentID", "CourseOfferingID")
    students = students_with_programme(tables).select(
        "StudentID", full_name().alias("FullName"), "ProgrammeName"
    )
    results = tables["AssessmentResult"].select(
        "EnrollmentID",
        "CourseworkScore",
        "ExamScore",
        F.round(weighted_mark(), 2).cast("decimal(8,2)").alias("WeightedMark"),
        "FinalGrade",
    )
    return (
        with_course(enrollment.join(results, "EnrollmentID", "left"), tables, "CourseCode", "CourseTitle")
        .join(students, "StudentID")
        .select(
            "EnrollmentID",
            "StudentID",
            "FullName",
            "ProgrammeName",
            "CourseCode",
            "CourseTitle",
            "CourseworkScore",
            "ExamScore",
            "WeightedMark",
            "FinalGrade",
        )
    )


def _marks_by_programme(tables: Tables, selection: StudentFilter) -> DataFrame:
    """Mark sums and grade counts per programme name.

    Results are summed per student first: that shuffle is the one the join
    with students needs anyway, and it carries one row per student.
    """
    mark = weighted_mark()
    per_student = (
        _results_of_students(tables, selection)
        .groupBy("StudentID")
        .agg(
            F.sum(mark).alias("mark_sum"),
            F.count(mark).alias("marked"),
            F.count("*").alias("results"),
            count_where(F.col("FinalGrade") == "A").alias("grade_a"),
            count_where(F.col("FinalGrade") == "F").alias("grade_f"),
        )
    )
    students = students_with_programme(tables, selection).select("StudentID", "ProgrammeName")
    return (
        students.join(per_student, "StudentID")
        .groupBy("ProgrammeName")
        .agg(
            mean_of(F.sum("mark_sum"), F.sum("marked")).alias("mark"),
            F.sum("results").alias("Results"),
            F.sum("grade_a").alias("Grade_A"),
            F.sum("grade_f").alias("Grade_F"),
        )
    )


def programme_marks(tables: Tables, selection: StudentFilter = NO_FILTER) -> DataFrame:
    """Average weighted mark and number of results per programme name, best first."""
    marks = _marks_by_programme(tables, selection)
    rounded = marks.select("ProgrammeName", rounded_double(F.col("mark")).alias("AvgMark"), "Results")
    return rounded.orderBy(*largest_first("AvgMark", "ProgrammeName"))


def programme_marks_all(tables: Tables) -> DataFrame:
    """``programme_marks`` over every student, the sample text of the SQL page."""
    return programme_marks(tables)


def programme_performance(tables: Tables) -> DataFrame:
    """Average weighted mark with the number of best and failing grades per programme name.

    Here the mark stays decimal and is rounded half away from zero.
    """
    marks = _marks_by_programme(tables, NO_FILTER)
    mark = F.round("mark", 2).cast("decimal(8,2)").alias("AvgWeightedMark")
    rounded = marks.select("ProgrammeName", "Results", mark, "Grade_A", "Grade_F")
    return rounded.orderBy(*largest_first("AvgWeightedMark", "ProgrammeName"))


def grade_distribution(tables: Tables) -> DataFrame:
    """Results per grade, from best to worst grade; off-scale grades last."""
    counts = tables["AssessmentResult"].groupBy(F.col("FinalGrade").alias("Grade")).agg(
        F.count("*").alias("Count")
    )
    return counts.orderBy(grade_rank("Grade"), F.col("Grade").asc_nulls_last())


def score_scatter(tables: Tables, selection: StudentFilter = NO_FILTER) -> DataFrame:
    """Both scores, grade and programme name of every result of the selected students."""
    students = students_with_programme(tables, selection).select("StudentID", "ProgrammeName")
    return (
        _results_of_students(tables, selection)
        .join(students, "StudentID")
        .select("CourseworkScore", "ExamScore", "FinalGrade", "ProgrammeName")
    )


def grade_quadrants(tables: Tables, selection: StudentFilter = NO_FILTER) -> DataFrame:
    """Results per quadrant of the score chart, split at the pass mark on both axes.

    Results without one of the scores have no place in the chart.
    """
    coursework = F.col("CourseworkScore") >= PASS_MARK
    exam = F.col("ExamScore") >= PASS_MARK
    cases = {
        "both": coursework & exam,
        "coursework only": coursework & ~exam,
        "exam only": ~coursework & exam,
        "neither": ~coursework & ~exam,
    }
    per_student = _results_of_students(tables, selection).groupBy("StudentID").agg(
        *[count_where(test).alias(label) for label, test in cases.items()]
    )
    students = students_with_programme(tables, selection).select("StudentID")
    totals = per_student.join(students, "StudentID").agg(
        *[F.coalesce(F.sum(f"`{label}`"), F.lit(0)).alias(label) for label in cases]
    )
    return totals.unpivot([], list(cases), "Quadrant", "Results")


def credit_load(tables: Tables, limit: int = 100) -> DataFrame:
    """Courses and credit hours per student; the ``limit`` heaviest loads.

    Credit hours are summed per student before students are joined.
    """
    enrollment = tables["Enrollment"].select("EnrollmentID", "StudentID", "CourseOfferingID")
    load = (
        with_course(enrollment, tables, "CreditHours")
        .groupBy("StudentID")
        .agg(
            F.count("EnrollmentID").alias("CoursesTaken"),
            F.sum("CreditHours").alias("TotalCreditHours"),
        )
    )
    students = students_with_programme(tables).select(
        "StudentID", full_name().alias("FullName"), "ProgrammeName"
    )
    top = top_students(load, students, largest_first("TotalCreditHours", "StudentID"), limit)
    return top.select("StudentID", "FullName", "ProgrammeName", "CoursesTaken", "TotalCreditHours")


def student_programme(tables: Tables) -> DataFrame:
    """Every student with the name of their programme."""
    return students_with_programme(tables).select("StudentID", "FirstName", "LastName", "ProgrammeName")


def programme_totals(tables: Tables) -> DataFrame:
    """Students per programme name."""
    counted = tables["Student"].groupBy("ProgrammeID").agg(F.count("StudentID").alias("n"))
    named = tables["Programme"].select("ProgrammeID", "ProgrammeName")
    return counted.join(named, "ProgrammeID").groupBy("ProgrammeName").agg(F.sum("n").alias("TotalStudents"))


def student_courses(tables: Tables) -> DataFrame:
    """Student name and course of every enrollment."""
    students = tables["Student"].select("StudentID", "FirstName", "LastName")
    enrollment = tables["Enrollment"].select("StudentID", "CourseOfferingID")
    return (
        with_course(enrollment, tables, "CourseTitle")
        .join(students, "StudentID")
        .select("FirstName", "LastName", "CourseID", "CourseTitle")
    )


def course_enrolment(tables: Tables) -> DataFrame:
    """Enrollments per course title, most popular first.

    Enrollments are counted per offering before any join, so a course that
    holds a large part of them costs no more than any other.
    """
    counted = tables["Enrollment"].groupBy("CourseOfferingID").agg(F.count("EnrollmentID").alias("n"))
    return (
        with_course(counted, tables, "CourseTitle")
        .groupBy("CourseTitle")
        .agg(F.sum("n").alias("TotalEnrollments"))
        .orderBy(*largest_first("TotalEnrollments", "CourseTitle"))
    )
