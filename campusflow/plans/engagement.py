"""Learning-platform activity against outcome."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusflow.functions import full_name, largest_first
from campusflow.operators.filters import NO_FILTER, StudentFilter, chosen_ids, students_with_programme, top_students

Tables = Mapping[str, DataFrame]
PAIR = ["StudentID", "CourseOfferingID"]
OUTCOME = ["StudentID", "FullName", "ProgrammeName", "CourseOfferingID", "Events", "Minutes", "FinalGrade"]


def _effort_per_enrollment(tables: Tables, chosen: DataFrame | None = None) -> DataFrame:
    """Events and minutes per student, offering and grade; every enrollment counts.

    Activity is summed per pair before it is joined, so a student with very
    many events arrives as one row per offering.  Summing again after the join
    keeps the SQL meaning where an enrollment has several results: each of
    them counts the pair's activity.  That second sum needs no shuffle of its
    own because the join already placed the pairs together.

    With ``chosen`` students, events and enrollments of others are left out
    before anything is summed, and results meet the chosen enrollments only.
    """
    events, enrollments = tables["LMSActivity"], tables["Enrollment"].select("EnrollmentID", *PAIR)
    if chosen is not None:
        events = events.join(chosen, "StudentID", "left_semi")
        enrollments = enrollments.join(chosen, "StudentID", "left_semi")
    activity = (
        events.groupBy(*PAIR)
        .agg(F.count("ActivityID").alias("events"), F.sum("DurationMinutes").alias("minutes"))
    )
    results = tables["AssessmentResult"].select("EnrollmentID", "FinalGrade")
    offered = tables["CourseOffering"].select("CourseOfferingID")
    enrolled = enrollments.join(offered, "CourseOfferingID", "left_semi").join(results, "EnrollmentID", "left")
    return (
        enrolled.join(activity, PAIR, "left")
        .groupBy(*PAIR, "FinalGrade")
        .agg(
            F.coalesce(F.sum("events"), F.lit(0)).alias("Events"),
            F.coalesce(F.sum("minutes"), F.lit(0)).alias("Minutes"),
        )
    )


def _named(tables: Tables, selection: StudentFilter) -> DataFrame:
    return students_with_programme(tables, selection).select("StudentID", full_name().alias("FullName"), "ProgrammeName")


def engagement_outcome(tables: Tables, selection: StudentFilter = NO_FILTER) -> DataFrame:
    """Activity and grade per enrollment of the selected students, zeros included."""
    students = _named(tables, selection)
    return _effort_per_enrollment(tables, chosen_ids(tables, selection)).join(students, "StudentID").select(*OUTCOME)


def top_engagement(tables: Tables, selection: StudentFilter = NO_FILTER, limit: int = 15) -> DataFrame:
    """The ``limit`` enrollments with the most minutes."""
    effort = _effort_per_enrollment(tables, chosen_ids(tables, selection))
    order = largest_first("Minutes", *PAIR, "FinalGrade")
    return top_students(effort, _named(tables, selection), order, limit).select(*OUTCOME)


def engagement_q3(tables: Tables, limit: int = 100) -> DataFrame:
    """Activity and grade per enrollment of known students, most minutes first."""
    known = tables["Student"].select("StudentID")
    return (
        _effort_per_enrollment(tables)
        .join(known, "StudentID", "left_semi")
        .withColumnsRenamed({"Events": "LMSEvents", "Minutes": "TotalMinutes"})
        .select(*PAIR, "LMSEvents", "TotalMinutes", "FinalGrade")
        .orderBy(*largest_first("TotalMinutes", *PAIR, "FinalGrade"))
        .limit(limit)
    )


def early_warning(
    tables: Tables,
    selection: StudentFilter = NO_FILTER,
    minimum_minutes: int = 60,
    grades: Sequence[str] = ("D", "F"),
) -> DataFrame:
    """Enrollments with much activity and a low grade; both thresholds are the caller's."""
    effort = engagement_outcome(tables, selection)
    return effort.filter(F.col("FinalGrade").isin(list(grades)) & (F.col("Minutes") >= minimum_minutes))


def activity_types(tables: Tables) -> DataFrame:
    """Events per activity type, most frequent first."""
    counts = tables["LMSActivity"].groupBy("ActivityType").agg(F.count("*").alias("n"))
    return counts.orderBy(*largest_first("n", "ActivityType"))
