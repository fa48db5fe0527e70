"""Student mix, filter values and the headline figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusflow.functions import largest_first, mean_of, rounded_double, share_of_total, weighted_mark
from campusflow.operators.filters import NO_FILTER, StudentFilter, filter_students, students_with_programme
from campusflow.schema import GENDERS

Tables = Mapping[str, DataFrame]


def filter_values(tables: Tables) -> dict[str, DataFrame]:
    """The choices each filter offers, sorted: programme names, statuses, genders."""
    student = tables["Student"]
    choices = {
        "ProgrammeName": tables["Programme"],
        "Status": student,
        "Gender": student.filter(F.col("Gender").isNotNull()),
    }
    return {
        column: df.select(column).distinct().orderBy(F.col(column).asc_nulls_last())
        for column, df in choices.items()
    }


def _count_students(tables: Tables, selection: StudentFilter, *keys: str) -> DataFrame:
    """Selected students counted per key.

    Students are counted per programme id before the join, so the join sees
    one row per programme and key value however many students there are.
    """
    of_student = [k for k in keys if k != "ProgrammeName"]
    chosen = filter_students(
        tables["Student"], StudentFilter(statuses=selection.statuses, genders=selection.genders)
    )
    counted = chosen.groupBy("ProgrammeID", *of_student).agg(F.count("*").alias("n"))
    named = filter_students(
        tables["Programme"].select("ProgrammeID", "ProgrammeName"),
        StudentFilter(programmes=selection.programmes),
    )
    return counted.join(named, "ProgrammeID").groupBy(*keys).agg(F.sum("n").alias("n"))


def _ranked(counts: DataFrame, key: str, name: str) -> DataFrame:
    return counts.withColumnRenamed("n", name).orderBy(*largest_first(name, key))


def students_per_programme(tables: Tables, selection: StudentFilter = NO_FILTER) -> DataFrame:
    """Students by programme name, largest first; programmes of one name are one group."""
    return _ranked(_count_students(tables, selection, "ProgrammeName"), "ProgrammeName", "Students")


def gender_split(tables: Tables, selection: StudentFilter = NO_FILTER) -> DataFrame:
    """Students by gender, largest first."""
    return _ranked(_count_students(tables, selection, "Gender"), "Gender", "Students")


def gender_share(tables: Tables, selection: StudentFilter = NO_FILTER) -> DataFrame:
    """``gender_split`` with each gender's share of all counted students."""
    counts = _count_students(tables, selection, "Gender").withColumnRenamed("n", "Students")
    return share_of_total(counts, "Students").orderBy(*largest_first("Students", "Gender"))


def status_distribution(tables: Tables, selection: StudentFilter = NO_FILTER) -> DataFrame:
    """Students by status, largest first."""
    return _ranked(_count_students(tables, selection, "Status"), "Status", "Students")


def programme_gender(tables: Tables, selection: StudentFilter = NO_FILTER) -> DataFrame:
    """Students by programme name and gender."""
    return _count_students(tables, selection, "ProgrammeName", "Gender")


def programme_gender_wide(
    tables: Tables, selection: StudentFilter = NO_FILTER, genders: Sequence[str] = GENDERS
) -> DataFrame:
    """One row per programme name, one column per gender, 0 where there is none."""
    counts = programme_gender(tables, selection)
    wide = counts.groupBy("ProgrammeName").pivot("Gender", list(genders)).agg(F.sum("n"))
    return wide.na.fill(0, list(genders))


def kpi_row(tables: Tables, selection: StudentFilter = NO_FILTER) -> DataFrame:
    """Six headline figures in one row.

    The filter reaches students and enrollments only; results, mark, balance
    and events are overall figures.  Each part is a scalar subquery.
    """
    per_student = tables["Enrollment"].groupBy("StudentID").agg(F.count("*").alias("n"))
    selected = students_with_programme(tables, selection).select("StudentID")
    people = selected.join(per_student, "StudentID", "left").agg(
        F.struct(F.count("*").alias("students"), F.coalesce(F.sum("n"), F.lit(0)).alias("enrollments"))
    )
    mark = weighted_mark()
    marks = tables["AssessmentResult"].agg(
        F.struct(
            F.count("*").alias("results"),
            rounded_double(mean_of(F.sum(mark), F.count(mark))).alias("avg_mark"),
        )
    )
    owed = tables["FeePayment"].agg(F.coalesce(F.sum("Balance"), F.lit(0)))
    events = tables["LMSActivity"].agg(F.count("*"))
    one_row = tables["Student"].sparkSession.range(1)
    return one_row.select(
        people.scalar().alias("people"),
        marks.scalar().alias("marks"),
        owed.scalar().alias("outstanding"),
        events.scalar().alias("lms_events"),
    ).select(
        "people.students",
        "people.enrollments",
        "marks.results",
        "marks.avg_mark",
        F.col("outstanding").cast("decimal(20,2)").alias("outstanding"),
        "lms_events",
    )
