"""Column expressions shared by the analytics; all run inside whole-stage codegen."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campusflow.schema import GRADE_ORDER

# The institution's weighting and the pass mark of the score chart.
COURSEWORK_WEIGHT = Decimal("0.4")
EXAM_WEIGHT = Decimal("0.6")
PASS_MARK = 50


def weighted_mark(coursework: str = "CourseworkScore", exam: str = "ExamScore") -> Column:
    """Weighted mark in exact decimal arithmetic; NULL when either score is NULL."""
    return F.lit(COURSEWORK_WEIGHT) * F.col(coursework) + F.lit(EXAM_WEIGHT) * F.col(exam)


def full_name(first: str = "FirstName", last: str = "LastName") -> Column:
    """First and last name; NULL when either part is NULL, as ``||`` would give."""
    return F.concat(F.col(first), F.lit(" "), F.col(last))


def grade_rank(grade: str = "FinalGrade") -> Column:
    """1 for the best grade onwards; anything off the scale, NULL too, ranks last."""
    rank = F.when(F.col(grade) == GRADE_ORDER[0], 1)
    for position, name in enumerate(GRADE_ORDER[1:], start=2):
        rank = rank.when(F.col(grade) == name, position)
    return rank.otherwise(len(GRADE_ORDER) + 1)


def count_where(condition: Column) -> Column:
    """How many rows satisfy the condition; 0 on empty input."""
    return F.count(F.when(condition, 1))


def mean_of(total: Column, count: Column) -> Column:
    """A mean from pre-aggregated parts, exact to many decimals; NULL over nothing."""
    return total / F.nullif(count, F.lit(0))


def rounded_double(value: Column) -> Column:
    """The value as a double, rounded to two decimals in binary arithmetic.

    Spark's ``round`` works on the printed form of a double, so 39.425 would
    become 39.43 although the stored number is below the half.
    """
    return F.round(value.cast("double") * 100) / 100


def largest_first(value: str, *ties: str) -> list[Column]:
    """Sort columns: the value downwards, then the tie-breakers upwards; NULL always last."""
    return [F.col(value).desc_nulls_last(), *[F.col(tie).asc_nulls_last() for tie in ties]]


def share_of_total(grouped: DataFrame, count: str, name: str = "Share") -> DataFrame:
    """Add each group's share of the overall count.

    The total is a scalar subquery over the grouped rows, so no window pulls
    all groups into one task.
    """
    total = grouped.agg(F.sum(count).cast("double")).scalar()
    return grouped.withColumn(name, F.col(count).cast("double") / total)
