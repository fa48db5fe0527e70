"""The cascading student filter and the student search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class StudentFilter:
    """Selected values per filter.

    ``None`` leaves a filter idle.  An empty list selects nothing, so no row
    passes.  A NULL in the data never matches a selection.
    """

    programmes: Sequence[str] | None = None
    statuses: Sequence[str] | None = None
    genders: Sequence[str] | None = None


NO_FILTER = StudentFilter()


def _selected(column: str, values: Sequence[str]) -> Column:
    return F.col(column).isin(list(values)) if values else F.lit(False)


def filter_students(df: DataFrame, selection: StudentFilter = NO_FILTER) -> DataFrame:
    """Keep the rows whose programme, status and gender are all selected."""
    choices = {
        "ProgrammeName": selection.programmes,
        "Status": selection.statuses,
        "Gender": selection.genders,
    }
    for column, values in choices.items():
        if values is not None:
            df = df.filter(_selected(column, values))
    return df


def students_with_programme(
    tables: Mapping[str, DataFrame], selection: StudentFilter = NO_FILTER
) -> DataFrame:
    """Selected students with their ``ProgrammeName``; one row per student.

    The filter is stated above the join; Catalyst moves each part to its scan.
    """
    programme = tables["Programme"].select("ProgrammeID", "ProgrammeName")
    return filter_students(tables["Student"].join(programme, "ProgrammeID"), selection)


def chosen_ids(tables: Mapping[str, DataFrame], selection: StudentFilter) -> DataFrame | None:
    """The ids of the selected students, or None where no filter is set.

    A semi join with them narrows a table of events or enrollments before it is
    summed; Spark chooses the join by the ids' size.
    """
    if selection == NO_FILTER:
        return None
    return students_with_programme(tables, selection).select("StudentID")


def top_students(ranked: DataFrame, names: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """The ``limit`` first rows of known students, and only then their ``names`` (one row per ``StudentID``).

    Ids decide who is known, so no name is read for rows that the limit cuts.
    """
    first = ranked.join(names.select("StudentID"), "StudentID", "left_semi").orderBy(*order).limit(limit)
    return first.join(names, "StudentID").orderBy(*order).limit(limit)


def search_students(
    tables: Mapping[str, DataFrame], text: str = "", selection: StudentFilter = NO_FILTER
) -> DataFrame:
    """Students whose id, name or e-mail contains ``text``, in id order.

    The text is matched literally and without regard to case.
    """
    found = students_with_programme(tables, selection)
    if text:
        # One searchable text per student; the separator keeps fields apart.
        fields = F.concat_ws("\n", "StudentID", F.concat_ws(" ", "FirstName", "LastName"), "Email")
        found = found.filter(F.contains(F.lower(fields), F.lower(F.lit(text))))
    return found.orderBy(F.col("StudentID").asc_nulls_last())
