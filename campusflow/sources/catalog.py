"""Temporary views over the tables, table browsing, read-only SQL and export."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campusflow.plans.marks import grade_summary
from campusflow.sources.load import CSV_OPTIONS

GRADE_SUMMARY_VIEW = "v_student_grade_summary"

# Spark accepts these inside a SELECT, but they run code outside the query:
# reflective calls and scripts.  The analysed plan, as JSON, names their classes;
# a text that spells such a name has its quotes escaped there.
_RUNS_CODE = re.compile(r'"class":"[\w.$]*\.(CallMethodViaReflection|TryReflect|ScriptTransformation)"')

# IDENTIFIER evaluates its argument while a text is analysed, so it may hold
# one literal only.  Texts, quoted names and comments are blanked out first.
_QUOTED = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/""", re.DOTALL)
_BUILT_NAME = re.compile(r"\bidentifier\s*\(\s*[^\s)]", re.IGNORECASE)

# A semicolon with only blanks, semicolons and comments after it.
_ENDING = re.compile(r";(\s|;|--[^\n]*(\n|$)|/\*.*?\*/)*\Z", re.DOTALL)


def register_tables(spark: SparkSession, tables: Mapping[str, DataFrame]) -> None:
    """Make every table, and the grade summary over them, queryable by name."""
    for name in tables:
        tables[name].createOrReplaceTempView(name)
    if {"Enrollment", "Student", "Programme", "CourseOffering", "Course", "AssessmentResult"} <= set(tables):
        grade_summary(tables).createOrReplaceTempView(GRADE_SUMMARY_VIEW)


def scan_table(tables: Mapping[str, DataFrame], name: str) -> DataFrame:
    """All columns and rows of a table, named in any case."""
    names = {known.lower(): known for known in tables}
    return tables[names[name.lower()]]


def table_shape(df: DataFrame) -> DataFrame:
    """One row: how many rows and columns there are."""
    return df.agg(F.count("*").alias("Rows")).withColumn("Columns", F.lit(len(df.columns)))


def adhoc_sql(spark: SparkSession, text: str) -> DataFrame:
    """Run one read-only query over the registered tables.

    The text must work as a subquery, so anything but a single SELECT is a
    parse error before anything runs.  What its analysed plan would run outside
    the query is refused.  Files cannot be named as tables: the session must have
    ``spark.sql.runSQLOnFiles`` off, as ``session.tuned`` and ``session.tune`` set it.
    """
    if spark.conf.get("spark.sql.runSQLOnFiles").lower() != "false":
        raise ValueError("set spark.sql.runSQLOnFiles to false")
    if _BUILT_NAME.search(_QUOTED.sub(" ", text)):
        raise ValueError("names cannot be built by expressions")
    try:
        answer = spark.sql(_as_subquery(text.strip().rstrip(";")))
    except ParseException:
        # A comment may follow the final semicolon.
        ending = _ENDING.search(text)
        if ending is None:
            raise
        answer = spark.sql(_as_subquery(text[: ending.start()]))
    if _RUNS_CODE.search(answer._jdf.queryExecution().analyzed().toJSON()):
        raise ValueError("only plain SELECT queries are allowed")
    return answer


def _as_subquery(query: str) -> str:
    return f"SELECT * FROM (\n{query}\n)"


def export_csv(df: DataFrame, directory: str) -> None:
    """Write CSV files with a header into a new directory, in parallel.

    Values come back as they were: quotes are doubled, blanks at the ends and
    line breaks stay, an empty text is written as ``""`` and NULL as nothing.
    """
    df.write.options(**CSV_OPTIONS, emptyValue='""').mode("errorifexists").csv(directory)


def write_snapshot(df: DataFrame, directory: str) -> None:
    """Write a table to a new directory; the snapshot being read stays as it is."""
    df.write.mode("errorifexists").parquet(directory)
