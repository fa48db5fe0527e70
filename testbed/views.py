"""The records tables as views over the driver's whole test tables.

One SQL text serves both engines: Spark runs it over the parquet files, DuckDB
inlines it as a common table expression.  ``{name}`` stands for a test table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType

from campusflow.schema import DOMAINS, PRIMARY_KEYS, SCHEMAS, Rule, contract_rules

# Declared types of the test tables, so that no job is spent on inferring them.
SOURCE_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}

VIEWS = {
    "Department": """
        SELECT r_regionkey AS DepartmentID, r_name AS DepartmentName,
               CASE WHEN r_regionkey < 3 THEN 'Science' ELSE 'Arts' END AS Faculty,
               'Block ' || r_regionkey AS OfficeLocation
        FROM {region}""",
    "Programme": """
        SELECT n_nationkey AS ProgrammeID, n_regionkey AS DepartmentID, n_name AS ProgrammeCode,
               n_name AS ProgrammeName,
               CASE n_regionkey WHEN 0 THEN 'BSc' WHEN 1 THEN 'MSc' WHEN 2 THEN 'PhD'
                                WHEN 3 THEN 'Certificate' END AS DegreeType,
               n_nationkey % 6 AS DurationYears
        FROM {nation}""",
    "Course": """
        SELECT p_partkey AS CourseID, p_size % 5 AS DepartmentID, p_brand AS CourseCode,
               p_name AS CourseTitle, 1 + p_size % 7 AS CreditHours
        FROM {part}""",
    "Lecturer": """
        SELECT s_suppkey AS LecturerID, s_nationkey % 5 AS DepartmentID, s_name AS LecturerName,
               CASE WHEN s_acctbal < 0 THEN NULL ELSE 'Lecturer' END AS Rank,
               lower(s_name) || '@example.edu' AS Email
        FROM {supplier}""",
    "Semester": """
        SELECT SemesterID, 'Year ' || SemesterID AS SemesterName,
               make_date(SemesterID, 1, 1) AS StartDate, make_date(SemesterID, 12, 31) AS EndDate
        FROM (SELECT DISTINCT CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS SemesterID FROM {orders}) AS y""",
    "Student": """
        SELECT c_custkey AS StudentID, c_nationkey AS ProgrammeID,
               split_part(c_name, '#', 1) AS FirstName, split_part(c_name, '#', 2) AS LastName,
               CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'Female'
                    ELSE 'Male' END AS Gender,
               lower(c_name) || '@example.edu' AS Email,
               lpad(CAST(c_custkey AS STRING), 10, '0') AS PhoneNumber,
               1998 + c_nationkey AS AdmissionYear, c_mktsegment AS Status
        FROM {customer}""",
    "CourseOffering": """
        SELECT p_partkey AS CourseOfferingID, p_partkey AS CourseID, p_partkey % 12 AS LecturerID,
               CAST(1995 + p_partkey % 7 AS INT) AS SemesterID,
               (1995 + p_partkey % 7) || '/' || (1996 + p_partkey % 7) AS AcademicYear
        FROM {part}""",
    "Enrollment": """
        SELECT MIN(o_orderkey) AS EnrollmentID, o_custkey AS StudentID,
               o_orderkey % 100 AS CourseOfferingID, CAST(MIN(o_orderdate) AS DATE) AS EnrollmentDate,
               MIN(o_orderstatus) AS EnrollmentStatus
        FROM {orders} GROUP BY o_custkey, o_orderkey % 100""",
    "AssessmentResult": """
        SELECT l_orderkey AS ResultID, l_orderkey AS EnrollmentID,
               CASE WHEN l_orderkey % 13 = 5 THEN NULL WHEN l_orderkey % 4 = 1
                    THEN CAST(2 * MIN(l_quantity) AS DECIMAL(5,2))
                    ELSE CAST(2 * MAX(l_quantity) AS DECIMAL(5,2)) END AS CourseworkScore,
               CASE WHEN l_orderkey % 17 = 3 THEN NULL WHEN l_orderkey % 4 = 1
                    THEN CAST(2 * MAX(l_quantity) AS DECIMAL(5,2))
                    ELSE CAST(2 * MIN(l_quantity) AS DECIMAL(5,2)) END AS ExamScore,
               CASE l_orderkey % 9 WHEN 0 THEN 'A' WHEN 1 THEN 'B+' WHEN 2 THEN 'B' WHEN 3 THEN 'C+'
                    WHEN 4 THEN 'C' WHEN 5 THEN 'D+' WHEN 6 THEN 'D' WHEN 7 THEN 'F' ELSE 'I' END AS FinalGrade
        FROM {lineitem} GROUP BY l_orderkey""",
    "FeePayment": """
        SELECT o_orderkey AS PaymentID, o_custkey AS StudentID,
               CAST(o_totalprice AS DECIMAL(10,2)) AS AmountPaid, CAST(o_orderdate AS DATE) AS PaymentDate,
               o_orderpriority AS PaymentMethod,
               CAST(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END AS DECIMAL(10,2)) AS Balance
        FROM {orders}""",
    "LMSActivity": """
        SELECT event_id AS ActivityID, user_id AS StudentID,
               CAST({json}(props, '$.k') AS BIGINT) AS CourseOfferingID, ts AS LoginTimestamp,
               event_type AS ActivityType, CAST(FLOOR(value) AS INT) AS DurationMinutes
        FROM {events}""",
}



def _damaged(name: str) -> str:
    """A view with its own rows, and each seventh row again in three ways: as it is, without
    required values, and with texts too long, references to nothing and values out of range.

    Keys and references have the contract's type here, so texts can be too long.
    """
    view, key = VIEWS[name], PRIMARY_KEYS[name]
    fields = [f for f in SCHEMAS[name] if re.search(rf"\bAS {f.name}\b", view)]
    rules = [r for r in testbed_rules() if r.table == name]
    widths = {r.columns[0]: r.width for r in rules if r.kind == "length"}
    lost = {r.columns[0] for r in rules if r.kind == "foreign_key"}
    beyond = {r.columns[-1] for r in rules if r.kind == "range"}

    def typed(column: str, text: bool) -> str:
        return f"CAST({column} AS STRING)" if text else column

    # Nothing here is a constant, which Spark would take out of a join's condition.
    def wrong(column: str, text: bool) -> str:
        if column in widths:
            return f"repeat('{'y' if column == key else 'x'}', {widths[column]}) || CAST({key} AS STRING)"
        if column == "EndDate":
            return "StartDate"
        if column in lost | beyond:
            return f"-1 - {key}"
        return typed(column, text)

    def missing_value(column: str, text: bool) -> str:
        return typed(f"NULLIF({column}, {column})" if column in required else column, text)

    texts = {f.name: isinstance(f.dataType, StringType) for f in fields}
    required = {f.name for f in fields if not f.nullable} | {key}
    # One scan: each row with the numbers of its versions, of which the first two are the row as it is.
    def version(column: str, text: bool) -> str:
        kept, missing, spoiled = typed(column, text), missing_value(column, text), wrong(column, text)
        if kept == missing == spoiled:
            return f"{kept} AS {column}"
        return f"CASE WHEN _version < 2 THEN {kept} WHEN _version = 2 THEN {missing} ELSE {spoiled} END AS {column}"

    versions = f"{{each}}(CASE WHEN {key} % 7 = 1 THEN {{list}}(0, 1, 2, 3) ELSE {{list}}(0) END) AS _version"
    chosen = ", ".join(version(c, t) for c, t in texts.items())
    return f"SELECT {chosen} FROM (SELECT *, {versions} FROM ({view}) AS v) AS w"


# Names that the two engines give one function.
_SPARK_NAMES = {"json": "get_json_object", "each": "explode", "list": "array"}
_DUCKDB_NAMES = {"json": "json_extract_string", "each": "unnest", "list": "list_value"}

# The test tables hold other words than the contract; one word of each list is
# left out so that the check finds something.
TESTBED_DOMAINS = DOMAINS | {
    ("Student", "Status"): ("FURNITURE", "MACHINERY", "BUILDING", "AUTOMOBILE"),
    ("Enrollment", "EnrollmentStatus"): ("F", "O"),
    ("AssessmentResult", "FinalGrade"): ("A", "B+", "B", "C+", "C", "D+", "D", "F"),
    ("FeePayment", "PaymentMethod"): ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"),
    ("LMSActivity", "ActivityType"): ("signup", "view", "click", "purchase"),
}


def testbed_rules() -> list[Rule]:
    """The contract's rules on the tables that exist here, with the words used here."""
    return [rule for rule in contract_rules(TESTBED_DOMAINS) if rule.table in VIEWS]


def read_source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SOURCE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a SQL text that names test tables as ``{name}``."""
    used = {name: read_source(spark, sf_dir, name) for name in SOURCE_SCHEMAS if f"{{{name}}}" in text}
    for name, function in _SPARK_NAMES.items():
        text = text.replace(f"{{{name}}}", function)
    return spark.sql(text, **used)


class RecordTables(dict):
    """Records tables by name; each is built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        self[name] = run_sql(self.spark, self.sf_dir, VIEWS[name])
        return self[name]

    def damaged(self) -> RecordTables:
        """The same tables with rows that break every rule."""
        return DamagedTables(self.spark, self.sf_dir)

    def load_all(self) -> dict[str, DataFrame]:
        return {name: self[name] for name in VIEWS}


class DamagedTables(RecordTables):
    """Records tables in which every rule of the contract is broken."""

    def __missing__(self, name: str) -> DataFrame:
        self[name] = run_sql(self.spark, self.sf_dir, _damaged(name))
        return self[name]


def oracle(text: str, damaged: bool = False) -> str:
    """The text with the records tables it names put in front as DuckDB expressions."""
    names = [name for name in VIEWS if re.search(rf"\b{name}\b", text)]
    ctes = ", ".join(f"{name} AS ({plain(_damaged(name) if damaged else VIEWS[name])})" for name in names)
    return f"WITH {ctes} SELECT * FROM ({text}) AS answer"


def plain(text: str) -> str:
    """A view text with the placeholders filled in for DuckDB."""
    for name, function in _DUCKDB_NAMES.items():
        text = text.replace(f"{{{name}}}", function)
    return re.sub(r"\{(\w+)\}", r"\1", text)
