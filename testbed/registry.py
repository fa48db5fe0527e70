"""Every checked query: the Spark call and, next to it, the DuckDB text it must equal."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from campusflow import functions as columns
from campusflow.operators import keycounts, keys, maintained, quality, updates
from campusflow.operators.filters import StudentFilter, filter_students, search_students, students_with_programme
from campusflow.plans import engagement, finance, marks, overview
from campusflow.schema import BROWSED_TABLES, GRADE_ORDER, PRIMARY_KEYS, SCHEMAS, Rule, contract_rules
from campusflow.sources import catalog, footers, load, partitions
from campusflow.sources.first_load import first_load
from testbed.views import VIEWS, RecordTables, oracle, plain, read_source, run_sql, testbed_rules

Query = Callable[[RecordTables], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TEXTS: dict[str, str] = {}  # the texts before the views are put in


def _add(name: str, query: Query, text: str) -> None:
    QUERIES[name] = query
    TEXTS[name] = text
    ORACLES[name] = oracle(text)


# The state the filters start in: every value of each list.  It drops students
# without a gender, whom no list offers.
EVERYONE = StudentFilter(genders=["Female", "Male"])
# A partial choice on all three lists.
CHOSEN = StudentFilter(
    programmes=["NATION_1", "NATION_4", "NATION_8", "NATION_16", "NATION_23", "no such programme"],
    statuses=["BUILDING", "MACHINERY", "FURNITURE"],
    genders=["Female"],
)
_EVERYONE = "Gender IN ('Female', 'Male')"
_CHOSEN = (
    "ProgrammeName IN ('NATION_1', 'NATION_4', 'NATION_8', 'NATION_16', 'NATION_23') "
    "AND Status IN ('BUILDING', 'MACHINERY', 'FURNITURE') AND Gender = 'Female'"
)
_MARK = "CourseworkScore * 0.4 + ExamScore * 0.6"


def _people(where: str = "TRUE") -> str:
    return f"(SELECT * FROM Student JOIN Programme USING (ProgrammeID) WHERE {where}) AS people"


def _effort(who: str, columns: str) -> str:
    """Activity per enrollment, straight from the unaggregated join."""
    return f"""
        SELECT StudentID, {columns} en.CourseOfferingID, COUNT(act.ActivityID) AS Events,
               CAST(COALESCE(SUM(act.DurationMinutes), 0) AS BIGINT) AS Minutes, res.FinalGrade
        FROM {who}
        JOIN Enrollment AS en USING (StudentID)
        JOIN CourseOffering AS off ON off.CourseOfferingID = en.CourseOfferingID
        LEFT JOIN LMSActivity AS act
               ON (act.StudentID, act.CourseOfferingID) = (en.StudentID, en.CourseOfferingID)
        LEFT JOIN AssessmentResult AS res ON res.EnrollmentID = en.EnrollmentID
        GROUP BY ALL"""


_NAMED = "FirstName || ' ' || LastName AS FullName, ProgrammeName,"
_EFFORT_OF_EVERYONE = _effort(_people(_EVERYONE), _NAMED)
_EFFORT_OF_CHOSEN = _effort(_people(_CHOSEN), _NAMED)


# ---- student mix ---------------------------------------------------------------

_add(
    "filter_values",
    lambda t: reduce(
        DataFrame.unionByName,
        [
            df.select(F.lit(name).alias("FilterName"), F.col(name).alias("Value"))
            for name, df in overview.filter_values(t).items()
        ],
    ),
    """SELECT 'ProgrammeName' AS FilterName, ProgrammeName AS Value FROM Programme
       UNION SELECT 'Status', Status FROM Student
       UNION SELECT 'Gender', Gender FROM Student WHERE Gender IS NOT NULL""",
)
def _kpi(where: str) -> str:
    return f"""
        SELECT chosen.students, chosen.enrollments, marked.results, ROUND(CAST(marked.mean AS DOUBLE), 2) AS avg_mark,
               owed.outstanding, logged.lms_events
        FROM (SELECT COUNT(DISTINCT StudentID) AS students, COUNT(EnrollmentID) AS enrollments
              FROM {_people(where)} LEFT JOIN Enrollment USING (StudentID)) AS chosen,
             (SELECT COUNT(*) AS results, AVG({_MARK}) AS mean FROM AssessmentResult) AS marked,
             (SELECT CAST(COALESCE(SUM(Balance), 0) AS DECIMAL(20,2)) AS outstanding FROM FeePayment) AS owed,
             (SELECT COUNT(*) AS lms_events FROM LMSActivity) AS logged"""


_add("kpi_row", lambda t: overview.kpi_row(t, EVERYONE), _kpi(_EVERYONE))
_add("kpi_row_chosen", lambda t: overview.kpi_row(t, CHOSEN), _kpi(_CHOSEN))


def _counts(keys_: str, name: str) -> str:
    return f"SELECT {keys_}, COUNT(*) AS {name} FROM {_people(_EVERYONE)} GROUP BY {keys_}"


_add(
    "students_per_programme",
    lambda t: overview.students_per_programme(t, EVERYONE),
    _counts("ProgrammeName", "Students"),
)
_add("gender_split", lambda t: overview.gender_split(t, EVERYONE), _counts("Gender", "Students"))
_add(
    "share_of_total",
    lambda t: overview.gender_share(t, EVERYONE),
    f"""SELECT Gender, Students, CAST(Students AS DOUBLE) / CAST(SUM(Students) OVER () AS DOUBLE) AS Share
        FROM ({_counts("Gender", "Students")}) AS g""",
)
_add("status_distribution", lambda t: overview.status_distribution(t, EVERYONE), _counts("Status", "Students"))
_add("programme_gender", lambda t: overview.programme_gender(t, EVERYONE), _counts("ProgrammeName, Gender", "n"))
_add(
    "programme_gender_wide",
    lambda t: overview.programme_gender_wide(t, EVERYONE),
    f"""SELECT ProgrammeName, COUNT(*) FILTER (Gender = 'Male') AS Male,
               COUNT(*) FILTER (Gender = 'Female') AS Female, COUNT(*) FILTER (Gender = 'Other') AS Other
        FROM {_people(_EVERYONE)} GROUP BY ProgrammeName""",
)
_add(
    "filter_students",
    lambda t: filter_students(students_with_programme(t), CHOSEN).select(
        "StudentID", "ProgrammeName", "Status", "Gender"
    ),
    f"SELECT StudentID, ProgrammeName, Status, Gender FROM {_people(_CHOSEN)}",
)
_add(
    "search_students",
    lambda t: search_students(t, "OMER#00000000", EVERYONE).select("StudentID", "LastName", "Email", "ProgrammeName"),
    f"""SELECT StudentID, LastName, Email, ProgrammeName FROM {_people(_EVERYONE)}
        WHERE concat_ws('|', StudentID, FirstName || ' ' || LastName, Email) ILIKE '%omer#00000000%'""",
)
_add(
    "student_programme",
    marks.student_programme,
    f"SELECT StudentID, FirstName, LastName, ProgrammeName FROM {_people()}",
)
_add(
    "programme_totals",
    marks.programme_totals,
    f"SELECT ProgrammeName, COUNT(StudentID) AS TotalStudents FROM {_people()} GROUP BY ProgrammeName",
)

# ---- marks and enrollments ---------------------------------------------------------

_GRADE_SUMMARY = f"""
    SELECT EnrollmentID, StudentID, FirstName || ' ' || LastName AS FullName, ProgrammeName, CourseCode,
           CourseTitle, CourseworkScore, ExamScore,
           CAST(ROUND({_MARK}, 2) AS DECIMAL(8,2)) AS WeightedMark, FinalGrade
    FROM Enrollment JOIN {_people()} USING (StudentID)
    JOIN CourseOffering USING (CourseOfferingID) JOIN Course USING (CourseID)
    LEFT JOIN AssessmentResult USING (EnrollmentID)"""


def _grade_summary_view(t: RecordTables) -> DataFrame:
    catalog.register_tables(t.spark, t.load_all())
    return catalog.scan_table({catalog.GRADE_SUMMARY_VIEW: t.spark.table(catalog.GRADE_SUMMARY_VIEW)},
                              "V_Student_Grade_Summary")


_add("grade_summary", marks.grade_summary, _GRADE_SUMMARY)
_add("grade_summary_view", _grade_summary_view, _GRADE_SUMMARY)


def _programme_marks(where: str) -> str:
    return f"""
        SELECT ProgrammeName, ROUND(CAST(AVG({_MARK}) AS DOUBLE), 2) AS AvgMark, COUNT(*) AS Results
        FROM AssessmentResult JOIN Enrollment USING (EnrollmentID) JOIN {_people(where)} USING (StudentID)
        GROUP BY ProgrammeName"""


_add("programme_marks", lambda t: marks.programme_marks(t, EVERYONE), _programme_marks(_EVERYONE))
_add("programme_marks_chosen", lambda t: marks.programme_marks(t, CHOSEN), _programme_marks(_CHOSEN))
_add("programme_marks_all", marks.programme_marks_all, _programme_marks("TRUE"))
# Rounding in whole thousandths, because DuckDB divides decimals as doubles.
_add(
    "programme_performance",
    marks.programme_performance,
    f"""SELECT ProgrammeName, Results,
               CAST(CAST((2 * thousandths + 10 * marked) // (20 * marked) AS DECIMAL(18,2)) / 100
                    AS DECIMAL(8,2)) AS AvgWeightedMark, Grade_A, Grade_F
        FROM (SELECT ProgrammeName, COUNT(*) AS Results, COUNT({_MARK}) AS marked,
                     CAST(SUM(1000 * ({_MARK})) AS BIGINT) AS thousandths,
                     COUNT(*) FILTER (FinalGrade = 'A') AS Grade_A, COUNT(*) FILTER (FinalGrade = 'F') AS Grade_F
              FROM AssessmentResult JOIN Enrollment USING (EnrollmentID) JOIN {_people()} USING (StudentID)
              GROUP BY ProgrammeName) AS m""",
)
_add(
    "grade_distribution",
    marks.grade_distribution,
    "SELECT FinalGrade AS Grade, COUNT(*) AS Count FROM AssessmentResult GROUP BY FinalGrade",
)
_add(
    "grade_ranks",
    lambda t: t["AssessmentResult"].select("ResultID", "FinalGrade", columns.grade_rank().alias("GradeRank")),
    f"""SELECT ResultID, FinalGrade,
               COALESCE(list_position({list(GRADE_ORDER)}, FinalGrade), {len(GRADE_ORDER) + 1}) AS GradeRank
        FROM AssessmentResult""",
)
def _scatter(where: str) -> str:
    return f"""
        SELECT CourseworkScore, ExamScore, FinalGrade, ProgrammeName
        FROM {_people(where)} JOIN Enrollment USING (StudentID) JOIN AssessmentResult USING (EnrollmentID)"""


_add("score_scatter", lambda t: marks.score_scatter(t, EVERYONE), _scatter(_EVERYONE))
_add("score_scatter_chosen", lambda t: marks.score_scatter(t, CHOSEN), _scatter(_CHOSEN))


def _quadrants(where: str) -> str:
    return f"""
        SELECT Quadrant, COUNT(placed) AS Results
        FROM (VALUES ('both'), ('coursework only'), ('exam only'), ('neither')) AS q(Quadrant)
        LEFT JOIN (SELECT CASE WHEN CourseworkScore >= 50 AND ExamScore >= 50 THEN 'both'
                               WHEN CourseworkScore >= 50 THEN 'coursework only'
                               WHEN ExamScore >= 50 THEN 'exam only' ELSE 'neither' END AS placed
                   FROM ({_scatter(where)}) AS s
                   WHERE CourseworkScore IS NOT NULL AND ExamScore IS NOT NULL) AS p ON placed = Quadrant
        GROUP BY Quadrant"""


_add("grade_quadrants", lambda t: marks.grade_quadrants(t, EVERYONE), _quadrants(_EVERYONE))
_add("grade_quadrants_chosen", lambda t: marks.grade_quadrants(t, CHOSEN), _quadrants(_CHOSEN))
_add(
    "credit_load",
    marks.credit_load,
    f"""SELECT StudentID, FirstName || ' ' || LastName AS FullName, ProgrammeName,
               COUNT(EnrollmentID) AS CoursesTaken, CAST(SUM(CreditHours) AS BIGINT) AS TotalCreditHours
        FROM Enrollment JOIN CourseOffering USING (CourseOfferingID) JOIN Course USING (CourseID)
        JOIN {_people()} USING (StudentID)
        GROUP BY ALL ORDER BY TotalCreditHours DESC NULLS LAST, StudentID LIMIT 100""",
)
_add(
    "student_courses",
    marks.student_courses,
    """SELECT FirstName, LastName, CourseID, CourseTitle
       FROM Course JOIN CourseOffering USING (CourseID) JOIN Enrollment USING (CourseOfferingID)
       JOIN Student USING (StudentID)""",
)
_add(
    "course_enrolment",
    marks.course_enrolment,
    """SELECT CourseTitle, COUNT(EnrollmentID) AS TotalEnrollments
       FROM Course JOIN CourseOffering USING (CourseID) JOIN Enrollment USING (CourseOfferingID)
       GROUP BY CourseTitle""",
)

# ---- engagement --------------------------------------------------------------------

_add("engagement_outcome", lambda t: engagement.engagement_outcome(t, EVERYONE), _EFFORT_OF_EVERYONE)
_add("engagement_outcome_chosen", lambda t: engagement.engagement_outcome(t, CHOSEN), _EFFORT_OF_CHOSEN)
_TOP = "ORDER BY Minutes DESC, StudentID, CourseOfferingID, FinalGrade NULLS LAST LIMIT 15"
_add(
    "top_engagement",
    lambda t: engagement.top_engagement(t, EVERYONE),
    f"SELECT * FROM ({_EFFORT_OF_EVERYONE}) AS e {_TOP}",
)
_add(
    "top_engagement_chosen",
    lambda t: engagement.top_engagement(t, CHOSEN),
    f"SELECT * FROM ({_EFFORT_OF_CHOSEN}) AS e {_TOP}",
)
_add(
    "engagement_q3",
    engagement.engagement_q3,
    f"""SELECT StudentID, CourseOfferingID, Events AS LMSEvents, Minutes AS TotalMinutes, FinalGrade
        FROM ({_effort('Student', '')}) AS e
        ORDER BY TotalMinutes DESC, StudentID, CourseOfferingID, FinalGrade NULLS LAST LIMIT 100""",
)
_add(
    "early_warning",
    lambda t: engagement.early_warning(t, EVERYONE, minimum_minutes=10),
    f"SELECT * FROM ({_EFFORT_OF_EVERYONE}) AS e WHERE Minutes >= 10 AND FinalGrade IN ('D', 'F')",
)
_add(
    "activity_types",
    engagement.activity_types,
    "SELECT ActivityType, COUNT(*) AS n FROM LMSActivity GROUP BY ActivityType",
)

# ---- finance -----------------------------------------------------------------------


def _money(expression: str) -> str:
    return f"CAST({expression} AS DECIMAL(20,2))"


def _payments(count: str, total: str) -> str:
    return f"""SELECT PaymentMethod, COUNT(*) AS {count}, {_money("SUM(AmountPaid)")} AS {total}
               FROM FeePayment GROUP BY PaymentMethod"""


def _debts(names: str, who: str, paid: str, owed: str) -> str:
    return f"""SELECT StudentID, {names}, {_money("SUM(AmountPaid)")} AS {paid},
                      {_money("SUM(Balance)")} AS {owed}
               FROM FeePayment JOIN {who} USING (StudentID)
               GROUP BY ALL HAVING SUM(Balance) > 0"""


_add("payment_methods", finance.payment_methods, _payments("Payments", "Total"))
_add("payment_totals", finance.payment_totals, _payments("TotalTransactions", "TotalAmount"))
_add(
    "outstanding_worklist",
    lambda t: finance.outstanding_worklist(t, EVERYONE),
    _debts("FirstName || ' ' || LastName AS FullName, ProgrammeName", _people(_EVERYONE), "Paid", "Outstanding"),
)
_add(
    "outstanding_worklist_chosen",
    lambda t: finance.outstanding_worklist(t, CHOSEN),
    _debts("FirstName || ' ' || LastName AS FullName, ProgrammeName", _people(_CHOSEN), "Paid", "Outstanding"),
)
_add(
    "outstanding_q4",
    finance.outstanding_q4,
    _debts("FirstName || ' ' || LastName AS FullName", "Student", "TotalPaid", "OutstandingBalance")
    + " ORDER BY OutstandingBalance DESC, StudentID LIMIT 100",
)
_add(
    "outstanding_max",
    finance.outstanding_max,
    f"""SELECT StudentID, {_money("SUM(AmountPaid)")} AS TotalPaid, MAX(Balance) AS OutstandingBalance
        FROM FeePayment GROUP BY StudentID HAVING MAX(Balance) > 0""",
)
_add("total_revenue", finance.total_revenue, f"SELECT {_money('SUM(AmountPaid)')} AS TotalRevenue FROM FeePayment")

# ---- data quality ------------------------------------------------------------------


def _rule_oracle(rule: Rule) -> str:
    key, first = ", ".join(rule.columns), rule.columns[0]
    some_null = " OR ".join(f"{c} IS NULL" for c in rule.columns)
    repeats = (
        f"(SELECT COUNT(*) FROM {rule.table} WHERE NOT ({some_null}))"
        f" - (SELECT COUNT(*) FROM (SELECT DISTINCT {key} FROM {rule.table} WHERE NOT ({some_null})) AS d)"
    )
    words = ", ".join(f"'{word}'" for word in rule.allowed)

    def rows(condition: str) -> str:
        return f"(SELECT COUNT(*) FROM {rule.table} WHERE {condition})"

    counted = {
        "not_null": lambda: rows(f"{first} IS NULL"),
        "domain": lambda: rows(f"{first} NOT IN ({words})"),
        "range": lambda: rows(f"NOT ({rule.condition})"),
        "length": lambda: rows(f"LENGTH(CAST({first} AS VARCHAR)) > {rule.width}"),
        "unique": lambda: repeats,
        "primary_key": lambda: f"{repeats} + {rows(some_null)}",
        "foreign_key": lambda: rows(
            f"{first} IS NOT NULL AND {first} NOT IN "
            f"(SELECT {rule.parent_key} FROM {rule.parent} WHERE {rule.parent_key} IS NOT NULL)"
        ),
    }[rule.kind]()
    return (
        f"SELECT '{rule.rule_id}' AS RuleID, '{rule.table}' AS TableName, '{rule.kind}' AS Kind, "
        f"'{'+'.join(rule.columns)}' AS Columns, CAST({counted} AS BIGINT) AS Violations"
    )


def _add_damaged(name: str, query: Query, text: str) -> None:
    """A query over tables in which every rule is broken."""
    QUERIES[name] = lambda t: query(t.damaged())
    TEXTS[name] = text
    ORACLES[name] = oracle(text, damaged=True)


def _add_rules(name: str, check: Callable[..., DataFrame], *kinds: str) -> None:
    rules = [r for r in testbed_rules() if r.kind in kinds]
    _add_damaged(name, lambda t: check(t, rules), " UNION ALL ".join(map(_rule_oracle, rules)))


_add_rules("check_not_null", quality.check_not_null, "not_null")
_add_rules("check_unique", quality.check_unique, "primary_key", "unique")
_add_rules("check_foreign_key", quality.check_foreign_key, "foreign_key")
_add_rules("check_domain", quality.check_domain, "domain")
_add_rules("check_range", quality.check_range, "range")
_add_rules("check_length", quality.check_length, "length")
_add(
    "failing_rows",
    lambda t: quality.failing_rows(t, Rule("Course", "unique", ("CourseCode",))),
    """SELECT * FROM Course WHERE CourseCode IN
       (SELECT CourseCode FROM Course GROUP BY CourseCode HAVING COUNT(*) > 1)""",
)
_add_damaged(
    "orphan_enrollments",
    quality.orphan_enrollments,
    """SELECT en.* FROM Enrollment AS en
       WHERE NOT EXISTS (SELECT 1 FROM Student AS st WHERE st.StudentID = en.StudentID)""",
)
_add_damaged(
    "orphan_results",
    quality.orphan_results,
    """SELECT res.* FROM AssessmentResult AS res
       WHERE NOT EXISTS (SELECT 1 FROM Enrollment AS en WHERE en.EnrollmentID = res.EnrollmentID)""",
)
_add(
    "row_count_summary",
    quality.row_count_summary,
    " UNION ALL ".join(f"SELECT '{name}' AS TableName, COUNT(*) AS RowCount FROM {name}" for name in BROWSED_TABLES),
)

# ---- sources, keys, ad-hoc SQL -------------------------------------------------------


def _load_tables(t: RecordTables) -> DataFrame:
    """Read test tables with declared types through the loader."""
    names = ["nation", "customer", "orders"]
    schemas = {name: read_source(t.spark, t.sf_dir, name).schema for name in names}
    loaded = load.load_tables(t.spark, t.sf_dir, names=names, schemas=schemas)
    people = loaded["customer"].join(loaded["nation"], F.expr("c_nationkey = n_nationkey"))
    return (
        people.join(loaded["orders"], F.expr("o_custkey = c_custkey"))
        .groupBy("n_name")
        .agg(F.count("*").alias("Orders"), F.max("o_orderdate").cast("date").alias("LastOrder"))
    )


QUERIES["load_tables"] = _load_tables
ORACLES["load_tables"] = """
    SELECT n_name, COUNT(*) AS Orders, CAST(MAX(o_orderdate) AS DATE) AS LastOrder
    FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY n_name"""


# Payments with notes that CSV must not change: blanks, quotes, commas, line breaks, empty texts and NULL.
_NOTED = """
    SELECT PaymentID, StudentID, AmountPaid, PaymentDate, PaymentMethod, Balance,
           CASE PaymentID % 7 WHEN 0 THEN ' both ends ' WHEN 1 THEN 'a "quoted" word, and a comma'
                WHEN 2 THEN 'two' || chr(10) || 'lines' WHEN 3 THEN '' WHEN 4 THEN 'back\\slash"'
                WHEN 5 THEN PaymentMethod || '"' END AS Note
    FROM ({payments}) AS p"""


def _shared_folder(t: RecordTables) -> str:
    """A new folder that all executors can write to."""
    shared = t.spark.conf.get("spark.checkpoint.dir", None) or t.spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared}/export-{uuid4()}"


def _export_and_read(t: RecordTables) -> DataFrame:
    """Noted payments written as CSV into the shared folder and read back with their types."""
    text = _NOTED.replace("{payments}", VIEWS["FeePayment"]).replace("back\\slash", "back\\\\slash")
    payments = run_sql(t.spark, t.sf_dir, text)
    folder = _shared_folder(t)
    catalog.export_csv(payments, f"{folder}/FeePayment.csv")
    loaded = load.load_tables(t.spark, folder, "csv", ["FeePayment"], schemas={"FeePayment": payments.schema})
    return loaded["FeePayment"]


QUERIES["export_csv"] = _export_and_read
ORACLES["export_csv"] = plain(_NOTED.replace("{payments}", VIEWS["FeePayment"]))


FIRST_LOADED = ("Department", "Programme", "Course", "Lecturer", "Semester", "FeePayment")


def _first_load(t: RecordTables) -> DataFrame:
    """Operational files of six tables, with rows that break the contract, loaded and reported on."""
    tables, folder = t.damaged(), _shared_folder(t)
    for name in FIRST_LOADED:
        typed = tables[name].select(*[F.col(f.name).cast(f.dataType) for f in SCHEMAS[name]])
        catalog.export_csv(typed, f"{folder}/{name}.csv")
    return first_load(t.spark, folder, f"{folder}-loaded", "csv", FIRST_LOADED)


QUERIES["first_load"] = _first_load
ORACLES["first_load"] = oracle(
    " UNION ALL ".join(
        _rule_oracle(r)
        for r in contract_rules()
        if r.table in FIRST_LOADED and (not r.parent or r.parent in FIRST_LOADED)
    ),
    damaged=True,
)


def _payments_per_term(t: RecordTables) -> DataFrame:
    """Payments per term of a calendar that is written down as rows with ISO dates."""
    calendar = load.load_literals(t.spark, _TERMS, SCHEMAS["Semester"])
    dated = t["FeePayment"].join(calendar, F.expr("year(PaymentDate) = SemesterID"))
    return (
        dated.filter("PaymentDate BETWEEN StartDate AND EndDate")
        .groupBy("SemesterName", "StartDate", "EndDate")
        .agg(F.count("*").alias("Payments"))
    )


_TERMS = [(year, f"Spring {year}", f"{year}-02-01", f"{year}-06-30") for year in range(1995, 2002)]
_add(
    "load_literal_dates",
    _payments_per_term,
    "SELECT SemesterName, StartDate, EndDate, COUNT(*) AS Payments FROM FeePayment JOIN (VALUES "
    + ", ".join(f"({y}, '{name}', DATE '{a}', DATE '{b}')" for y, name, a, b in _TERMS)
    + ") AS c(SemesterID, SemesterName, StartDate, EndDate) ON PaymentDate BETWEEN StartDate AND EndDate GROUP BY ALL",
)
_add(
    "apply_default_dates",
    lambda t: load.apply_defaults(t["Enrollment"].drop("EnrollmentDate"), "Enrollment"),
    "SELECT EnrollmentID, StudentID, CourseOfferingID, EnrollmentStatus, CURRENT_DATE AS EnrollmentDate FROM Enrollment",
)


def _grade_scale(t: RecordTables) -> DataFrame:
    """Results per step of a grade scale that is written down as literal rows."""
    schema = StructType().add("GradeRank", IntegerType()).add("FinalGrade", StringType())
    scale = load.load_literals(t.spark, enumerate(GRADE_ORDER, start=1), schema)
    counts = t["AssessmentResult"].groupBy("FinalGrade").agg(F.count("*").alias("Results"))
    return scale.join(counts, "FinalGrade", "left")


_add(
    "load_literals",
    _grade_scale,
    "SELECT GradeRank, FinalGrade, COUNT(ResultID) AS Results FROM (VALUES "
    + ", ".join(f"({rank}, '{grade}')" for rank, grade in enumerate(GRADE_ORDER, start=1))
    + ") AS scale(GradeRank, FinalGrade) LEFT JOIN AssessmentResult USING (FinalGrade) GROUP BY ALL",
)
_add(
    "assign_serial",
    lambda t: keys.assign_serial(
        t["FeePayment"].select("PaymentID", "StudentID", "PaymentDate"), "SerialNo", ["PaymentDate", "PaymentID"]
    ),
    """SELECT ROW_NUMBER() OVER (ORDER BY PaymentDate, PaymentID) AS SerialNo, PaymentID, StudentID, PaymentDate
       FROM FeePayment""",
)
_add(
    "next_key",
    lambda t: keys.next_key(t["Enrollment"], "EnrollmentID"),
    "SELECT MAX(EnrollmentID) + 1 AS NextKey FROM Enrollment",
)
_add(
    "apply_defaults",
    lambda t: load.apply_defaults(t["Student"].drop("Status"), "Student").select("StudentID", "Gender", "Status"),
    "SELECT StudentID, Gender, 'Active' AS Status FROM Student",
)
_add("scan_table", lambda t: catalog.scan_table(t.load_all(), "student"), "SELECT * FROM Student")
_add(
    "table_shape",
    lambda t: catalog.table_shape(t["LMSActivity"]),
    "SELECT COUNT(*) AS Rows, 6 AS Columns FROM LMSActivity",
)
_add(
    "canonical_columns",
    lambda t: load.canonical_columns(
        t["FeePayment"].select("PAYMENTID", "studentid", "amountpaid", F.lit(1).alias("own_Name"))
    ),
    "SELECT PaymentID, StudentID, AmountPaid, 1 AS own_Name FROM FeePayment",
)


def _adhoc(t: RecordTables) -> DataFrame:
    catalog.register_tables(t.spark, t.load_all())
    return catalog.adhoc_sql(
        t.spark,
        """-- marks per programme and course
        WITH mark AS (SELECT EnrollmentID, 0.4 * CourseworkScore + 0.6 * ExamScore AS m FROM assessmentresult)
        SELECT programmename AS ProgrammeName, c.coursetitle AS CourseTitle, COUNT(*) AS Results,
               SUM(m)::DECIMAL(20,3) AS TotalMark
        FROM mark JOIN enrollment USING (enrollmentid) JOIN student s USING (studentid)
        JOIN programme USING (programmeid) JOIN courseoffering USING (courseofferingid)
        JOIN course c USING (courseid)
        GROUP BY ALL ORDER BY TotalMark DESC;""",
    )


_add(
    "adhoc_sql",
    _adhoc,
    f"""SELECT ProgrammeName, CourseTitle, COUNT(*) AS Results, CAST(SUM({_MARK}) AS DECIMAL(20,3)) AS TotalMark
        FROM AssessmentResult JOIN Enrollment USING (EnrollmentID) JOIN {_people()} USING (StudentID)
        JOIN CourseOffering USING (CourseOfferingID) JOIN Course USING (CourseID)
        GROUP BY ProgrammeName, CourseTitle""",
)

# ---- batch changes -------------------------------------------------------------------

# Ids in the text form new ids continue: the admission year and a running number.
_TEXT_IDS = """
    SELECT 'UG' || (2000 + c_nationkey) || lpad(CAST(c_custkey AS STRING), 7, '0') AS StudentID,
           c_nationkey AS ProgrammeID, split_part(c_name, '#', 1) AS FirstName,
           split_part(c_name, '#', 2) AS LastName, 'Other' AS Gender,
           CASE WHEN c_acctbal < 0 THEN 'supplier' ELSE 'customer' END || substr(c_name, 9) AS Email,
           2000 + c_nationkey AS AdmissionYear, c_mktsegment AS Status
    FROM {customer}"""
# New students: every supplier, some with an e-mail that is taken or repeated,
# some with a wrong gender or programme.
_APPLICANTS = """
    SELECT s_suppkey AS Place, CASE WHEN s_nationkey = 7 THEN 70 ELSE s_nationkey END AS ProgrammeID,
           split_part(s_name, '#', 1) AS FirstName, split_part(s_name, '#', 2) AS LastName,
           CASE WHEN s_nationkey = 11 THEN 'unknown' ELSE 'Other' END AS Gender,
           CASE WHEN s_acctbal < 5000 THEN lower(s_name) WHEN s_acctbal < 7000 THEN 'shared@example.edu'
           END AS Email,
           2000 + s_nationkey AS AdmissionYear
    FROM {supplier}"""
_UPDATES = """
    SELECT o_orderkey AS Place, 3 * o_custkey AS StudentID,
           CASE o_orderstatus WHEN 'F' THEN 'BUILDING' WHEN 'O' THEN 'no such status' END AS Status,
           CASE o_orderpriority WHEN '1-URGENT' THEN 12 WHEN '2-HIGH' THEN 99 END AS ProgrammeID
    FROM {orders}"""
# Every activity asks for an enrollment of its student in its offering.
_REQUESTS = """
    SELECT event_id AS Place, CASE event_type WHEN 'error' THEN -1 - user_id ELSE user_id END AS StudentID,
           CAST({json}(props, '$.k') AS BIGINT) AS CourseOfferingID, CAST(ts AS DATE) AS EnrollmentDate,
           CASE event_type WHEN 'signup' THEN 'O' WHEN 'click' THEN 'bad' ELSE 'F' END AS EnrollmentStatus
    FROM {events}"""


def _append(t: RecordTables) -> updates.Change:
    tables = {"Student": run_sql(t.spark, t.sf_dir, _TEXT_IDS), "Programme": t["Programme"]}
    return updates.append_students(tables, run_sql(t.spark, t.sf_dir, _APPLICANTS), ["Place"], _APPEND_RULES)


def _update(t: RecordTables) -> updates.Change:
    return updates.update_students(t, run_sql(t.spark, t.sf_dir, _UPDATES), ["Place"], testbed_rules())


def _enrol(t: RecordTables) -> updates.Change:
    return updates.enrol_students(t, run_sql(t.spark, t.sf_dir, _REQUESTS), ["Place"], testbed_rules())


def _refused(df: DataFrame) -> DataFrame:
    return df.select("Place", "Reasons")


_APPEND_RULES = [r for r in testbed_rules() if r.columns != ("Status",)]

_JUDGED_APPLICANTS = f"""
    present AS ({plain(_TEXT_IDS)}),
    judged AS (
        SELECT *, CASE WHEN Gender = 'unknown' THEN 'Student.Gender.domain,' ELSE '' END
                  || CASE WHEN ProgrammeID = 70 THEN 'Student.ProgrammeID.foreign_key,' ELSE '' END AS wrong
        FROM ({plain(_APPLICANTS)}) AS a),
    placed AS (
        SELECT *, wrong || CASE WHEN wrong = '' AND Email IS NOT NULL AND
                  (Email IN (SELECT Email FROM present)
                   OR ROW_NUMBER() OVER (PARTITION BY Email, wrong = '' ORDER BY Place) > 1)
                  THEN 'Student.Email.unique,' ELSE '' END AS Reasons
        FROM judged)"""
_LAST_NUMBER = """
    COALESCE((SELECT MAX(CAST(substr(p.StudentID, 7) AS BIGINT)) FROM present AS p
              WHERE p.AdmissionYear = placed.AdmissionYear), 0)"""


def _add_with(name: str, query: Query, ctes: str, text: str) -> None:
    QUERIES[name] = query
    ORACLES[name] = f"WITH {ctes} {text}"


_WITH_APPLICANTS = f"""SELECT * FROM present UNION ALL BY NAME
        SELECT 'UG' || AdmissionYear ||
               CASE WHEN number < 1000 THEN lpad(CAST(number AS VARCHAR), 3, '0') ELSE CAST(number AS VARCHAR) END
               AS StudentID, ProgrammeID, FirstName, LastName, Gender, Email, AdmissionYear, 'Active' AS Status
        FROM (SELECT *, {_LAST_NUMBER} + ROW_NUMBER() OVER (PARTITION BY AdmissionYear ORDER BY Place) AS number
              FROM placed WHERE Reasons = '') AS numbered"""
_add_with("append_students", lambda t: _append(t).table, _JUDGED_APPLICANTS, _WITH_APPLICANTS)
_add_with(
    "append_students_refused",
    lambda t: _refused(_append(t).rejected),
    _JUDGED_APPLICANTS,
    "SELECT Place, rtrim(Reasons, ',') AS Reasons FROM placed WHERE Reasons <> ''",
)

_JUDGED_UPDATES = f"""
    Student AS ({plain(VIEWS["Student"])}),
    judged AS (
        SELECT *, CASE WHEN Status = 'no such status' THEN 'Student.Status.domain,' ELSE '' END
                  || CASE WHEN StudentID NOT IN (SELECT StudentID FROM Student)
                          THEN 'Update.StudentID.foreign_key,' ELSE '' END
                  || CASE WHEN ProgrammeID = 99 THEN 'Student.ProgrammeID.foreign_key,' ELSE '' END AS Reasons
        FROM ({plain(_UPDATES)}) AS u)"""
_WITH_UPDATES = """SELECT st.* REPLACE (
            COALESCE((SELECT arg_max(j.ProgrammeID, j.Place) FROM judged AS j
                      WHERE j.StudentID = st.StudentID AND j.Reasons = '' AND j.ProgrammeID IS NOT NULL),
                     st.ProgrammeID) AS ProgrammeID,
            COALESCE((SELECT arg_max(j.Status, j.Place) FROM judged AS j
                      WHERE j.StudentID = st.StudentID AND j.Reasons = '' AND j.Status IS NOT NULL),
                     st.Status) AS Status)
       FROM Student AS st"""
_add_with("update_students", lambda t: _update(t).table, _JUDGED_UPDATES, _WITH_UPDATES)
_add_with(
    "update_students_refused",
    lambda t: _refused(_update(t).rejected),
    _JUDGED_UPDATES,
    "SELECT Place, rtrim(Reasons, ',') AS Reasons FROM judged WHERE Reasons <> ''",
)

_JUDGED_REQUESTS = f"""
    Enrollment AS ({plain(VIEWS["Enrollment"])}),
    judged AS (
        SELECT *, CASE WHEN EnrollmentStatus = 'bad' THEN 'Enrollment.EnrollmentStatus.domain,' ELSE '' END
                  || CASE WHEN StudentID < 0 THEN 'Enrollment.StudentID.foreign_key,' ELSE '' END AS wrong
        FROM ({plain(_REQUESTS)}) AS r),
    placed AS (
        SELECT j.*, wrong || CASE WHEN wrong = '' AND
                  (EXISTS (SELECT 1 FROM Enrollment AS en WHERE en.StudentID = j.StudentID
                                                            AND en.CourseOfferingID = j.CourseOfferingID)
                   OR ROW_NUMBER() OVER (PARTITION BY StudentID, CourseOfferingID, wrong = '' ORDER BY Place) > 1)
                  THEN 'Enrollment.StudentID+CourseOfferingID.unique,' ELSE '' END AS Reasons
        FROM judged AS j)"""
_WITH_REQUESTS = """SELECT * FROM Enrollment UNION ALL BY NAME
       SELECT (SELECT MAX(EnrollmentID) FROM Enrollment) + ROW_NUMBER() OVER (ORDER BY Place) AS EnrollmentID,
              StudentID, CourseOfferingID, EnrollmentDate, EnrollmentStatus
       FROM placed WHERE Reasons = ''"""
_add_with("enrol_students", lambda t: _enrol(t).table, _JUDGED_REQUESTS, _WITH_REQUESTS)
_add_with(
    "enrol_students_refused",
    lambda t: _refused(_enrol(t).rejected),
    _JUDGED_REQUESTS,
    "SELECT Place, rtrim(Reasons, ',') AS Reasons FROM placed WHERE Reasons <> ''",
)

# ---- figures kept up to date ---------------------------------------------------------------


def _states(t: RecordTables, tables: dict[str, DataFrame]) -> maintained.StoredStates:
    """The stored states of some tables, in a new shared folder."""
    return maintained.StoredStates.create(t.spark, maintained.summarise(tables), _shared_folder(t), parts=8)


def _after_append(t: RecordTables) -> DataFrame:
    """The cube after new students came, merged from their rows alone."""
    none = {name: t[name].limit(0) for name in ("Enrollment", "AssessmentResult", "FeePayment", "LMSActivity")}
    none["Enrollment"] = none["Enrollment"].withColumn("StudentID", F.col("StudentID").cast("string"))
    states = _states(t, none | {"Student": run_sql(t.spark, t.sf_dir, _TEXT_IDS)})
    states.put(maintained.appended(states, _append(t).accepted))
    return states["cube"].drop("MarkSum")


def _after_update(t: RecordTables) -> DataFrame:
    """The cube after students changed status and programme, with all that they carry along."""
    states = _states(t, t)
    changed = _update(t).accepted
    states.put(maintained.updated(states.naming(changed), changed))
    return states["cube"].withColumn("MarkSum", F.col("MarkSum").cast("decimal(20,3)"))


def _enrolled(t: RecordTables) -> maintained.StoredStates:
    states = _states(t, t)
    accepted = _enrol(t).accepted
    states.put(maintained.enrolled(states.naming(accepted), accepted))
    return states


def _rewritten(t: RecordTables) -> DataFrame:
    """Students stored in partitions, of which an update rewrote those that it touched."""
    folder = _shared_folder(t)
    partitions.save_partitioned(t["Student"], folder, "StudentID", 8)
    partitions.rewrite_changed(t.spark, folder, _update(t).accepted, "StudentID", 8)
    return partitions.read_partitioned(t.spark, folder)


def _views(*names: str) -> str:
    return ", ".join(f"{name} AS ({plain(VIEWS[name])})" for name in names)


_CUBE = f"""
    SELECT ProgrammeID, Status, Gender, COUNT(*) AS Students, CAST(SUM(COALESCE(e.n, 0)) AS BIGINT) AS Enrollments,
           CAST(SUM(COALESCE(r.n, 0)) AS BIGINT) AS Results, CAST(SUM(COALESCE(r.marked, 0)) AS BIGINT) AS Marked,
           CAST(SUM(COALESCE(r.a, 0)) AS BIGINT) AS GradeA, CAST(SUM(COALESCE(r.f, 0)) AS BIGINT) AS GradeF,
           CAST(SUM(COALESCE(r.mark, 0)) AS DECIMAL(20,3)) AS MarkSum
    FROM changed AS s
    LEFT JOIN (SELECT StudentID, COUNT(*) AS n FROM Enrollment GROUP BY StudentID) AS e ON e.StudentID = s.StudentID
    LEFT JOIN (SELECT StudentID, COUNT(*) AS n, COUNT({_MARK}) AS marked, SUM({_MARK}) AS mark,
                      SUM(CASE FinalGrade WHEN 'A' THEN 1 ELSE 0 END) AS a, SUM(CASE FinalGrade WHEN 'F' THEN 1 ELSE 0 END) AS f
               FROM AssessmentResult JOIN Enrollment USING (EnrollmentID) GROUP BY StudentID) AS r ON r.StudentID = s.StudentID
    GROUP BY ProgrammeID, Status, Gender"""
_add_with(
    "maintained_after_append",
    _after_append,
    f"{_JUDGED_APPLICANTS}, changed AS ({_WITH_APPLICANTS})",
    """SELECT ProgrammeID, Status, Gender, COUNT(*) AS Students, 0::BIGINT AS Enrollments, 0::BIGINT AS Results,
              0::BIGINT AS Marked, 0::BIGINT AS GradeA, 0::BIGINT AS GradeF FROM changed GROUP BY ALL""",
)
_add_with(
    "maintained_after_update",
    _after_update,
    f"{_JUDGED_UPDATES}, changed AS ({_WITH_UPDATES}), {_views('Enrollment', 'AssessmentResult')}",
    _CUBE,
)
_ENROLLED = f"{_JUDGED_REQUESTS}, enrolled AS ({_WITH_REQUESTS})"
_add_with(
    "maintained_kpi_after_enrol",
    lambda t: maintained.kpi_row(_enrolled(t), t["Programme"], CHOSEN),
    f"{_ENROLLED}, {_views('Student', 'Programme', 'AssessmentResult', 'FeePayment', 'LMSActivity')}",
    f"""SELECT (SELECT COUNT(*) FROM {_people(_CHOSEN)}) AS students,
               (SELECT COUNT(*) FROM enrolled JOIN {_people(_CHOSEN)} USING (StudentID)) AS enrollments,
               (SELECT COUNT(*) FROM AssessmentResult) AS results,
               (SELECT ROUND(CAST(SUM({_MARK}) AS DOUBLE) / COUNT({_MARK}) * 100) / 100 FROM AssessmentResult) AS avg_mark,
               (SELECT CAST(COALESCE(SUM(Balance), 0) AS DECIMAL(20,2)) FROM FeePayment) AS outstanding,
               (SELECT COUNT(*) FROM LMSActivity) AS lms_events""",
)
_add_with(
    "maintained_courses_after_enrol",
    lambda t: maintained.course_enrolment(_enrolled(t), t),
    f"{_ENROLLED}, {_views('CourseOffering', 'Course')}",
    """SELECT CourseTitle, COUNT(EnrollmentID) AS TotalEnrollments FROM enrolled
       JOIN CourseOffering USING (CourseOfferingID) JOIN Course USING (CourseID) GROUP BY CourseTitle""",
)
_add_with("rewritten_students", _rewritten, _JUDGED_UPDATES, _WITH_UPDATES)

# ---- batches checked against stored counts ---------------------------------------------------

# New rows that repeat keys, refer to nothing, and bring a programme that others already refer to.
_COMING = {
    "Programme": "SELECT 70 + n_nationkey AS ProgrammeID, n_regionkey AS DepartmentID, n_name AS ProgrammeCode, "
    "n_name || ' again' AS ProgrammeName, 'BSc' AS DegreeType, 0 AS DurationYears FROM {nation} WHERE n_nationkey < 3",
    "Student": """
        SELECT CASE WHEN s_suppkey % 9 > 0 THEN 100 * s_suppkey END AS StudentID, 60 + s_suppkey % 20 AS ProgrammeID,
               s_name AS FirstName, CASE WHEN s_suppkey % 4 > 0 THEN s_name END AS LastName, 'unknown' AS Gender,
               CASE WHEN s_suppkey % 2 = 0 THEN 'shared@example.edu' END AS Email, '1' AS PhoneNumber,
               1800 + s_nationkey AS AdmissionYear, 'BUILDING' AS Status
        FROM {supplier}""",
    "Enrollment": """
        SELECT event_id AS EnrollmentID, CASE event_type WHEN 'error' THEN NULL ELSE 2 * user_id END AS StudentID,
               CAST({json}(props, '$.k') AS BIGINT) AS CourseOfferingID, CAST(ts AS DATE) AS EnrollmentDate,
               'F' AS EnrollmentStatus
        FROM {events}""",
}
_COUNTED = ("Department", "Programme", "Student", "CourseOffering", "Enrollment", "AssessmentResult")
_COUNTED_RULES = [r for r in testbed_rules() if r.table in _COUNTED and (not r.parent or r.parent in _COUNTED)]


def _key_counts(t: RecordTables) -> tuple[keycounts.KeyCounts, dict[str, DataFrame]]:
    # As the parents lack a programme that rows refer to, the batch can bring it.
    tables = {name: t[name] for name in _COUNTED}
    tables["Programme"] = tables["Programme"].filter("ProgrammeID <> 4")
    coming = {name: run_sql(t.spark, t.sf_dir, text) for name, text in _COMING.items()}
    coming["Programme"] = coming["Programme"].withColumn("ProgrammeID", F.expr("IF(ProgrammeID = 72, 4, ProgrammeID)"))
    return keycounts.KeyCounts.create(t.spark, tables, _COUNTED_RULES, _shared_folder(t), parts=8), coming


def _checked_batch(t: RecordTables) -> DataFrame:
    """The report over tables and batch, from stored counts."""
    counts, coming = _key_counts(t)
    return counts.check(coming)


def _counted_batches(t: RecordTables) -> DataFrame:
    """The same when the batch comes in two parts, each counted in."""
    counts, coming = _key_counts(t)
    counts.add({name: coming[name] for name in ("Student", "Enrollment")})
    counts.add({"Programme": coming["Programme"]})
    return counts.report()


_ALL_ROWS = {name: plain(VIEWS[name]) for name in _COUNTED}
_ALL_ROWS["Programme"] = f"SELECT * FROM ({_ALL_ROWS['Programme']}) AS p WHERE ProgrammeID <> 4"
_ALL_ROWS |= {name: f"{_ALL_ROWS[name]} UNION ALL BY NAME {plain(text)}" for name, text in _COMING.items()}
_ALL_ROWS["Programme"] = f"""SELECT * REPLACE (CASE ProgrammeID WHEN 72 THEN 4 ELSE ProgrammeID END AS ProgrammeID)
    FROM ({_ALL_ROWS["Programme"]}) AS p"""
_OF_ALL_ROWS = ", ".join(f"{name} AS ({text})" for name, text in _ALL_ROWS.items())
for _name, _query in (("checked_batch", _checked_batch), ("counted_batches", _counted_batches)):
    _add_with(_name, _query, _OF_ALL_ROWS, " UNION ALL ".join(map(_rule_oracle, _COUNTED_RULES)))

# ---- figures from file footers -----------------------------------------------------------------

_NUMBERED = ("Programme", "Course", "Enrollment", "AssessmentResult", "FeePayment", "LMSActivity")


def _stored(t: RecordTables, names: tuple[str, ...]) -> str:
    folder = _shared_folder(t)
    for name in names:
        catalog.write_snapshot(t[name], f"{folder}/{name}.parquet")
    return folder


QUERIES["stored_row_counts"] = lambda t: footers.stored_row_counts(t.spark, _stored(t, BROWSED_TABLES), BROWSED_TABLES)
ORACLES["stored_row_counts"] = ORACLES["row_count_summary"]
QUERIES["stored_next_keys"] = lambda t: footers.stored_next_keys(t.spark, _stored(t, _NUMBERED), _NUMBERED)
ORACLES["stored_next_keys"] = oracle(
    " UNION ALL ".join(
        f"SELECT '{n}' AS TableName, CAST(MAX({PRIMARY_KEYS[n]}) AS BIGINT) + 1 AS NextKey FROM {n}" for n in _NUMBERED
    )
)
