"""Loading, defaults, browsing, read-only SQL and export."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from campusflow.operators.keys import append_serial, assign_serial, next_key, renumber
from campusflow.schema import SCHEMAS
from campusflow.session import tune
from campusflow.sources import catalog, load
from campusflow.sources.first_load import first_load

# ---- load ---------------------------------------------------------------------------


def write(folder, name, text):
    (folder / name).write_text(text)


def test_csv_is_read_with_declared_types(spark, tmp_path):
    write(tmp_path, "Semester.csv", "SemesterID,SemesterName,StartDate,EndDate\n1,First,2026-01-05,2026-05-01\n")
    write(
        tmp_path,
        "LMSActivity.csv",
        "ActivityID,StudentID,CourseOfferingID,LoginTimestamp,ActivityType,DurationMinutes\n"
        "7,0042,,2026-02-01 10:14:30,Login,12\n",
    )
    tables = load.load_tables(spark, str(tmp_path), "csv", ["Semester", "LMSActivity"])
    assert tuple(tables["Semester"].first()) == (1, "First", dt.date(2026, 1, 5), dt.date(2026, 5, 1))
    row = tables["LMSActivity"].first()
    assert row.StudentID == "0042" and row.CourseOfferingID is None
    assert row.LoginTimestamp == dt.datetime(2026, 2, 1, 10, 14, 30)


def test_a_row_that_does_not_fit_is_an_error(spark, tmp_path):
    write(tmp_path, "Semester.csv", "SemesterID,SemesterName,StartDate,EndDate\n1,First,soon,2026-05-01\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        load.load_tables(spark, str(tmp_path), "csv", ["Semester"])["Semester"].collect()


def test_a_wrong_header_is_an_error(spark, tmp_path):
    write(tmp_path, "Semester.csv", "SemesterID,StartDate,SemesterName,EndDate\n1,2026-01-05,First,2026-05-01\n")
    with pytest.raises(Exception, match="(?i)header"):
        load.load_tables(spark, str(tmp_path), "csv", ["Semester"])["Semester"].collect()


def test_padded_grades_are_trimmed(spark, tmp_path):
    write(
        tmp_path,
        "AssessmentResult.csv",
        "ResultID,EnrollmentID,CourseworkScore,ExamScore,FinalGrade\n1,1,50.25,60,A \n2,2,,60,B+\n",
    )
    df = load.load_tables(spark, str(tmp_path), "csv", ["AssessmentResult"])["AssessmentResult"]
    assert [(r.CourseworkScore, r.FinalGrade) for r in df.collect()] == [(Decimal("50.25"), "A"), (None, "B+")]


def test_missing_keys_are_numbered_in_arrival_order(spark, tmp_path):
    lines = "".join(f"{n * 7 % 50 + 1},{n}.00,1.00,A\n" for n in range(50))
    write(tmp_path, "AssessmentResult.csv", "EnrollmentID,CourseworkScore,ExamScore,FinalGrade\n" + lines)
    df = load.load_tables(spark, str(tmp_path), "csv", ["AssessmentResult"], omitted={"AssessmentResult": ["ResultID"]})
    got = sorted((r.ResultID, int(r.CourseworkScore)) for r in df["AssessmentResult"].collect())
    assert got == [(n + 1, n) for n in range(50)]
    assert df["AssessmentResult"].schema["ResultID"].dataType == SCHEMAS["AssessmentResult"]["ResultID"].dataType


def test_arrival_order_holds_over_files_and_blocks(spark, tmp_path):
    folder = tmp_path / "FeePayment.csv"
    folder.mkdir()
    header = "StudentID,AmountPaid,PaymentDate,PaymentMethod,Balance\n"
    for part in range(3):
        lines = "".join(f"S,{part * 400 + n}.00,2026-01-01,Card,0\n" for n in range(400))
        write(folder, f"part-{part}.csv", header + lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = load.load_table(spark, str(tmp_path), "FeePayment", "csv", omitted=["PaymentID"])
        got = sorted((r.PaymentID, int(r.AmountPaid)) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(n + 1, n) for n in range(1200)]


def test_first_load_fills_writes_and_reports(spark, tables, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    for name in ("Department", "Programme", "Course", "Lecturer", "Semester", "CourseOffering"):
        catalog.export_csv(tables[name], str(source / f"{name}.csv"))
    catalog.export_csv(tables["Student"].drop("Status", "DateOfBirth"), str(source / "Student.csv"))
    write(source, "Enrollment.csv", "StudentID,CourseOfferingID\nS02,3\nS01,1\nS01,1\nnobody,2\n")
    names = ["Department", "Programme", "Course", "Lecturer", "Semester", "Student", "CourseOffering", "Enrollment"]
    report = first_load(
        spark,
        str(source),
        str(target),
        names=names,
        omitted={
            "Student": ["Status", "DateOfBirth"],
            "Enrollment": ["EnrollmentID", "EnrollmentDate", "EnrollmentStatus"],
        },
    )
    broken = {r.RuleID: r.Violations for r in report.collect() if r.Violations}
    assert broken == {
        "Student.FirstName.not_null": 1,
        "Enrollment.StudentID.foreign_key": 1,
        "Enrollment.StudentID+CourseOfferingID.unique": 1,
    }
    loaded = load.load_tables(spark, str(target), names=names)
    enrolled = sorted((r.EnrollmentID, r.StudentID, r.EnrollmentStatus) for r in loaded["Enrollment"].collect())
    assert enrolled == [(1, "S02", "Active"), (2, "S01", "Active"), (3, "S01", "Active"), (4, "nobody", "Active")]
    assert {(r.Status, r.DateOfBirth) for r in loaded["Student"].collect()} == {("Active", None)}


def test_parquet_round_trip(spark, tables, tmp_path):
    for name in SCHEMAS:
        catalog.write_snapshot(tables[name], str(tmp_path / f"{name}.parquet"))
    loaded = load.load_tables(spark, str(tmp_path))
    for name in SCHEMAS:
        assert [(f.name, f.dataType) for f in loaded[name].schema] == [(f.name, f.dataType) for f in SCHEMAS[name]]
        assert loaded[name].exceptAll(tables[name]).count() == 0
    with pytest.raises(Exception, match="(?i)exists"):
        catalog.write_snapshot(tables["Student"], str(tmp_path / "Student.parquet"))


def test_literal_rows(spark):
    rows = [(1, "First", "2026-01-05", "2026-05-01"), (2, "Second", "2026-08-01", "2026-12-01")]
    df = load.load_literals(spark, rows, SCHEMAS["Semester"])
    assert [tuple(r)[2] for r in df.collect()] == [dt.date(2026, 1, 5), dt.date(2026, 8, 1)]
    assert "LocalRelation" in df._jdf.queryExecution().optimizedPlan().toString()
    departments = load.load_literals(spark, [(1, "Craft", "Arts", None)], SCHEMAS["Department"])
    assert tuple(departments.first()) == (1, "Craft", "Arts", None)
    assert load.load_literals(spark, [], SCHEMAS["Department"]).count() == 0


def test_defaults_fill_omitted_columns_only(spark, make):
    omitted = make("Student", [{"StudentID": "S1"}], only=["StudentID"])
    assert load.apply_defaults(omitted, "Student").first().Status == "Active"
    given = make("Student", [{"StudentID": "S1"}], only=["StudentID", "Status"])
    assert load.apply_defaults(given, "Student").first().Status is None
    today = spark.sql("SELECT current_date()").first()[0]
    row = load.apply_defaults(spark.range(1), "Enrollment").first()
    assert (row.EnrollmentDate, row.EnrollmentStatus) == (today, "Active")
    assert load.apply_defaults(spark.range(1), "FeePayment").first().PaymentDate == today
    assert load.apply_defaults(spark.range(1), "Admission").first().AdmissionDate == today


def test_canonical_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "STUDENTID int, avgmark int, MyOwn int, N int")
    assert load.canonical_columns(df).columns == ["StudentID", "AvgMark", "MyOwn", "n"]


def test_csv_without_line_breaks_is_split_between_tasks(spark, make, tmp_path):
    rows = [(n, f"Department {n}", "Arts", "Hall") for n in range(1, 3001)]
    catalog.export_csv(make("Department", rows).coalesce(1), str(tmp_path / "Department.csv"))
    name, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(name, "16384")
    try:
        tasks = {}
        for breaks in (True, False):
            loaded = load.load_tables(spark, str(tmp_path), "csv", ["Department"], line_breaks=breaks)["Department"]
            tasks[breaks] = loaded.rdd.getNumPartitions()
            assert loaded.count() == 3000
    finally:
        spark.conf.set(name, before)
    assert tasks[True] == 1 and tasks[False] > 2


# ---- keys ----------------------------------------------------------------------------


def test_serial_follows_the_stated_order(spark):
    df = spark.createDataFrame([(c,) for c in "jcaebdhgif"], "letter string").repartition(3)
    got = {r.letter: r.no for r in assign_serial(df, "no", ["letter"]).collect()}
    assert got == {letter: n for n, letter in enumerate("abcdefghij", start=1)}


def test_serial_descending_order_and_missing_values(spark):
    df = spark.createDataFrame([(1,), (None,), (3,), (2,)], "v int")
    got = assign_serial(df, "no", [-F.col("v")]).orderBy("no").collect()
    assert [(r.no, r.v) for r in got] == [(1, 3), (2, 2), (3, 1), (4, None)]


def test_serial_of_many_equal_rows_is_complete_and_spread(spark):
    df = spark.range(0, 20_000, 1, 8).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("v"))
    numbered = assign_serial(df, "no", ["v"], bucket_rows=500)
    assert numbered.select("no").distinct().count() == 20_000
    assert tuple(numbered.agg(F.min("no"), F.max("no")).first()) == (1, 20_000)
    hot = numbered.filter("v = 0").agg(F.min("no"), F.max("no"), F.count("*")).first()
    assert tuple(hot) == (1, 6667, 6667)


def test_serial_does_not_depend_on_how_rows_arrive(spark):
    df = spark.range(0, 3000).select((F.col("id") % 50).alias("v"), F.col("id").alias("own"))
    numbers = [
        sorted(tuple(r) for r in assign_serial(df.repartition(n, *by), "no", ["v"], bucket_rows=rows).collect())
        for n, by, rows in ((1, [], 10_000), (3, ["own"], 100), (7, ["v"], 100), (5, ["own"], 1000))
    ]
    assert numbers[0] == numbers[1] == numbers[2] == numbers[3]


def test_serial_in_buckets_orders_missing_and_mixed_values(spark):
    df = spark.range(0, 5000).select(
        F.when(F.col("id") % 7 > 0, F.col("id") % 13).alias("v"), F.concat(F.lit("t"), F.col("id") % 31).alias("w"), "id"
    )
    found = assign_serial(df, "no", ["v", "w", -F.col("id")], first=11, bucket_rows=60).orderBy("no").collect()
    expected = sorted(df.collect(), key=lambda r: (r.v is None, r.v or 0, r.w, -r.id))
    assert [(r.no, r.id) for r in found] == [(i, r.id) for i, r in enumerate(expected, start=11)]


def test_serial_writes_nothing_in_between(spark, monkeypatch):
    def refuse(self, *_):
        raise AssertionError("a checkpoint")

    df = spark.range(0, 3000, 1, 4)
    monkeypatch.setattr(type(df), "checkpoint", refuse)
    numbered = assign_serial(df, "no", [-F.col("id")], bucket_rows=100)
    assert "rangepartitioning" not in numbered._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.no, r.id) for r in numbered.collect()) == [(n, 3000 - n) for n in range(1, 3001)]


def test_renumber_within_groups(spark):
    df = spark.range(0, 4000).select((F.col("id") * 3).alias("old"), F.when(F.col("id") % 4 > 0, 7).otherwise(F.col("id") % 5).alias("g"))
    found = renumber(df.repartition(5), "no", "old", within=["g"], bucket_rows=700).collect()
    for g in {r.g for r in found}:
        own = sorted((r.old, r.no) for r in found if r.g == g)
        assert [no for _, no in own] == list(range(1, len(own) + 1))
    assert sorted(r.no for r in renumber(df, "no", "old", bucket_rows=50).collect()) == list(range(1, 4001))
    assert renumber(df.limit(0), "no", "old").collect() == []


def test_next_key_and_append(spark, make, rows):
    assert rows(next_key(spark.createDataFrame([(42,), (7,)], "k int"), "k")) == [(43,)]
    assert rows(next_key(spark.createDataFrame([], "k int"), "k")) == [(1,)]
    existing = spark.createDataFrame([(42, "x")], "k int, v string")
    batch = spark.createDataFrame([("b",), ("a",)], "v string")
    added = append_serial(existing, batch, "k", ["v"])
    assert sorted(rows(added, "k", "v")) == [(43, "a"), (44, "b")]
    assert added.schema["k"].dataType == existing.schema["k"].dataType


# ---- browsing and SQL ------------------------------------------------------------------


@pytest.fixture(scope="module")
def registered(spark, tables):
    catalog.register_tables(spark, tables)
    return spark


REFUSED = [
    "DROP TABLE Student",
    "INSERT INTO Student SELECT * FROM Student",
    "SET spark.sql.ansi.enabled = false",
    "CREATE TABLE t AS SELECT 1",
    "SELECT 1; DROP VIEW Student",
    "SELECT 1) t; DROP VIEW Student",
    "SELECT 1; DROP VIEW Student; -- the end",
    "SELECT 1) t; DROP VIEW Student; SELECT * FROM (SELECT 1",
    "SELECT * FROM parquet.`/tmp`",
    "SELECT * FROM csv.`/etc/hosts`",
    "SELECT reflect('java.lang.System', 'getenv', 'HOME')",
    "SELECT java_method('java.lang.System', 'lineSeparator')",
    "SELECT IDENTIFIER('ref' || 'lect')('java.lang.System', 'lineSeparator')",
    "SELECT TRANSFORM(StudentID) USING 'cat' AS (x) FROM Student",
    "SELECT TRANSFORM(StudentID) USING /* */ 'cat' AS (x) FROM Student",
    "SELECT `reflect`('java.lang.System', 'getenv', 'HOME')",
    "SELECT try_reflect('java.lang.System', 'getenv', 'HOME')",
    "SELECT (SELECT max(java_method('java.lang.System', 'lineSeparator')) FROM Programme) FROM Student",
    "SELECT IDENTIFIER(reflect('java.lang.System', 'getProperty', 'user.name')) FROM Student",
    "",
]


@pytest.mark.parametrize("text", REFUSED)
def test_anything_but_a_plain_query_is_refused(registered, text):
    with pytest.raises(Exception):
        catalog.adhoc_sql(registered, text)
    assert registered.table("Student").count() == 8


ALLOWED = [
    ("SELECT 'UPDATE' AS word", 1),
    ("WITH p AS (SELECT * FROM programme) SELECT count(*) FROM p", 1),
    ("SELECT studentid FROM STUDENT;", 8),
    ("SELECT studentid FROM Student -- the end", 8),
    ("SELECT studentid /* id */ FROM Student ;\n", 8),
    ("SELECT studentid FROM Student; -- the end", 8),
    ("SELECT studentid FROM Student; -- the; end\n/* or; not */ ;", 8),
    ("SELECT ';--' AS word", 1),
    ("SELECT s.*, p.* FROM Student s JOIN Programme p ON s.ProgrammeID = p.ProgrammeID", 8),
    ("SELECT * FROM Enrollment JOIN Student USING (StudentID)", 8),
    ("SELECT * FROM v_student_grade_summary", 8),
    ("SELECT StudentID FROM Student WHERE Status <> 'Programming using Python'", 7),
    ("SELECT 1 -- joined using the key", 1),
    ("SELECT 'identifier', 'reflect(1)', 'ScriptTransformation' AS identifier", 1),
    ("SELECT transform(array(1), x -> x + 1) FROM Student JOIN Programme USING (ProgrammeID)", 8),
]


@pytest.mark.parametrize("text, count", ALLOWED)
def test_plain_queries_run(registered, text, count):
    assert len(catalog.adhoc_sql(registered, text).collect()) == count


def test_outer_order_is_kept(registered):
    got = catalog.adhoc_sql(registered, "SELECT StudentID FROM Student ORDER BY StudentID DESC").collect()
    assert [r.StudentID for r in got] == [f"S0{n}" for n in range(8, 0, -1)]


def test_files_as_tables_must_be_off(registered):
    registered.conf.set("spark.sql.runSQLOnFiles", "true")
    try:
        with pytest.raises(ValueError):
            catalog.adhoc_sql(registered, "SELECT 1")
    finally:
        tune(registered)
    assert registered.conf.get("spark.sql.runSQLOnFiles") == "false"


def test_scan_and_shape(tables):
    assert catalog.scan_table(tables, "lmsACTIVITY").count() == 8
    with pytest.raises(KeyError):
        catalog.scan_table(tables, "nothing")
    assert tuple(catalog.table_shape(tables["Student"]).first()) == (8, 10)


def test_csv_export_has_a_header_and_no_index(spark, tables, tmp_path):
    target = str(tmp_path / "out")
    catalog.export_csv(tables["FeePayment"], target)
    back = spark.read.csv(target, header=True)
    assert back.columns == SCHEMAS["FeePayment"].names and back.count() == 7
    with pytest.raises(Exception, match="(?i)exists"):
        catalog.export_csv(tables["FeePayment"], target)


ODD = [" lead", "trail ", 'q"uote', '"', "a,b", "two\nlines", "\r\n", "back\\slash", '\\"', "", None, "#c", "\t"]


def test_csv_gives_back_every_value(spark, tmp_path):
    rows = spark.createDataFrame([(i, text) for i, text in enumerate(ODD)], "id int, text string")
    catalog.export_csv(rows.repartition(2), str(tmp_path / "Odd.csv"))
    back = load.load_table(spark, str(tmp_path), "Odd", "csv", rows.schema)
    assert [r.text for r in back.orderBy("id").collect()] == ODD


@pytest.mark.parametrize("columns", [["DepartmentID"], ["DepartmentID", "DepartmentName", "Faculty", "OfficeLocation", "x"]])
def test_a_parquet_file_with_other_columns_is_an_error(spark, tmp_path, columns):
    table = spark.range(3).select(*[F.col("id").cast("string").alias(c) for c in columns])
    table.write.parquet(str(tmp_path / "Department.parquet"))
    with pytest.raises(ValueError, match="columns"):
        load.load_table(spark, str(tmp_path), "Department")
