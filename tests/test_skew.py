"""A third of all rows under one key: results stay whole, tasks stay even."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from campusflow.operators.keys import assign_serial
from campusflow.plans import marks
from testbed.views import SOURCE_SCHEMAS, read_source

SF_DIR = "/root/testdata/sf0.001"
HOT = [
    "engagement_outcome",
    "engagement_q3",
    "top_engagement",
    "programme_marks",
    "grade_summary",
    "score_scatter",
    "credit_load",
    "student_courses",
    "course_enrolment",
    "outstanding_worklist",
    "outstanding_max",
    "kpi_row",
    "students_per_programme",
    "check_unique",
    "check_foreign_key",
    "failing_rows",
    "assign_serial",
    "append_students",
    "append_students_refused",
    "update_students",
    "update_students_refused",
    "enrol_students",
    "enrol_students_refused",
]


def third(column: str, value) -> F.Column:
    """The column with a third of its rows moved to one value."""
    return F.when(F.xxhash64("*") % 3 == 0, F.lit(value)).otherwise(F.col(column))


@pytest.fixture(scope="module")
def skewed_dir(spark, tmp_path_factory):
    """The test tables with a hot customer, course, order, nation, user and event key."""
    folder = tmp_path_factory.mktemp("skew")
    hot = {
        "orders": {"o_custkey": third("o_custkey", 7)},
        "lineitem": {"l_orderkey": third("l_orderkey", 5)},
        "customer": {"c_nationkey": third("c_nationkey", 3)},
        "supplier": {"s_nationkey": third("s_nationkey", 3)},
        "events": {"user_id": third("user_id", 7), "props": third("props", '{"k": 4}')},
        "part": {"p_brand": third("p_brand", "Brand#1")},
    }
    for name in SOURCE_SCHEMAS:
        df = read_source(spark, SF_DIR, name).withColumns(hot.get(name, {}))
        df.write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


@pytest.fixture(scope="module")
def duck(skewed_dir):
    connection = duckdb.connect()
    for name in SOURCE_SCHEMAS:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{skewed_dir}/{name}.parquet/*.parquet'")
    return connection


@pytest.fixture(params=["10MB", "-1"], ids=["small", "large"])
def threshold(request, spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield request.param
    spark.conf.set(name, before)


@pytest.mark.parametrize("name", HOT)
def test_hot_keys_change_no_result(spark, duck, skewed_dir, name, threshold):
    answer = duck.execute(oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    expected = sorted(tuple(map(str, r)) for r in answer.fetchall())
    df = queries()[name](spark, skewed_dir)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    assert got == expected


def test_numbering_spreads_a_hot_order_value(spark):
    """A third of the rows share the order value, yet no partition holds them all."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")  # the rows here are few enough to be merged
    try:
        df = spark.range(0, 40_000, 1, 4).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("v"))
        numbered = assign_serial(df, "no", ["v"], bucket_rows=2_000).withColumn("part", F.spark_partition_id())
        sizes = numbered.filter("v = -1").groupBy("part").count().collect()
    finally:
        spark.conf.set(name, "true")
    assert sum(r["count"] for r in sizes) == 13_334
    assert len(sizes) >= 2 and max(r["count"] for r in sizes) <= 12_000


@pytest.fixture
def eager_splitting(spark):
    """Thresholds low enough for the few rows of a test to count as skewed."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.fixture
def crowded(spark, tables):
    """120,000 enrollments with results; a third belong to one student, a third to one offering."""
    n = F.col("id")
    students = spark.range(2_000).select(
        F.concat(F.lit("S"), n).alias("StudentID"),
        (n % 4 + 1).cast("int").alias("ProgrammeID"),
        F.lit("A").alias("FirstName"),
        n.cast("string").alias("LastName"),
        F.lit("Female").alias("Gender"),
        F.lit("Active").alias("Status"),
    )
    offerings = spark.range(1, 1_001).select(
        n.cast("int").alias("CourseOfferingID"), (n % 3 + 1).cast("int").alias("CourseID")
    )
    enrollments = spark.range(0, 120_000, 1, 8).select(
        n.cast("int").alias("EnrollmentID"),
        F.concat(F.lit("S"), F.when(n % 3 == 0, 7).otherwise(n % 2_000)).alias("StudentID"),
        F.when(n % 3 == 1, 5).otherwise(n % 1_000 + 1).cast("int").alias("CourseOfferingID"),
    )
    results = spark.range(0, 120_000, 1, 8).select(
        n.cast("int").alias("EnrollmentID"),
        (n % 101).cast("decimal(5,2)").alias("CourseworkScore"),
        (n % 97).cast("decimal(5,2)").alias("ExamScore"),
        F.lit("B").alias("FinalGrade"),
    )
    return tables | {
        "Student": students,
        "CourseOffering": offerings,
        "Enrollment": enrollments,
        "AssessmentResult": results,
    }


@pytest.mark.parametrize(
    "query", [marks.grade_summary, marks.score_scatter, marks.student_courses], ids=lambda q: q.__name__
)
def test_row_level_joins_split_a_hot_key(crowded, eager_splitting, query):
    df = query(crowded)
    assert len(df.collect()) == 120_000
    assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "query", [marks.programme_marks, marks.credit_load, marks.course_enrolment], ids=lambda q: q.__name__
)
def test_sums_meet_their_dimension_as_one_row_per_key(crowded, eager_splitting, query):
    """The shuffle into the join with students or titles carries partial sums, not rows."""
    df = query(crowded)
    df.collect()
    written = []

    def visit(node):
        if node.nodeName() == "Exchange":
            records = node.metrics().get("shuffleRecordsWritten").get().value()
            written.append((node.outputPartitioning().toString(), records))
        children = node.children()
        for i in range(children.size()):
            visit(children.apply(i))
        if node.nodeName().startswith(("AdaptiveSparkPlan",)):
            visit(node.executedPlan())
        if "QueryStage" in node.nodeName():
            visit(node.plan())

    visit(df._jdf.queryExecution().executedPlan())
    key = "CourseOfferingID" if query is marks.course_enrolment else "StudentID"
    per_key = [n for partitioning, n in written if f"hashpartitioning({key}" in partitioning]
    assert per_key and max(per_key) <= 16 * 2_000
