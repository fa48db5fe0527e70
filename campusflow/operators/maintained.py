"""Dashboard figures kept as stored sums, into which a batch job merges only what it changed.

Every figure of the student mix, the marks, grades, payments and activity is a sum over rows.  A *state* holds those
sums in mergeable form (counts and sums, no averages); two states of disjoint rows add up to the state of both.
So after a batch the figures follow from the old states and the accepted rows, and no old fact is read again:

- ``cube``: students, enrollments and results per programme, status and gender, the three things students are
  filtered by, so every filtered figure is a sum over cells of it;
- ``people``: the same sums per student, with the student's cell: what a student carries along who moves from one cell
  to another.  It is the only state that grows with the students; a change reads the students it names;
- ``grades``, ``methods``, ``activity``, ``offerings``: results per grade, payments per method, events per type,
  enrollments per offering.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from campusflow.functions import count_where, grade_rank, largest_first, mean_of, rounded_double, share_of_total, weighted_mark
from campusflow.operators.filters import NO_FILTER, StudentFilter, filter_students
from campusflow.operators.updates import stored
from campusflow.plans.marks import with_course
from campusflow.schema import GENDERS
from campusflow.sources.partitions import read_partitioned, rewrite_changed, save_partitioned, stored_rows

Tables = Mapping[str, DataFrame]
States = dict[str, DataFrame]

CELL = ("ProgrammeID", "Status", "Gender")
CARRIED = ("Enrollments", "Results", "Marked", "MarkSum", "GradeA", "GradeF")
# Each state's keys, its sums, and the count that says whether a key is still there.
SHAPES = {
    "cube": (CELL, ("Students", *CARRIED), "Students"),
    "grades": (("FinalGrade",), ("Results", "Marked", "MarkSum"), "Results"),
    "methods": (("PaymentMethod",), ("Payments", "Paid", "Owed"), "Payments"),
    "activity": (("ActivityType",), ("Events",), "Events"),
    "offerings": (("CourseOfferingID",), ("Enrollments",), "Enrollments"),
}
_MARK_SUM = "decimal(38,3)"
_MONEY = "decimal(20,2)"
PARTS = 64


def _type(name: str) -> str:
    return {"MarkSum": _MARK_SUM, "Paid": _MONEY, "Owed": _MONEY}.get(name, "long")


def _zero(name: str) -> Column:
    return F.lit(0).cast(_type(name)).alias(name)


def _mark_sums() -> list[Column]:
    mark = weighted_mark()
    return [F.count(mark).alias("Marked"), F.coalesce(F.sum(mark), F.lit(0)).cast(_MARK_SUM).alias("MarkSum")]


def _of_results(results: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    counts = [count_where(F.col("FinalGrade") == grade).alias(f"Grade{grade}") for grade in ("A", "F")]
    return results.groupBy(*keys).agg(F.count("*").alias("Results"), *_mark_sums(), *counts)


def of_grades(results: DataFrame) -> DataFrame:
    """The ``grades`` state of some results."""
    return results.groupBy("FinalGrade").agg(F.count("*").alias("Results"), *_mark_sums())


def of_payments(payments: DataFrame) -> DataFrame:
    """The ``methods`` state of some payments."""
    sums = {"Paid": "AmountPaid", "Owed": "Balance"}
    found = [F.coalesce(F.sum(column), F.lit(0)).cast(_MONEY).alias(name) for name, column in sums.items()]
    return payments.groupBy("PaymentMethod").agg(F.count("*").alias("Payments"), *found)


def of_activity(events: DataFrame) -> DataFrame:
    """The ``activity`` state of some events."""
    return events.groupBy("ActivityType").agg(F.count("*").alias("Events"))


def of_offerings(enrollments: DataFrame) -> DataFrame:
    """The ``offerings`` state of some enrollments."""
    return enrollments.groupBy("CourseOfferingID").agg(F.count("EnrollmentID").alias("Enrollments"))


def of_people(tables: Tables) -> DataFrame:
    """One row per student: the cell, and the sums over the student's enrollments and results.

    Facts are summed per student before they meet, so a student with very many is one row in every join.
    """
    enrollment = tables["Enrollment"].select("EnrollmentID", "StudentID")
    enrolled = enrollment.groupBy("StudentID").agg(F.count("*").alias("Enrollments"))
    results = _of_results(tables["AssessmentResult"].join(enrollment, "EnrollmentID"), ("StudentID",))
    people = tables["Student"].select("StudentID", *CELL)
    joined = people.join(enrolled, "StudentID", "left").join(results, "StudentID", "left")
    return joined.select("StudentID", *CELL, *[F.coalesce(c, F.lit(0)).cast(_type(c)).alias(c) for c in CARRIED])


def of_cube(people: DataFrame) -> DataFrame:
    """The ``cube`` of some students."""
    sums = [F.sum(c).cast(_type(c)).alias(c) for c in CARRIED]
    return people.groupBy(*CELL).agg(F.count("*").alias("Students"), *sums)


def summarise(tables: Tables) -> States:
    """All states, from whole tables; the sums per student are stored, as the cube is made of them."""
    people = stored(of_people(tables))
    return {
        "people": people,
        "cube": of_cube(people),
        "grades": of_grades(tables["AssessmentResult"]),
        "methods": of_payments(tables["FeePayment"]),
        "activity": of_activity(tables["LMSActivity"]),
        "offerings": of_offerings(tables["Enrollment"]),
    }


def merged(name: str, *states: DataFrame) -> DataFrame:
    """The state of all rows behind the given states; keys without rows left are gone."""
    keys, sums, alive = SHAPES[name]
    every = reduce(DataFrame.unionByName, [s.select(*keys, *sums) for s in states])
    return every.groupBy(*keys).agg(*[F.sum(c).cast(_type(c)).alias(c) for c in sums]).filter(F.col(alive) != 0)


def _negative(state: DataFrame, name: str) -> DataFrame:
    keys, sums, _ = SHAPES[name]
    return state.select(*keys, *[(-F.col(c)).cast(_type(c)).alias(c) for c in sums])


def _people_named(people: DataFrame, rows: DataFrame) -> DataFrame:
    return people.join(rows.select("StudentID").distinct(), "StudentID", "left_semi")


def appended(states: States, students: DataFrame) -> States:
    """The changed states after ``append_students`` accepted these; ``people`` has only the changed rows."""
    new = students.select("StudentID", *CELL, *[_zero(c) for c in CARRIED])
    return {"people": new, "cube": merged("cube", states["cube"], of_cube(new))}


def updated(states: States, students: DataFrame) -> States:
    """The changed states after ``update_students`` set these rows (all columns, new values).

    What a student carries leaves the old cell and enters the new one.
    """
    before = _people_named(states["people"], students)
    after = before.drop(*CELL).join(students.select("StudentID", *CELL), "StudentID").select(before.columns)
    cube = merged("cube", states["cube"], _negative(of_cube(before), "cube"), of_cube(after))
    return {"people": after, "cube": cube}


def enrolled(states: States, enrollments: DataFrame) -> States:
    """The changed states after ``enrol_students`` accepted these, which are read once per state."""
    return _gained(states, stored(enrollments.groupBy("StudentID").agg(F.count("*").alias("Enrollments")))) | {
        "offerings": merged("offerings", states["offerings"], of_offerings(enrollments))
    }


def marked(states: States, results: DataFrame, enrollment: DataFrame) -> States:
    """The changed states after results came in; ``enrollment`` names their students (EnrollmentID, StudentID)."""
    of_student = enrollment.select("EnrollmentID", "StudentID")
    gained = _of_results(results.join(of_student, "EnrollmentID"), ("StudentID",))
    return _gained(states, gained) | {"grades": merged("grades", states["grades"], of_grades(results))}


def paid(states: States, payments: DataFrame) -> States:
    """The changed state after payments came in."""
    return {"methods": merged("methods", states["methods"], of_payments(payments))}


def active(states: States, events: DataFrame) -> States:
    """The changed state after events came in."""
    return {"activity": merged("activity", states["activity"], of_activity(events))}


def _gained(states: States, gains: DataFrame) -> States:
    """States after students gained some of the carried sums; gains of unknown students belong to no cell."""
    sums = [c for c in CARRIED if c in gains.columns]
    before = _people_named(states["people"], gains)
    both = before.join(gains.select("StudentID", *[F.col(c).alias(f"_{c}") for c in sums]), "StudentID")
    after = both.withColumns({c: (F.col(c) + F.col(f"_{c}")).cast(_type(c)) for c in sums}).select(before.columns)
    gain = both.select(*CELL, *[F.col(f"_{c}").cast(_type(c)).alias(c) if c in sums else _zero(c) for c in CARRIED])
    cells = of_cube(gain).withColumn("Students", F.lit(0).cast("long"))
    return {"people": after, "cube": merged("cube", states["cube"], cells)}


# ---- stored -----------------------------------------------------------------------------------


def _version() -> str:
    return f"v-{uuid.uuid4().hex}"


class StoredStates(Mapping):
    """States in a folder: which version of each holds, and how a change is put in.

    ``versions`` names the folder of each small state; whoever shares the states shares this small map.
    """

    def __init__(self, spark: SparkSession, folder: str, versions: Mapping[str, str], parts: int = PARTS) -> None:
        self.spark, self.folder, self.versions, self.parts = spark, folder, dict(versions), parts

    @classmethod
    def create(cls, spark: SparkSession, states: States, folder: str, parts: int = PARTS) -> StoredStates:
        versions = {}
        for name, state in states.items():
            if name == "people":
                save_partitioned(state, f"{folder}/people", "StudentID", parts)
            else:
                versions[name] = _version()
                state.write.parquet(f"{folder}/{name}/{versions[name]}")
        return cls(spark, folder, versions, parts)

    def __getitem__(self, name: str) -> DataFrame:
        if name == "people":
            return read_partitioned(self.spark, f"{self.folder}/people")
        return self.spark.read.parquet(f"{self.folder}/{name}/{self.versions[name]}")

    def __iter__(self):
        return iter(["people", *self.versions])

    def __len__(self) -> int:
        return 1 + len(self.versions)

    def naming(self, rows: DataFrame) -> States:
        """The states, of ``people`` only those that ``rows`` name, read from the partitions that can hold them."""
        named = stored(rows.select("StudentID").distinct())
        people = stored_rows(self.spark, f"{self.folder}/people", named, "StudentID", self.parts)
        return dict(self) | {"people": people}

    def put(self, changes: States) -> list[int]:
        """Store what a job changed; returns the rewritten partitions of ``people``.

        Small states go to new versions first; then the changed students replace their old rows.  Should the
        job fail between the two, the same call can be made again: every written value is a whole one.
        """
        fresh = {name: _version() for name in changes if name != "people"}
        for name, version in fresh.items():
            changes[name].write.parquet(f"{self.folder}/{name}/{version}")
        touched = []
        if "people" in changes:
            touched = rewrite_changed(self.spark, f"{self.folder}/people", changes["people"], "StudentID", self.parts)
        self.versions |= fresh
        return touched


# ---- figures ----------------------------------------------------------------------------------


def _cells(states: Mapping[str, DataFrame], programme: DataFrame, selection: StudentFilter) -> DataFrame:
    """The chosen cells with the programme's name."""
    named = programme.select("ProgrammeID", "ProgrammeName")
    return filter_students(states["cube"].join(named, "ProgrammeID"), selection)


def _students(states: Mapping[str, DataFrame], programme: DataFrame, selection: StudentFilter, *keys: str) -> DataFrame:
    cells = _cells(states, programme, selection).filter("Students <> 0")
    return cells.groupBy(*keys).agg(F.sum("Students").alias("Students"))


def students_per_programme(states, programme: DataFrame, selection: StudentFilter = NO_FILTER) -> DataFrame:
    """As ``overview.students_per_programme``."""
    return _students(states, programme, selection, "ProgrammeName").orderBy(*largest_first("Students", "ProgrammeName"))


def gender_share(states, programme: DataFrame, selection: StudentFilter = NO_FILTER) -> DataFrame:
    """As ``overview.gender_share``."""
    counts = _students(states, programme, selection, "Gender")
    return share_of_total(counts, "Students").orderBy(*largest_first("Students", "Gender"))


def status_distribution(states, programme: DataFrame, selection: StudentFilter = NO_FILTER) -> DataFrame:
    """As ``overview.status_distribution``."""
    return _students(states, programme, selection, "Status").orderBy(*largest_first("Students", "Status"))


def programme_gender(states, programme: DataFrame, selection: StudentFilter = NO_FILTER) -> DataFrame:
    """As ``overview.programme_gender``."""
    return _students(states, programme, selection, "ProgrammeName", "Gender").withColumnRenamed("Students", "n")


def programme_gender_wide(states, programme: DataFrame, selection: StudentFilter = NO_FILTER) -> DataFrame:
    """As ``overview.programme_gender_wide``."""
    wide = programme_gender(states, programme, selection).groupBy("ProgrammeName").pivot("Gender", list(GENDERS)).agg(F.sum("n"))
    return wide.na.fill(0, list(GENDERS))


def programme_marks(states, programme: DataFrame, selection: StudentFilter = NO_FILTER) -> DataFrame:
    """As ``marks.programme_marks``."""
    mark = rounded_double(mean_of(F.sum("MarkSum"), F.sum("Marked"))).alias("AvgMark")
    cells = _cells(states, programme, selection).filter("Results > 0")
    grouped = cells.groupBy("ProgrammeName").agg(mark, F.sum("Results").alias("Results"))
    return grouped.orderBy(*largest_first("AvgMark", "ProgrammeName"))


def programme_performance(states, programme: DataFrame) -> DataFrame:
    """As ``marks.programme_performance``."""
    grouped = _cells(states, programme, NO_FILTER).filter("Results > 0").groupBy("ProgrammeName").agg(
        F.sum("Results").alias("Results"),
        F.round(mean_of(F.sum("MarkSum"), F.sum("Marked")), 2).cast("decimal(8,2)").alias("AvgWeightedMark"),
        F.sum("GradeA").alias("Grade_A"),
        F.sum("GradeF").alias("Grade_F"),
    )
    return grouped.orderBy(*largest_first("AvgWeightedMark", "ProgrammeName"))


def grade_distribution(states) -> DataFrame:
    """As ``marks.grade_distribution``."""
    counts = states["grades"].select(F.col("FinalGrade").alias("Grade"), F.col("Results").alias("Count"))
    return counts.orderBy(grade_rank("Grade"), F.col("Grade").asc_nulls_last())


def payment_methods(states) -> DataFrame:
    """As ``finance.payment_methods``."""
    totals = states["methods"].select("PaymentMethod", "Payments", F.col("Paid").alias("Total"))
    return totals.orderBy(*largest_first("Total", "PaymentMethod"))


def activity_types(states) -> DataFrame:
    """As ``engagement.activity_types``."""
    return states["activity"].select("ActivityType", F.col("Events").alias("n")).orderBy(*largest_first("n", "ActivityType"))


def course_enrolment(states, tables: Tables) -> DataFrame:
    """As ``marks.course_enrolment``; of the tables only offerings and courses are read."""
    grouped = with_course(states["offerings"], tables, "CourseTitle").groupBy("CourseTitle")
    return grouped.agg(F.sum("Enrollments").alias("TotalEnrollments")).orderBy(*largest_first("TotalEnrollments", "CourseTitle"))


def kpi_row(states, programme: DataFrame, selection: StudentFilter = NO_FILTER) -> DataFrame:
    """As ``overview.kpi_row``."""

    def total(column: str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0))

    people = _cells(states, programme, selection).agg(F.struct(total("Students").alias("s"), total("Enrollments").alias("e")))
    marks = states["grades"].agg(
        F.struct(total("Results").alias("r"), rounded_double(mean_of(F.sum("MarkSum"), F.sum("Marked"))).alias("m"))
    )
    one_row = states["cube"].sparkSession.range(1)
    parts = one_row.select(
        people.scalar().alias("p"),
        marks.scalar().alias("g"),
        states["methods"].agg(total("Owed")).scalar().alias("owed"),
        states["activity"].agg(total("Events")).scalar().alias("events"),
    )
    return parts.select(
        F.col("p.s").alias("students"),
        F.col("p.e").alias("enrollments"),
        F.col("g.r").alias("results"),
        F.col("g.m").alias("avg_mark"),
        F.col("owed").cast("decimal(20,2)").alias("outstanding"),
        F.col("events").alias("lms_events"),
    )
