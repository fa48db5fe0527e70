"""The twelve tables of the academic records model and the rules they must keep.

Everything here is data: Spark schemas, keys, references, value domains.  The
rules are checked by ``campusflow.operators.quality`` as ordinary aggregations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import (
    DataType,
    DateType,
    DecimalType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

_INT = IntegerType()
_LONG = LongType()
_TEXT = StringType()
_DATE = DateType()
_STAMP = TimestampNTZType()
_SCORE = DecimalType(5, 2)
_MONEY = DecimalType(10, 2)


def _optional(kind: DataType) -> StructField:
    return StructField("", kind, True)


def _table(**columns: DataType | StructField) -> StructType:
    """A schema from its columns in order; plain types are required columns."""
    return StructType(
        [
            StructField(name, kind.dataType, True)
            if isinstance(kind, StructField)
            else StructField(name, kind, False)
            for name, kind in columns.items()
        ]
    )


# Table and column names, types and nullability are the data contract.
SCHEMAS: dict[str, StructType] = {
    "Department": _table(
        DepartmentID=_INT,
        DepartmentName=_TEXT,
        Faculty=_TEXT,
        OfficeLocation=_optional(_TEXT),
    ),
    "Programme": _table(
        ProgrammeID=_INT,
        DepartmentID=_INT,
        ProgrammeCode=_TEXT,
        ProgrammeName=_TEXT,
        DegreeType=_optional(_TEXT),
        DurationYears=_optional(_INT),
    ),
    "Course": _table(
        CourseID=_INT,
        DepartmentID=_INT,
        CourseCode=_TEXT,
        CourseTitle=_TEXT,
        CreditHours=_optional(_INT),
    ),
    "Lecturer": _table(
        LecturerID=_TEXT,
        DepartmentID=_INT,
        LecturerName=_TEXT,
        Rank=_optional(_TEXT),
        Email=_optional(_TEXT),
    ),
    "Semester": _table(SemesterID=_INT, SemesterName=_TEXT, StartDate=_DATE, EndDate=_DATE),
    "Student": _table(
        StudentID=_TEXT,
        ProgrammeID=_INT,
        FirstName=_TEXT,
        LastName=_TEXT,
        Gender=_optional(_TEXT),
        DateOfBirth=_optional(_DATE),
        Email=_optional(_TEXT),
        PhoneNumber=_optional(_TEXT),
        AdmissionYear=_optional(_INT),
        Status=_optional(_TEXT),
    ),
    "Admission": _table(
        AdmissionID=_INT,
        ProgrammeID=_INT,
        ApplicantName=_TEXT,
        AdmissionDate=_DATE,
        AdmissionStatus=_optional(_TEXT),
    ),
    "CourseOffering": _table(
        CourseOfferingID=_INT,
        CourseID=_INT,
        LecturerID=_TEXT,
        SemesterID=_INT,
        AcademicYear=_TEXT,
    ),
    "Enrollment": _table(
        EnrollmentID=_INT,
        StudentID=_TEXT,
        CourseOfferingID=_INT,
        EnrollmentDate=_DATE,
        EnrollmentStatus=_optional(_TEXT),
    ),
    "AssessmentResult": _table(
        ResultID=_INT,
        EnrollmentID=_INT,
        CourseworkScore=_optional(_SCORE),
        ExamScore=_optional(_SCORE),
        FinalGrade=_optional(_TEXT),
    ),
    "FeePayment": _table(
        PaymentID=_INT,
        StudentID=_TEXT,
        AmountPaid=_MONEY,
        PaymentDate=_DATE,
        PaymentMethod=_optional(_TEXT),
        Balance=_optional(_MONEY),
    ),
    "LMSActivity": _table(
        ActivityID=_LONG,
        StudentID=_TEXT,
        CourseOfferingID=_optional(_INT),
        LoginTimestamp=_STAMP,
        ActivityType=_optional(_TEXT),
        DurationMinutes=_optional(_INT),
    ),
}

# The data browser and the row-count summary leave Admission out.
BROWSED_TABLES = tuple(name for name in SCHEMAS if name != "Admission")

# The key of every table is its first column.
PRIMARY_KEYS: dict[str, str] = {name: schema.names[0] for name, schema in SCHEMAS.items()}

# The unique constraints besides the primary keys.
UNIQUE_KEYS: list[tuple[str, tuple[str, ...]]] = [
    ("Department", ("DepartmentName",)),
    ("Programme", ("ProgrammeCode",)),
    ("Course", ("CourseCode",)),
    ("Lecturer", ("Email",)),
    ("Student", ("Email",)),
    ("CourseOffering", ("CourseID", "SemesterID", "AcademicYear")),
    ("Enrollment", ("StudentID", "CourseOfferingID")),
    ("AssessmentResult", ("EnrollmentID",)),
]

# Child table -> its parents.  A reference always carries the
# name of the parent's key, so naming the parent is enough.
PARENTS: dict[str, tuple[str, ...]] = {
    "Programme": ("Department",),
    "Course": ("Department",),
    "Lecturer": ("Department",),
    "Student": ("Programme",),
    "Admission": ("Programme",),
    "CourseOffering": ("Course", "Lecturer", "Semester"),
    "Enrollment": ("Student", "CourseOffering"),
    "AssessmentResult": ("Enrollment",),
    "FeePayment": ("Student",),
    "LMSActivity": ("Student", "CourseOffering"),
}

# Allowed values per column; the grades run from best to worst.
GRADE_ORDER = ("A", "B+", "B", "C+", "C", "D+", "D", "F")
GENDERS = ("Male", "Female", "Other")
DOMAINS: dict[tuple[str, str], tuple[str, ...]] = {
    ("Programme", "DegreeType"): ("BSc", "MSc", "MPhil", "PhD", "Diploma"),
    ("Student", "Gender"): GENDERS,
    ("Student", "Status"): ("Active", "Suspended", "Graduated", "Withdrawn"),
    ("Admission", "AdmissionStatus"): ("Pending", "Admitted", "Rejected"),
    ("Enrollment", "EnrollmentStatus"): ("Active", "Dropped", "Completed", "Failed"),
    ("AssessmentResult", "FinalGrade"): GRADE_ORDER + ("I",),
    ("FeePayment", "PaymentMethod"): ("Bank", "Mobile Money", "Card", "Cash"),
    ("LMSActivity", "ActivityType"): ("Login", "PageView", "QuizAttempt", "AssignmentUpload", "Forum"),
}

# Range rules, as (columns, condition every row must not fail).
RANGES: list[tuple[str, tuple[str, ...], str]] = [
    ("Programme", ("DurationYears",), "DurationYears > 0"),
    ("Course", ("CreditHours",), "CreditHours BETWEEN 1 AND 6"),
    ("Semester", ("StartDate", "EndDate"), "EndDate > StartDate"),
    ("Student", ("AdmissionYear",), "AdmissionYear BETWEEN 2000 AND 2100"),
    ("AssessmentResult", ("CourseworkScore",), "CourseworkScore BETWEEN 0 AND 100"),
    ("AssessmentResult", ("ExamScore",), "ExamScore BETWEEN 0 AND 100"),
    ("FeePayment", ("AmountPaid",), "AmountPaid >= 0"),
    ("LMSActivity", ("DurationMinutes",), "DurationMinutes >= 0"),
]

# Widest text each column may hold, by width.
_WIDTHS: dict[str, dict[str, int]] = {
    "Department": {"DepartmentName": 100, "Faculty": 100, "OfficeLocation": 100},
    "Programme": {"ProgrammeCode": 10, "ProgrammeName": 100, "DegreeType": 50},
    "Course": {"CourseCode": 10, "CourseTitle": 150},
    "Lecturer": {"LecturerID": 15, "LecturerName": 100, "Rank": 50, "Email": 100},
    "Semester": {"SemesterName": 40},
    "Student": {
        "StudentID": 15,
        "FirstName": 50,
        "LastName": 50,
        "Gender": 10,
        "Email": 100,
        "PhoneNumber": 20,
        "Status": 20,
    },
    "Admission": {"ApplicantName": 150, "AdmissionStatus": 20},
    "CourseOffering": {"LecturerID": 15, "AcademicYear": 9},
    "Enrollment": {"StudentID": 15, "EnrollmentStatus": 20},
    "AssessmentResult": {"FinalGrade": 2},
    "FeePayment": {"StudentID": 15, "PaymentMethod": 30},
    "LMSActivity": {"StudentID": 15, "ActivityType": 50},
}

# What an omitted column is filled with, as SQL expressions.
DEFAULTS: dict[str, dict[str, str]] = {
    "Student": {"Status": "'Active'"},
    "Admission": {"AdmissionDate": "current_date()"},
    "Enrollment": {"EnrollmentDate": "current_date()", "EnrollmentStatus": "'Active'"},
    "FeePayment": {"PaymentDate": "current_date()"},
}

# Canonical spelling of result columns that are no table column.
RESULT_COLUMNS = (
    "Students",
    "Enrollments",
    "Results",
    "Events",
    "Minutes",
    "Total",
    "Payments",
    "Paid",
    "Outstanding",
    "Count",
    "FullName",
    "CourseName",
    "Grade",
    "AvgMark",
    "TotalPaid",
    "TotalBalance",
    "NumPayments",
    "NumSections",
    "n",
    "label",
    "StudentName",
    # Further results of this library.
    "AvgWeightedMark",
    "CoursesTaken",
    "Grade_A",
    "Grade_F",
    "LMSEvents",
    "NextKey",
    "OutstandingBalance",
    "Quadrant",
    "RowCount",
    "TableName",
    "TotalCreditHours",
    "TotalEnrollments",
    "TotalMinutes",
    "TotalRevenue",
    "TotalStudents",
    "Violations",
    "WeightedMark",
)


@dataclass(frozen=True)
class Rule:
    """One constraint.  ``kind`` says which of the optional parts are used."""

    table: str
    kind: str  # not_null, primary_key, unique, foreign_key, domain, range, length
    columns: tuple[str, ...]
    allowed: tuple[str, ...] = ()
    condition: str = ""
    parent: str = ""
    parent_key: str = ""
    width: int = 0

    @property
    def rule_id(self) -> str:
        return f"{self.table}.{'+'.join(self.columns)}.{self.kind}"


def contract_rules(domains: dict[tuple[str, str], tuple[str, ...]] = DOMAINS) -> list[Rule]:
    """Every rule of the data contract; ``domains`` may be swapped for local value lists."""
    rules = [Rule(t, "primary_key", (key,)) for t, key in PRIMARY_KEYS.items()]
    rules += [
        Rule(t, "not_null", (field.name,))
        for t, schema in SCHEMAS.items()
        for field in schema
        if not field.nullable and field.name != PRIMARY_KEYS[t]
    ]
    rules += [Rule(t, "unique", columns) for t, columns in UNIQUE_KEYS]
    rules += [
        Rule(t, "foreign_key", (PRIMARY_KEYS[p],), parent=p, parent_key=PRIMARY_KEYS[p])
        for t, parents in PARENTS.items()
        for p in parents
    ]
    rules += [Rule(t, "domain", (c,), allowed=values) for (t, c), values in domains.items()]
    rules += [Rule(t, "range", columns, condition=text) for t, columns, text in RANGES]
    rules += [
        Rule(t, "length", (c,), width=width) for t, widths in _WIDTHS.items() for c, width in widths.items()
    ]
    return rules
