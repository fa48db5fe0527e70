"""Fee payments and balances."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusflow.functions import full_name, largest_first
from campusflow.operators.filters import NO_FILTER, StudentFilter, chosen_ids, students_with_programme, top_students

Tables = Mapping[str, DataFrame]


def payment_methods(tables: Tables) -> DataFrame:
    """Number and sum of payments per method, largest sum first."""
    totals = tables["FeePayment"].groupBy("PaymentMethod").agg(
        F.count("*").alias("Payments"), F.sum("AmountPaid").alias("Total")
    )
    return totals.orderBy(*largest_first("Total", "PaymentMethod"))


def payment_totals(tables: Tables) -> DataFrame:
    """Number and sum of payments per method, in no order."""
    return tables["FeePayment"].groupBy("PaymentMethod").agg(
        F.count("*").alias("TotalTransactions"), F.sum("AmountPaid").alias("TotalAmount")
    )


def _debtors(tables: Tables, selection: StudentFilter = NO_FILTER) -> DataFrame:
    """Selected students whose balances sum to more than zero, before names are joined."""
    payments, chosen = tables["FeePayment"], chosen_ids(tables, selection)
    if chosen is not None:
        payments = payments.join(chosen, "StudentID", "left_semi")
    return (
        payments.groupBy("StudentID")
        .agg(F.sum("AmountPaid").alias("paid"), F.sum("Balance").alias("owed"))
        .filter(F.col("owed") > 0)
    )


def outstanding_worklist(tables: Tables, selection: StudentFilter = NO_FILTER) -> DataFrame:
    """Selected students who owe fees, largest debt first."""
    students = students_with_programme(tables, selection).select(
        "StudentID", full_name().alias("FullName"), "ProgrammeName"
    )
    return (
        students.join(_debtors(tables, selection), "StudentID")
        .withColumnsRenamed({"paid": "Paid", "owed": "Outstanding"})
        .orderBy(*largest_first("Outstanding", "StudentID"))
    )


def outstanding_q4(tables: Tables, limit: int = 100) -> DataFrame:
    """The ``limit`` students who owe most, with what they paid."""
    students = tables["Student"].select("StudentID", full_name().alias("FullName"))
    debts = _debtors(tables).withColumnsRenamed({"paid": "TotalPaid", "owed": "OutstandingBalance"})
    top = top_students(debts, students, largest_first("OutstandingBalance", "StudentID"), limit)
    return top.select("StudentID", "FullName", "TotalPaid", "OutstandingBalance")


def outstanding_max(tables: Tables) -> DataFrame:
    """Paid sum and largest single balance per student, where that balance is above zero."""
    return (
        tables["FeePayment"]
        .groupBy("StudentID")
        .agg(F.sum("AmountPaid").alias("TotalPaid"), F.max("Balance").alias("OutstandingBalance"))
        .filter(F.col("OutstandingBalance") > 0)
    )


def total_revenue(tables: Tables) -> DataFrame:
    """The sum of all payments."""
    return tables["FeePayment"].agg(F.sum("AmountPaid").alias("TotalRevenue"))
