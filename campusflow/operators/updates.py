"""Batch changes: append students, update students, enrol students.

Every job takes tables and a batch and returns the new table and the refused
rows; callers write the new table to a fresh directory.
"""

from __future__ import annotations

import tempfile
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from campusflow.operators.keys import assign_serial, next_key, renumber
from campusflow.operators.quality import ROW_KINDS, row_violation
from campusflow.schema import PRIMARY_KEYS, Rule, contract_rules
from campusflow.sources.load import apply_defaults

Tables = Mapping[str, DataFrame]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make sure reliable checkpoints have a folder.

    The cluster names a shared one in ``spark.checkpoint.dir``.  Only a local
    session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="campusflow-checkpoint-")
    context.setCheckpointDir(folder)


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once to the checkpoint folder, for a frame that several steps read."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


ID_PREFIX = "UG"  # fixed value: student ids are this, the year and a running number
ID_DIGITS = 3  # fixed value: the running number is padded to this width
# The year in an id has four digits.
ID_YEARS = Rule("Student", "range", ("AdmissionYear",), condition="AdmissionYear BETWEEN 1000 AND 9999")
ARRIVAL = "_arrival"  # a row's number in the batch


class Change(NamedTuple):
    """The new table, the rows it gained or changed, and the refused rows with reasons."""

    table: DataFrame
    accepted: DataFrame
    rejected: DataFrame


def _rules_of(table: str, rules: Sequence[Rule] | None) -> list[Rule]:
    return [r for r in (contract_rules() if rules is None else rules) if r.table == table]


def _row_reasons(rules: list[Rule], columns: Sequence[str]) -> Column:
    """Ids of the row rules a row breaks, separated by commas; empty for a sound row."""
    checks = [r for r in rules if r.kind in ROW_KINDS and set(r.columns) <= set(columns)]
    return F.concat_ws(",", *[F.when(row_violation(r), F.lit(r.rule_id)) for r in checks])


def _with_reason(df: DataFrame, broken: Column, reason: str) -> DataFrame:
    so_far = F.when(F.col("Reasons") != "", F.col("Reasons"))
    return df.withColumn("Reasons", F.concat_ws(",", so_far, F.when(broken, F.lit(reason))))


def _sound() -> Column:
    return F.col("Reasons") == ""


def _keys_of(batch: DataFrame, columns: list[str]) -> DataFrame:
    return batch.select(*columns).na.drop().distinct()


def _already_in(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Those of the distinct keys that a table holds.

    The table is reduced by a semi join, so a batch small enough to broadcast
    costs a large table one scan and no shuffle.
    """
    return table.select(*keys.columns).join(keys, keys.columns, "left_semi").distinct()


def _check_reference(df: DataFrame, batch: DataFrame, tables: Tables, rule: Rule) -> DataFrame:
    """Add a reason to rows that refer to a parent that does not exist.

    Only the distinct values of the batch meet the parent table.  What comes
    back to the rows is the usually tiny set of unknown values.
    """
    column = rule.columns[0]
    parents = tables[rule.parent].select(F.col(rule.parent_key).alias(column))
    used = _keys_of(batch, [column])
    unknown = used.join(_already_in(parents, used), column, "left_anti")
    joined = df.join(unknown.withColumn("_unknown", F.lit(True)), column, "left")
    return _with_reason(joined, F.col("_unknown").isNotNull(), rule.rule_id).drop("_unknown")


def _check_unique(df: DataFrame, batch: DataFrame, existing: DataFrame, rule: Rule) -> DataFrame:
    """Add a reason to rows whose key exists already or came earlier in the batch.

    The first valid row of each key is found by an aggregation and matched
    back by key *and* arrival number, which is one row per match even for a
    key that fills the whole batch.  Rows with a NULL in the key are never
    duplicates.
    """
    columns = list(rule.columns)
    candidates = df.filter(_sound()).select(*columns, ARRIVAL).na.drop(subset=columns)
    first = candidates.groupBy(*columns).agg(F.min(ARRIVAL).alias(ARRIVAL))
    fresh = first.join(_already_in(existing, _keys_of(batch, columns)), columns, "left_anti")
    joined = df.join(fresh.withColumn("_fresh", F.lit(True)), [*columns, ARRIVAL], "left")
    keyed = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    repeated = keyed & F.col("_fresh").isNull() & _sound()
    return _with_reason(joined, repeated, rule.rule_id).drop("_fresh")


def _validate(
    df: DataFrame, tables: Tables, table: str, rules: list[Rule], order_by: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Split the batch into sound rows and refused rows, which get ``Reasons``.

    The batch is numbered first, so that rows equal in ``order_by`` have a
    first and a second too; the numbers depend on the rows alone, so every
    check sees the same ones.  The verdicts are checkpointed, once, because
    sound and refused rows are both read from them.
    """
    judged = df.withColumn("Reasons", _row_reasons(rules, df.columns))
    batch = assign_serial(judged, ARRIVAL, order_by)
    checked = batch
    # The values that a check looks up need no numbers, so they come from the rows before those are sorted.
    for rule in rules:
        if rule.kind == "foreign_key":
            checked = _check_reference(checked, judged, tables, rule)
    for rule in rules:
        if rule.kind == "unique":
            checked = _check_unique(checked, judged, tables[table], rule)
    checked = stored(checked)
    return checked.filter(_sound()), checked.filter(~_sound()).drop(ARRIVAL)


def _conform(df: DataFrame, existing: DataFrame, extra: Sequence[str]) -> DataFrame:
    """The batch with exactly the table's columns and types, omitted ones NULL."""
    present = {c.lower() for c in df.columns}
    columns = [
        (F.col(f.name) if f.name.lower() in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in existing.schema
    ]
    return df.select(*columns, *[c for c in extra if c not in existing.columns])


def append_students(
    tables: Tables,
    batch: DataFrame,
    order_by: Sequence[str],
    rules: Sequence[Rule] | None = None,
) -> Change:
    """Add a batch of new students, giving each the next id of its admission year.

    ``order_by`` names columns of the batch; ids and first-come rules follow
    their order.  Ids are the prefix, the admission year
    (the current one where none is given) and a running number.
    """
    existing = tables["Student"]
    key = PRIMARY_KEYS["Student"]
    order = list(order_by)
    rows = _conform(apply_defaults(batch, "Student"), existing, order).drop(key)
    own_rules = [r for r in _rules_of("Student", rules) if key not in r.columns]
    if not any(r.kind == "range" and r.columns == ID_YEARS.columns for r in own_rules):
        own_rules.append(ID_YEARS)
    sound, rejected = _validate(rows, tables, "Student", own_rules, order)

    valid = sound.withColumn("_year", F.coalesce("AdmissionYear", F.year(F.current_date())))
    numbered = renumber(valid, "_serial", ARRIVAL, within=["_year"])
    pattern = rf"^{ID_PREFIX}(\d{{4}})(\d{{{ID_DIGITS},}})$"
    # One row per four-digit year.
    taken = (
        existing.filter(F.col(key).rlike(pattern))
        .select(
            F.regexp_extract(key, pattern, 1).cast("int").alias("_year"),
            F.regexp_extract(key, pattern, 2).try_cast("long").alias("_number"),
        )
        .groupBy("_year")
        .agg(F.max("_number").alias("_last"))
    )
    number = (F.coalesce("_last", F.lit(0)) + F.col("_serial")).cast("string")
    padded = F.when(F.length(number) < ID_DIGITS, F.lpad(number, ID_DIGITS, "0")).otherwise(number)
    accepted = (
        numbered.join(taken, "_year", "left")
        .withColumn(key, F.concat(F.lit(ID_PREFIX), F.col("_year").cast("string"), padded))
        .select(*existing.columns)
    )
    return Change(existing.unionByName(accepted), accepted, rejected)


def update_students(
    tables: Tables,
    updates: DataFrame,
    order_by: Sequence[str],
    rules: Sequence[Rule] | None = None,
) -> Change:
    """Set status and/or programme of students by id.

    ``updates`` holds ``StudentID`` and any of ``Status`` and ``ProgrammeID``;
    NULL leaves a value as it is.  Where an id comes more than once, the last
    value in ``order_by`` order holds.  Unknown ids and invalid values are
    refused row by row.
    """
    existing = tables["Student"]
    settable = [c for c in ("ProgrammeID", "Status") if c in updates.columns]
    order = list(order_by)
    rules = [
        r
        for r in _rules_of("Student", rules)
        if r.kind in ("domain", "range", "length", "foreign_key") and set(r.columns) <= set(settable)
    ]
    known = Rule("Update", "foreign_key", ("StudentID",), parent="Student", parent_key="StudentID")
    missing = Rule("Update", "not_null", ("StudentID",))
    asked = updates.select("StudentID", *settable, *[c for c in order if c not in ("StudentID", *settable)])
    sound, rejected = _validate(asked, tables, "Student", [missing, known, *rules], order)
    changes = sound.groupBy("StudentID").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ARRIVAL))).alias(f"_new_{c}") for c in settable]
    )
    # Spark measures the changes as they come out of the sum, and broadcasts them if they are small.
    merged = existing.join(changes.withColumn("_hit", F.lit(True)), "StudentID", "left")
    updated = merged.withColumns(
        {c: F.coalesce(F.col(f"_new_{c}").cast(existing.schema[c].dataType), F.col(c)) for c in settable}
    )
    accepted = updated.filter("_hit").select(*existing.columns)
    return Change(updated.select(*existing.columns), accepted, rejected)


def enrol_students(
    tables: Tables,
    batch: DataFrame,
    order_by: Sequence[str],
    rules: Sequence[Rule] | None = None,
) -> Change:
    """Add enrollments, numbering them after the largest key.

    Student and offering must exist; a pair already enrolled, or asked for
    earlier in the batch, is refused.
    """
    existing = tables["Enrollment"]
    key = PRIMARY_KEYS["Enrollment"]
    order = list(order_by)
    rows = _conform(apply_defaults(batch, "Enrollment"), existing, order).drop(key)
    own_rules = [r for r in _rules_of("Enrollment", rules) if key not in r.columns]
    sound, rejected = _validate(rows, tables, "Enrollment", own_rules, order)
    number = next_key(existing, key).scalar() + F.col("_serial") - 1
    numbered = renumber(sound, "_serial", ARRIVAL).withColumn(key, number.cast(existing.schema[key].dataType))
    accepted = numbered.select(*existing.columns)
    return Change(existing.unionByName(accepted), accepted, rejected)
