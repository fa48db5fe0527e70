"""Constraint checks as aggregations.

Every check gives ``RuleID, TableName, Kind, Columns, Violations``.  NULL follows
the SQL standard: it passes value rules, references and unique constraints, and
fails only NOT NULL and primary keys.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from campusflow.functions import count_where
from campusflow.schema import BROWSED_TABLES, Rule, contract_rules
from campusflow.sources.load import load_literals

ROW_KINDS = ("not_null", "domain", "range", "length")
_DESCRIPTION = StructType(
    [StructField("RuleNo", IntegerType())]
    + [StructField(name, StringType()) for name in ("RuleID", "TableName", "Kind", "Columns")]
)


def row_violation(rule: Rule) -> Column:
    """True where a row breaks a rule that one row alone can break."""
    if rule.kind == "not_null":
        return F.col(rule.columns[0]).isNull()
    if rule.kind == "domain":
        return ~F.col(rule.columns[0]).isin(list(rule.allowed))
    if rule.kind == "range":
        return ~F.expr(rule.condition)
    if rule.kind == "length":
        return F.length(rule.columns[0]) > rule.width
    raise ValueError(f"{rule.kind} is not a row rule")


def _found(number: int, violations: Column) -> Column:
    return F.struct(F.lit(number).alias("RuleNo"), violations.alias("v"))


def _row_violations(df: DataFrame, rules: dict[int, Rule]) -> DataFrame:
    """All row rules of one table in one scan, turned into one row per rule."""
    counts = df.agg(*[count_where(row_violation(rule)).alias(f"v{i}") for i, rule in rules.items()])
    return counts.select(F.inline(F.array(*[_found(i, F.col(f"v{i}")) for i in rules])))


def _value_counts(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows per distinct key without a NULL; ``n`` is the count.

    A column that is both unique and a reference gives the same plan in both
    checks, so Spark shuffles it once.
    """
    keyed = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return df.filter(keyed).groupBy(*columns).agg(F.count("*").alias("n"))


def _key_violations(df: DataFrame, number: int, rule: Rule) -> DataFrame:
    """Rows beyond the first of their key; for a primary key, rows without a key too."""
    if rule.kind == "unique":
        extra = _value_counts(df, rule.columns).select((F.col("n") - 1).alias("v"))
    else:
        key = rule.columns[0]
        counted = df.groupBy(key).agg(F.count("*").alias("n"))
        extra = counted.select(F.when(F.col(key).isNull(), F.col("n")).otherwise(F.col("n") - 1).alias("v"))
    return extra.filter("v > 0").select(F.lit(number).alias("RuleNo"), "v")


def _dangling_keys(tables: Mapping[str, DataFrame], rule: Rule) -> DataFrame:
    """Referencing values without a parent, with their row counts ``n``.

    References are counted per value first, so a value held by very many rows
    reaches the join as one row.
    """
    column = rule.columns[0]
    parents = tables[rule.parent].select(F.col(rule.parent_key).alias(column))
    return _value_counts(tables[rule.table], [column]).join(parents, column, "left_anti")


def _dangling_counts(tables: Mapping[str, DataFrame], rules: dict[int, Rule]) -> DataFrame:
    """Rows with values that a parent table lacks, for all rules that refer to one column of it.

    The values of all referring columns, counted each, meet the parent in one
    join, so it is read and shuffled once however many tables refer to it.  An
    anti join would be moved below the union again, one for each rule.
    """
    first = next(iter(rules.values()))
    parents = tables[first.parent].select(F.col(first.parent_key).alias("_value")).distinct()
    kind = parents.schema["_value"].dataType
    counted = [
        _value_counts(tables[r.table], r.columns).select(
            F.col(r.columns[0]).cast(kind).alias("_value"), F.lit(i).alias("RuleNo"), F.col("n").alias("v")
        )
        for i, r in rules.items()
    ]
    met = reduce(DataFrame.unionByName, counted).join(parents.withColumn("_known", F.lit(True)), "_value", "left")
    return met.filter(F.col("_known").isNull()).select("RuleNo", "v")


def check_rules(tables: Mapping[str, DataFrame], rules: Iterable[Rule] | None = None) -> DataFrame:
    """Violation counts of all given rules (the whole contract by default).

    What each check finds is added up in one final aggregation over all of
    them; rules nobody broke are filled in from the rule list.
    """
    numbered = dict(enumerate(contract_rules() if rules is None else rules))
    row_rules: dict[str, dict[int, Rule]] = {}
    references: dict[tuple[str, str], dict[int, Rule]] = {}
    found = []
    for i, rule in numbered.items():
        if rule.kind in ROW_KINDS:
            row_rules.setdefault(rule.table, {})[i] = rule
        elif rule.kind == "foreign_key":
            references.setdefault((rule.parent, rule.parent_key), {})[i] = rule
        else:
            found.append(_key_violations(tables[rule.table], i, rule))
    found += [_row_violations(tables[name], group) for name, group in row_rules.items()]
    found += [_dangling_counts(tables, group) for group in references.values()]
    totals = reduce(DataFrame.unionByName, found).groupBy("RuleNo").agg(F.sum("v").alias("Violations"))
    described = load_literals(
        found[0].sparkSession,
        [(i, r.rule_id, r.table, r.kind, "+".join(r.columns)) for i, r in numbered.items()],
        _DESCRIPTION,
    )
    return described.join(totals, "RuleNo", "left").drop("RuleNo").na.fill(0, ["Violations"])


def _of_kind(rules: Iterable[Rule] | None, *kinds: str) -> list[Rule]:
    return [r for r in (contract_rules() if rules is None else rules) if r.kind in kinds]


def check_not_null(tables: Mapping[str, DataFrame], rules: Iterable[Rule] | None = None) -> DataFrame:
    return check_rules(tables, _of_kind(rules, "not_null"))


def check_unique(tables: Mapping[str, DataFrame], rules: Iterable[Rule] | None = None) -> DataFrame:
    return check_rules(tables, _of_kind(rules, "primary_key", "unique"))


def check_foreign_key(tables: Mapping[str, DataFrame], rules: Iterable[Rule] | None = None) -> DataFrame:
    return check_rules(tables, _of_kind(rules, "foreign_key"))


def check_domain(tables: Mapping[str, DataFrame], rules: Iterable[Rule] | None = None) -> DataFrame:
    return check_rules(tables, _of_kind(rules, "domain"))


def check_range(tables: Mapping[str, DataFrame], rules: Iterable[Rule] | None = None) -> DataFrame:
    return check_rules(tables, _of_kind(rules, "range"))


def check_length(tables: Mapping[str, DataFrame], rules: Iterable[Rule] | None = None) -> DataFrame:
    return check_rules(tables, _of_kind(rules, "length"))


def failing_rows(tables: Mapping[str, DataFrame], rule: Rule) -> DataFrame:
    """The rows a rule reports; for keys, every row whose key is repeated or missing."""
    df = tables[rule.table]
    if rule.kind in ROW_KINDS:
        return df.filter(row_violation(rule))
    columns = list(rule.columns)
    if rule.kind == "foreign_key":
        return df.join(_dangling_keys(tables, rule), columns, "left_semi")
    repeated = _value_counts(df, columns).filter("n > 1")
    rows = df.join(repeated, columns, "left_semi")
    if rule.kind == "primary_key":
        rows = rows.unionByName(df.filter(F.col(columns[0]).isNull()))
    return rows


def orphan_enrollments(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Enrollments whose student does not exist (or is not given)."""
    students = tables["Student"].select("StudentID")
    return tables["Enrollment"].join(students, "StudentID", "left_anti")


def orphan_results(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Assessment results whose enrollment does not exist (or is not given)."""
    enrollments = tables["Enrollment"].select("EnrollmentID")
    return tables["AssessmentResult"].join(enrollments, "EnrollmentID", "left_anti")


def row_count_summary(tables: Mapping[str, DataFrame], names: Iterable[str] = BROWSED_TABLES) -> DataFrame:
    """Row count per table, one branch of a UNION ALL each."""
    counts = [
        tables[name].agg(F.count("*").alias("RowCount")).select(F.lit(name).alias("TableName"), "RowCount")
        for name in names
    ]
    return reduce(DataFrame.unionByName, counts)
