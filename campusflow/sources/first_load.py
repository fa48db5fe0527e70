"""The first load: operational files to a checked, typed snapshot."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from campusflow.operators.quality import check_rules
from campusflow.schema import SCHEMAS, contract_rules
from campusflow.sources.catalog import write_snapshot
from campusflow.sources.load import load_tables


def first_load(
    spark: SparkSession,
    source: str,
    target: str,
    file_format: str = "csv",
    names: Iterable[str] = tuple(SCHEMAS),
    omitted: Mapping[str, Sequence[str]] | None = None,
    line_breaks: bool = True,
) -> DataFrame:
    """Load files, fill keys and defaults, write parquet, and report what breaks the contract.

    Nothing is dropped or repaired: rows that break a rule are written and
    counted in the report.  References to tables that are not loaded are not
    checked.  ``line_breaks`` is as for ``load_tables``.
    """
    names = list(names)
    for name, df in load_tables(spark, source, file_format, names, omitted, line_breaks=line_breaks).items():
        write_snapshot(df, f"{target.rstrip('/')}/{name}.parquet")
    rules = [r for r in contract_rules() if r.table in names and (not r.parent or r.parent in names)]
    return check_rules(load_tables(spark, target, "parquet", names), rules)
