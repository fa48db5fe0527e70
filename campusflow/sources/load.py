"""Typed reads of the operational files and literal master data."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from campusflow.schema import DEFAULTS, PRIMARY_KEYS, RESULT_COLUMNS, SCHEMAS

# Blank-padded columns of fixed width, trimmed on load.
_PADDED = {"AssessmentResult": ("FinalGrade",)}


# How files are written and read, so that every value comes back as it was.
CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
_NOTHING = "\x00nothing"


def _read(spark: SparkSession, path: str, schema: StructType, file_format: str, line_breaks: bool) -> DataFrame:
    if file_format == "csv":
        reader = spark.read.schema(schema).options(**CSV_OPTIONS)
        # Nothing between two commas is NULL, "" is an empty text: the mark for the first must differ from the second.
        reader = reader.options(nullValue=_NOTHING, emptyValue="")
        return reader.options(enforceSchema=False, mode="FAILFAST", multiLine=line_breaks).csv(path)
    if file_format == "parquet":
        # Parquet gives NULLs for a column that is not there; that is an error as it is for CSV.
        found, expected = sorted(c.lower() for c in spark.read.parquet(path).columns), schema.names
        if found != sorted(c.lower() for c in expected):
            raise ValueError(f"{path} has the columns {found}, not {expected}")
    return spark.read.schema(schema).format(file_format).load(path)


def _number_in_arrival_order(rows: DataFrame, key: str) -> DataFrame:
    """Number rows by file, place of the block in the file, and place of the row in the block.

    Files and blocks are an order already: rows are counted per block, and a
    row's number is the count of all rows before its block plus its place.  So
    rows are neither sorted nor written in between.
    """
    columns = rows.columns
    placed = rows.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    blocks = placed.groupBy("_file", "_block").agg(F.count("*").alias("_rows"), F.min("_row").alias("_first"))
    # One row per block of the files, which is little for one task at any size of the data.
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        "_file", "_block", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
    number = F.col("_start") + F.col("_row") - F.col("_first") + 1
    return placed.join(starts, ["_file", "_block"]).select(number.alias(key), *columns)


def load_table(
    spark: SparkSession,
    directory: str,
    name: str,
    file_format: str = "parquet",
    schema: StructType | None = None,
    omitted: Sequence[str] = (),
    line_breaks: bool = True,
) -> DataFrame:
    """Read ``<directory>/<name>.<format>`` with its declared types.

    A row that does not fit them is an error, and so is a file with other columns.  CSV
    values may hold line breaks; without ``line_breaks`` they may not, and Spark can split
    large CSV files between tasks.  ``omitted`` names columns the
    files lack: the key is then numbered in arrival order, a column with a
    default gets it, and any other is NULL.
    """
    schema = SCHEMAS[name] if schema is None else schema
    given = StructType([field for field in schema if field.name not in omitted])
    rows = _read(spark, f"{directory.rstrip('/')}/{name}.{file_format}", given, file_format, line_breaks)
    if not omitted:
        df = rows
    else:
        key = PRIMARY_KEYS[name]
        df = apply_defaults(_number_in_arrival_order(rows, key) if key in omitted else rows, name)
        df = df.select(
            *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        )
    return df.withColumns({column: F.rtrim(column) for column in _PADDED.get(name, ())})


def load_tables(
    spark: SparkSession,
    directory: str,
    file_format: str = "parquet",
    names: Iterable[str] = tuple(SCHEMAS),
    omitted: Mapping[str, Sequence[str]] | None = None,
    schemas: Mapping[str, StructType] = SCHEMAS,
    line_breaks: bool = True,
) -> dict[str, DataFrame]:
    """Read the named tables; ``omitted`` holds the columns the files of a table lack.

    Give ``line_breaks=False`` for large CSV files whose values have none: Spark then splits them between tasks.
    """
    omitted = omitted or {}
    return {
        name: load_table(spark, directory, name, file_format, schemas[name], omitted.get(name, ()), line_breaks)
        for name in names
    }


def load_literals(spark: SparkSession, rows: Iterable[tuple], schema: StructType) -> DataFrame:
    """Small master data written down as rows; ISO texts become dates where declared.

    The rows travel as Arrow, so Spark knows their size when it plans joins.
    """
    columns = list(zip(*rows)) or [()] * len(schema)
    table = pa.table({field.name: pa.array(list(values)) for field, values in zip(schema, columns)})
    typed = [F.col(field.name).cast(field.dataType).alias(field.name) for field in schema]
    return spark.createDataFrame(table).select(*typed)


def apply_defaults(df: DataFrame, table: str) -> DataFrame:
    """Add omitted columns that have a default; a NULL that is given stays NULL."""
    present = {c.lower() for c in df.columns}
    missing = {c: F.expr(text) for c, text in DEFAULTS.get(table, {}).items() if c.lower() not in present}
    return df.withColumns(missing) if missing else df


def canonical_columns(df: DataFrame) -> DataFrame:
    """Rename columns to their canonical spelling whatever their case; keep unknown names."""
    known = [*(name for schema in SCHEMAS.values() for name in schema.names), *RESULT_COLUMNS]
    spelling = {name.lower(): name for name in known}
    return df.toDF(*[spelling.get(c.lower(), c) for c in df.columns])
