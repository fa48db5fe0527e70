"""Counts and largest keys of stored tables, read from the footers of their Parquet files.

A footer has each row group's number of rows and each column's smallest and largest value, so these figures need no row.
Spark's newer Parquet reader pushes such aggregates down; it is chosen here for these queries alone, in a session of
their own, because the usual one is the better choice for everything else.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campusflow.schema import PRIMARY_KEYS


def footer_session(spark: SparkSession) -> SparkSession:
    """A session over the same cluster that answers counts and extremes from Parquet footers."""
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return session


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def stored_row_counts(spark: SparkSession, directory: str, names: Iterable[str]) -> DataFrame:
    """``TableName`` and ``RowCount`` of tables stored as ``<directory>/<name>.parquet``."""
    session = footer_session(spark)
    counts = {n: session.read.parquet(f"{directory}/{n}.parquet").agg(F.count("*").alias("RowCount")) for n in names}
    # For a table without row groups the reader gives no count, although a count is declared never to be NULL.
    rows = F.greatest(F.lit(0).cast("long"), "RowCount").alias("RowCount")
    return _union(c.select(F.lit(n).alias("TableName"), rows) for n, c in counts.items())


def stored_next_keys(spark: SparkSession, directory: str, names: Iterable[str]) -> DataFrame:
    """``TableName`` and ``NextKey``, the number after the largest key, of stored tables with numbers as keys.

    An empty table starts at 1.
    """
    session = footer_session(spark)
    largest = {n: session.read.parquet(f"{directory}/{n}.parquet").agg(F.max(PRIMARY_KEYS[n]).alias("last")) for n in names}
    next_key = (F.coalesce(F.col("last").cast("long"), F.lit(0)) + 1).alias("NextKey")
    return _union(m.select(F.lit(n).alias("TableName"), next_key) for n, m in largest.items())
