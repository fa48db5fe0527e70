"""Tables stored in partitions by a hash of their key, of which a change rewrites only those that it touches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITION = "_part"
# Tasks that may share a partition, so that a task's rows do not grow with the partition's.
PIECES = 32


def _dealt(df: DataFrame, key: str, parts: int) -> DataFrame:
    return df.withColumn(PARTITION, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts)).cast("int"))


def _spread(dealt: DataFrame, key: str) -> DataFrame:
    """The dealt rows in tasks of a piece of a partition each; Spark merges small pieces again."""
    return dealt.repartition(PARTITION, F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(PIECES)), F.lit(PIECES)))


def save_partitioned(df: DataFrame, folder: str, key: str, parts: int) -> None:
    """Write a table into a new folder, dealt by a hash of ``key`` into ``parts`` partitions.

    Choose ``parts`` so that one holds some hundred megabytes.  The key is meant to be unique, so no partition
    can fill up with one value.
    """
    dealt = _spread(_dealt(df, key, parts), key)
    dealt.write.partitionBy(PARTITION).mode("errorifexists").parquet(folder)


def read_partitioned(spark: SparkSession, folder: str) -> DataFrame:
    """The table, without the partition number."""
    return spark.read.parquet(folder).drop(PARTITION)


def rewrite_changed(spark: SparkSession, folder: str, rows: DataFrame, key: str, parts: int) -> list[int]:
    """Put ``rows`` in the place of the stored rows with the same keys, or add them where there are none.

    Only partitions that hold one of the keys are read and written; the files of all others stay as they are.
    New files are in place before the old ones go, partition by partition, when the write commits.  ``rows``
    must not repeat a key and must have the table's columns; it is read twice.  Returns the rewritten partitions.
    """
    stored = spark.read.parquet(folder)
    columns = [c for c in stored.columns if c != PARTITION]
    changed = _dealt(rows.select(*[F.col(c).cast(stored.schema[c].dataType).alias(c) for c in columns]), key, parts)
    touched = sorted(r[0] for r in changed.select(PARTITION).distinct().collect())  # at most ``parts`` numbers
    if not touched:
        return []
    kept = stored.filter(F.col(PARTITION).isin(touched)).join(changed.select(key), key, "left_anti")
    whole = _spread(kept.select(*columns, PARTITION).unionByName(changed), key)
    whole.write.partitionBy(PARTITION).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)
    return touched


def stored_rows(spark: SparkSession, folder: str, keys: DataFrame, key: str, parts: int) -> DataFrame:
    """The stored rows with one of the keys, read from the partitions that can hold them."""
    asked = _dealt(keys.select(key).distinct(), key, parts)
    touched = sorted(r[0] for r in asked.select(PARTITION).distinct().collect())
    stored = spark.read.parquet(folder).filter(F.col(PARTITION).isin(touched) if touched else F.lit(False))
    return stored.drop(PARTITION).join(asked.select(key), key, "left_semi")


def partition_files(spark: SparkSession, folder: str) -> Sequence[str]:
    """The names of the table's files."""
    return sorted(r[0] for r in spark.read.parquet(folder).select(F.input_file_name()).distinct().collect())
