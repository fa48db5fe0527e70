"""Serial keys: numbering rows 1..n in an explicit order, and resuming after the maximum."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# Rows that one task numbers.
BUCKET_ROWS = 1_000_000
# Buckets whose bounds and counts the driver holds; beyond them buckets grow and their sort spills.
MOST_BUCKETS = 2_000
# Rows looked at for each bound between buckets.
ROWS_A_BOUND = 48


def _bounds(placed: DataFrame, buckets: int, rows: int) -> DataFrame:
    """One row: the lowest places of all buckets but the first, which are about equally large.

    Places are taken by a hash of their content, so the same rows give the same bounds however they arrive.
    """
    wanted = min(rows, buckets * ROWS_A_BOUND)
    scale = 1 << 30
    some = placed.select("_place").filter(F.pmod(F.xxhash64("_place"), F.lit(scale)) <= scale * wanted // rows).distinct()
    found = some.orderBy("_place").collect()
    chosen = found[ROWS_A_BOUND::ROWS_A_BOUND]
    local = placed.sparkSession.createDataFrame(chosen, placed.select("_place").schema)
    return local.agg(F.array_sort(F.collect_list("_place")).alias("bounds"))


def _bucket(place: Column, bounds: Column, buckets: int) -> Column:
    """How many bounds lie at or below the place, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, buckets.bit_length())))])

    def step(low: Column, width: Column) -> Column:
        return F.when(F.coalesce(F.get(bounds, low + width - 1) <= place, F.lit(False)), low + width).otherwise(low)

    return F.aggregate(steps, F.lit(0), step)


def assign_serial(
    df: DataFrame,
    key: str,
    order_by: Sequence[str | Column],
    first: int | Column = 1,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Number the rows consecutively from ``first`` in ``order_by`` order; NULL comes last.

    Rows are dealt to buckets of about ``bucket_rows`` by their place: the order values, then a hash of all
    columns.  A row's number is the count of all rows in the buckets before its own, which are few sums, plus
    its rank inside the bucket.  So nothing is written in between, and the numbers depend on the rows alone,
    not on how they arrive or on the buckets.  A hot order value is spread over buckets by the hash.  Only rows
    equal in every column share a place: if they overfill a bucket, its equal rows are counted, numbered as one
    and multiplied again.

    The input is read for its size, for the bounds and the bucket sizes if there is more than one bucket, and
    for the result, so it must give the same rows each time.
    """
    columns = df.columns
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    parts = [part for i, c in enumerate(order) for part in (c.isNull().alias(f"none{i}"), c.alias(f"value{i}"))]
    placed = df.select("*", F.struct(*parts, F.xxhash64(*columns).alias("content")).alias("_place"))
    start = F.lit(first) if isinstance(first, int) else first
    rows = df.count()
    buckets = min(MOST_BUCKETS, math.ceil(rows / bucket_rows))
    if buckets <= 1:
        # Few enough for one task, by the count just made.
        return _ranked(placed.withColumn("_bucket", F.pmod(F.xxhash64("_place"), F.lit(1))), key, start, columns)

    bounds = _bounds(placed, buckets, rows).scalar()
    dealt = placed.withColumn("_bounds", bounds).withColumn("_bucket", _bucket(F.col("_place"), F.col("_bounds"), buckets)).drop("_bounds")
    sizes = {r["_bucket"]: r["count"] for r in dealt.groupBy("_bucket").count().collect()}
    held = [sizes.get(b, 0) for b in range(max(sizes) + 1)]
    starts = F.get(F.lit([0, *accumulate(held)]), "_bucket")
    large = [b for b, n in sizes.items() if n > 4 * max(bucket_rows, rows // buckets)]
    usual = _ranked(dealt.filter(~F.col("_bucket").isin(large)), key, start + starts, columns)
    if not large:
        return usual
    equal = dealt.filter(F.col("_bucket").isin(large)).groupBy("_bucket", "_place", *columns).agg(F.count("*").alias("_copies"))
    before = Window.partitionBy("_bucket").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    counted = equal.withColumn("_from", starts + F.coalesce(F.sum("_copies").over(before), F.lit(0)))
    # Copies are multiplied in pieces of a bucket's size, dealt anew.
    last, step = F.col("_from") + F.col("_copies") - 1, F.lit(bucket_rows).cast("long")
    pieces = counted.select(*columns, last.alias("_last"), F.explode(F.sequence(F.col("_from"), last, step)).alias("_piece"))
    numbers = F.sequence("_piece", F.least("_last", F.col("_piece") + step - 1))
    spread = pieces.repartition("_piece").select(*columns, F.explode(numbers).alias("_number"))
    return usual.unionByName(spread.select((start + F.col("_number")).alias(key), *columns))


def _ranked(dealt: DataFrame, key: str, start: Column, columns: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_place"))
    return dealt.withColumn("_rank", rank).select((start + F.col("_rank") - 1).cast("long").alias(key), *columns)


def renumber(df: DataFrame, key: str, number: str, within: Sequence[str] = (), bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Number the rows 1..n, per value of ``within``, in the order of a column ``number`` that numbers them already.

    The old numbers are places enough: rows are dealt by them, buckets are counted, and a row's number is the
    count before its bucket plus its rank inside it.  A value of ``within`` that has most rows fills many buckets.
    """
    by = [*within, "_bucket"]
    dealt = df.withColumn("_bucket", F.floor(F.col(number) / bucket_rows))
    before = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row per value and bucket.
    starts = dealt.groupBy(*by).agg(F.count("*").alias("_rows"))
    starts = starts.select(*by, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(number))
    numbered = dealt.withColumn("_rank", rank).join(starts, by)
    return numbered.select((F.col("_start") + F.col("_rank")).alias(key), *df.columns)


def next_key(df: DataFrame, key: str) -> DataFrame:
    """One row, one column: the number after the largest key (1 for an empty table)."""
    return df.agg((F.coalesce(F.max(key).cast(T.LongType()), F.lit(0)) + 1).alias("NextKey"))


def append_serial(
    existing: DataFrame, batch: DataFrame, key: str, order_by: Sequence[str | Column]
) -> DataFrame:
    """The batch with keys that continue the numbering of ``existing``."""
    first = next_key(existing, key).scalar()
    numbered = assign_serial(batch, key, order_by, first=first)
    return numbered.withColumn(key, F.col(key).cast(existing.schema[key].dataType))
