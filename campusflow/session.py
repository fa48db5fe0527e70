"""Session settings the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# A broadcast needs a size checked against the threshold; anything larger, or
# of unknown size, is shuffled.  AQE re-checks with real sizes, merges small
# partitions and splits skewed ones, also below a later aggregation.  A join
# whose measured partitions are all small is hashed instead of sorted.  Merged
# partitions stay small, as a task that sums numbers per key needs some twenty
# times the memory of what it reads.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8MB",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "32MB",
    "spark.sql.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.runSQLOnFiles": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    """The builder with the library's settings; masters, memory and partitions stay the caller's."""
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder


def tune(spark: SparkSession) -> SparkSession:
    """Give a running session those of the settings that can change while it runs."""
    for name, value in SETTINGS.items():
        if name.startswith("spark.sql."):
            spark.conf.set(name, value)
    return spark
