"""A stored layout in which the large one-to-one join needs no shuffle."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

# Only keys the contract declares unique: no bucket can fill up with one value.
BUCKET_KEYS = {"Student": "StudentID", "Enrollment": "EnrollmentID", "AssessmentResult": "EnrollmentID"}


def save_bucketed(tables: Mapping[str, DataFrame], buckets: int, prefix: str = "") -> None:
    """Save the tables under their names, the largest ones bucketed and sorted by their join key.

    Choose ``buckets`` so that one holds some hundred megabytes.
    """
    for name in tables:
        writer = tables[name].write.format("parquet").mode("errorifexists")
        key = BUCKET_KEYS.get(name)
        if key is not None:
            writer = writer.bucketBy(buckets, key).sortBy(key)
        writer.saveAsTable(prefix + name)
