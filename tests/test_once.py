"""Batches and tables are read once where several steps need them, and tasks stay small."""

from __future__ import annotations

import pytest

from campusflow.operators import maintained
from campusflow.operators.keycounts import KeyCounts
from campusflow.schema import contract_rules
from campusflow.session import SETTINGS
from campusflow.sources import partitions


@pytest.fixture
def watched(spark):
    """The rows of a frame, and a counter of how many were read so far."""

    def build(df):
        read = spark.sparkContext.accumulator(0)

        def count(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        return df.mapInArrow(count, df.schema), read

    return build


def test_a_batch_is_looked_up_once(spark, tables, watched, tmp_path):
    rules = [r for r in contract_rules() if r.table in tables and (not r.parent or r.parent in tables)]
    counts = KeyCounts.create(spark, tables, rules, str(tmp_path / "counts"), parts=4)
    batch, read = watched(tables["Student"])
    found = counts._looked_up({"Student": batch})
    before = read.value
    assert found.count() > 0 and found.collect()
    assert before > 0 and read.value == before


def test_sums_per_student_are_made_once(tables, watched):
    students, read = watched(tables["Student"])
    states = maintained.summarise(tables | {"Student": students})
    before = read.value
    states["people"].collect()
    states["cube"].collect()
    assert before > 0 and read.value == before


def test_what_enrollments_add_is_read_once(tables, watched):
    states = maintained.summarise(tables)
    enrollments, read = watched(tables["Enrollment"])
    changes = maintained.enrolled(states, enrollments)
    before = read.value
    changes["people"].collect()
    changes["cube"].collect()
    assert before == tables["Enrollment"].count() and read.value == before


def test_merged_partitions_stay_small(spark):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    assert spark.conf.get(name) == SETTINGS[name] and int(SETTINGS[name].removesuffix("MB")) <= 16


def test_several_tasks_write_a_large_partition(spark, tmp_path):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        rows = spark.range(2000).withColumnRenamed("id", "k")
        partitions.save_partitioned(rows, str(tmp_path / "t"), "k", 1)
    finally:
        spark.conf.set(name, "true")
    assert len(partitions.partition_files(spark, str(tmp_path / "t"))) > 1
    assert partitions.read_partitioned(spark, str(tmp_path / "t")).distinct().count() == 2000
