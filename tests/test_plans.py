"""What the plans must and must not contain."""

from __future__ import annotations

import re

import pytest

from campusflow.operators import quality
from campusflow.operators.filters import students_with_programme
from campusflow.plans import engagement, finance, marks, overview
from campusflow.sources import catalog, footers
from campusflow.sources.layout import save_bucketed
from testbed.registry import CHOSEN, EVERYONE, QUERIES
from testbed.views import RecordTables
from testbed.views import testbed_rules as all_rules

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def records(spark):
    return RecordTables(spark, SF_DIR)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are when every table is too large to broadcast."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def global_windows(text: str) -> list[str]:
    """Windows without a partition; sums over the few counts of buckets may be."""
    found = [line for line in text.splitlines() if re.search(r"\bWindow \[", line)]
    return [line for line in found if "], [" in line and line.count("], [") < 2 and ", [_bucket#" not in line]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_no_cross_join_no_global_window(records, name, no_broadcast):
    text = plan(QUERIES[name](records))
    for forbidden in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin", "CollectLimit"):
        assert forbidden not in text, f"{name} has {forbidden}"
    assert not global_windows(text), name


def test_no_broadcast_without_a_size_check(records, no_broadcast):
    for name in QUERIES:
        assert "BroadcastHashJoin" not in plan(QUERIES[name](records)), name


def test_filter_reaches_the_scan(records):
    text = plan(students_with_programme(records, CHOSEN).select("StudentID"))
    scan = next(line for line in text.splitlines() if "c_mktsegment" in line and "FileScan" in line)
    assert "In(c_mktsegment, [BUILDING,FURNITURE,MACHINERY])" in scan
    assert re.search(r"In\(n_name, \[[^\]]*NATION_1", text)


def test_scans_read_only_needed_columns(records):
    text = plan(finance.total_revenue(records))
    assert "ReadSchema: struct<o_totalprice:double>" in text
    text = plan(marks.programme_totals(records))
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int>" in text


@pytest.mark.parametrize(
    "query",
    [engagement.top_engagement, engagement.engagement_q3, finance.outstanding_q4, marks.credit_load],
    ids=lambda q: q.__name__,
)
def test_limits_after_a_sort_keep_only_the_top_rows(records, query):
    assert "TakeOrderedAndProject" in plan(query(records))


@pytest.mark.parametrize(
    "query", [engagement.top_engagement, finance.outstanding_q4, marks.credit_load], ids=lambda q: q.__name__
)
def test_names_are_joined_to_the_top_rows_only(records, query, no_broadcast):
    """Names come from a scan whose join lies above the inner limit."""
    lines = plan(query(records)).splitlines()
    limits = [i for i, line in enumerate(lines) if "TakeOrderedAndProject" in line]
    names = [i for i, line in enumerate(lines) if "FileScan" in line and "c_name" in line]
    assert len(limits) == 2 and len(names) == 1
    depth = [re.search(r"[A-Za-z*]", line).start() for line in lines]
    # Nothing between the inner limit and its end reads a name.
    end = next((i for i in range(limits[1] + 1, len(lines)) if depth[i] <= depth[limits[1]]), len(lines))
    assert not limits[1] < names[0] < end


def joins_over(text: str, key: str) -> list[str]:
    return [line for line in text.splitlines() if "SortMergeJoin" in line and key in line]


def test_facts_are_aggregated_before_they_meet_students(records, no_broadcast):
    """Below the join with students every fact is already a HashAggregate result."""
    for df in (
        finance.outstanding_worklist(records, EVERYONE),
        marks.programme_marks(records, EVERYONE),
        marks.credit_load(records),
        overview.kpi_row(records, EVERYONE),
    ):
        lines = plan(df).splitlines()
        at = next(i for i, line in enumerate(lines) if "SortMergeJoin [StudentID" in line)
        depth = lines[at].index("SortMergeJoin")
        below = []
        for line in lines[at + 1 :]:
            if re.search(r"\w", line) and len(line) - len(line.lstrip(" :+-")) <= depth:
                break
            below.append(line)
        assert any("HashAggregate(keys=[StudentID" in line for line in below)


def test_chosen_students_narrow_activity_below_its_sum(records, no_broadcast):
    """Events, results and payments of other students are left out before anything is summed."""

    def below_sum(text: str, column: str) -> bool:
        lines = text.splitlines()
        scan = next(i for i, line in enumerate(lines) if "FileScan" in line and column in line)
        depth, joined = len(lines[scan]) - len(lines[scan].lstrip(" :+-")), False
        for line in reversed(lines[:scan]):
            at = len(line) - len(line.lstrip(" :+-"))
            if at >= depth:
                continue
            depth = at
            if "HashAggregate(keys=[" in line:
                return joined
            joined = joined or "LeftSemi" in line or "SortMergeJoin [EnrollmentID" in line
        return False

    assert below_sum(plan(engagement.top_engagement(records, CHOSEN)), "event_id")
    assert below_sum(plan(finance.outstanding_worklist(records, CHOSEN)), "o_totalprice")
    assert "LeftSemi" not in plan(finance.outstanding_worklist(records))


def test_references_to_one_parent_are_one_join(records, no_broadcast):
    rules = [r for r in all_rules() if r.kind == "foreign_key"]
    parents = {(r.parent, r.parent_key) for r in rules}
    text = plan(quality.check_foreign_key(records, rules))
    joins = [line for line in text.splitlines() if "SortMergeJoin [_value" in line]
    assert len(rules) == 13 and len(parents) == 8 and len(joins) == 8


def test_second_sum_of_engagement_needs_no_shuffle(records, no_broadcast):
    lines = plan(engagement.engagement_outcome(records, EVERYONE)).splitlines()
    final = next(i for i, line in enumerate(lines) if "HashAggregate(keys=[StudentID" in line and "FinalGrade" in line)
    until_join = []
    for line in lines[final + 1 :]:
        if "SortMergeJoin" in line:
            break
        until_join.append(line)
    assert not any("Exchange" in line for line in until_join)


def test_activity_is_shuffled_once(records, no_broadcast):
    text = plan(engagement.engagement_outcome(records, EVERYONE))
    events = [line for line in text.splitlines() if "FileScan" in line and "event_id" in line]
    assert len(events) == 1
    above = text[: text.index(events[0])].splitlines()
    depth = len(events[0]) - len(events[0].lstrip(" :+-"))
    exchanges = 0
    for line in reversed(above):
        at = len(line) - len(line.lstrip(" :+-"))
        if at >= depth:
            continue
        depth = at
        if "Join" in line:
            break
        exchanges += "Exchange" in line
    assert exchanges == 1


def test_count_of_all_events_reads_no_column(records):
    assert "ReadSchema: struct<>" in plan(catalog.table_shape(records["LMSActivity"]))


def test_bucketed_tables_join_without_a_shuffle(spark, tables, no_broadcast):
    stored = ["Student", "Programme", "Enrollment", "AssessmentResult"]
    save_bucketed({name: tables[name] for name in stored}, buckets=4, prefix="stored_")
    kept = {name: spark.table("stored_" + name) for name in stored}
    joined = kept["AssessmentResult"].join(kept["Enrollment"], "EnrollmentID")
    assert "Exchange" not in plan(joined) and joined.count() == 7
    got = marks.programme_marks(kept)
    assert got.collect() == marks.programme_marks(tables).collect()


def test_footers_answer_counts_and_largest_keys(spark, make, tmp_path):
    rows = [(n, 1, f"C{n}", "t", 3) for n in (4, 9, 2)]
    make("Course", rows).write.parquet(str(tmp_path / "Course.parquet"))
    make("Programme", []).write.parquet(str(tmp_path / "Programme.parquet"))
    counts = footers.stored_row_counts(spark, str(tmp_path), ["Course", "Programme"])
    keys = footers.stored_next_keys(spark, str(tmp_path), ["Course", "Programme"])
    assert {tuple(r) for r in counts.collect()} == {("Course", 3), ("Programme", 0)}
    assert {tuple(r) for r in keys.collect()} == {("Course", 10), ("Programme", 1)}
    assert "PushedAggregation: [COUNT(*)]" in plan(counts)
    assert "PushedAggregation: [MAX(CourseID)]" in plan(keys)
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
