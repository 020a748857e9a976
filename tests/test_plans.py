"""Plan checks: no window without a partition key runs over fact-sized input
(that would move a whole table into one task).  Unpartitioned windows are
allowed only over dimensions bounded by construction."""

import pytest

from ledgerlens.registry import registry
from ledgerlens.sources.tables import BankTables
from ledgerlens.sources.testdata import MAPPINGS
from paths import SF_SMALL

def _over_slices(node):
    while node.children().size() == 1 and node.getClass().getSimpleName() != "Aggregate":
        node = node.children().head()
    keys = node.groupingExpressions() if node.getClass().getSimpleName() == "Aggregate" else None
    return keys is not None and keys.size() == 1 and keys.head().toString().startswith("__slice#")


def _unpartitioned_windows(df):
    """Window nodes of the optimized plan whose partition spec is empty, but for
    those over a table's slice counts (``sequence.scan``: one row a slice)."""
    found, stack = [], [df._jdf.queryExecution().optimizedPlan()]
    while stack:
        node = stack.pop()
        if node.getClass().getSimpleName() == "Window" and node.partitionSpec().size() == 0 and not _over_slices(node):
            found.append(node.simpleString(200))
        kids = node.children()
        stack.extend(kids.apply(i) for i in range(kids.size()))
    return found


@pytest.mark.parametrize("name", sorted(registry()))
def test_no_single_task_window(spark, name):
    df = registry()[name].build(BankTables.from_testdata(spark, SF_SMALL))
    found = _unpartitioned_windows(df)
    assert not found, f"{name}: unpartitioned window over unbounded input: {found[:1]}"


def test_detector_sees_a_global_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    df = spark.range(10).withColumn("s", F.sum("id").over(Window.partitionBy()))
    assert _unpartitioned_windows(df)


def test_grand_total_uses_broadcast_one_row(spark):
    df = registry()["account_aging"].build(BankTables.from_testdata(spark, SF_SMALL))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" in plan or "BroadcastHashJoin" in plan


@pytest.fixture(scope="module")
def tables(spark):
    mapped = BankTables.from_testdata(spark, SF_SMALL)
    return BankTables.from_frames(**{name: mapped[name] for name in MAPPINGS})  # footers are read here


@pytest.mark.parametrize("name", sorted(registry()))
def test_building_runs_no_job(spark, tables, name):
    group = "building-" + name
    spark.sparkContext.setJobGroup(group, name)
    try:
        registry()[name].build(tables)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not list(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
