"""Plan-level scale guards: no pair-producing joins anywhere, top-k merges are
partially applied before the shuffle, scans read only the needed columns."""

import pytest

import __spark_entry__ as E
from labelrank.plans.registry import QUERIES, load_all

load_all()

SF = "/root/testdata/sf0.001"
KEYS = sorted(QUERIES)


def plan_of(spark, key):
    df = E.queries()[key](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", KEYS)
def test_no_cross_products(spark, key):
    plan = plan_of(spark, key)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_search_merge_is_partial_topk_and_pruned(spark):
    plan = plan_of(spark, "retrieve")
    assert "WindowGroupLimit" in plan and ", Partial" in plan
    assert "FileScan parquet [vec_id" in plan and "label" not in plan.split("FileScan")[1].split("]")[0]
