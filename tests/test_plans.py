"""What the physical plans must and must not have."""

import re

import pytest

from larkspur.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
#: Plans that pair rows with one row, not rows with rows.
ONE_ROW = {"indexed_trend", "ratio_to_first"}


def _plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def _ran(df):
    df.collect()
    return _plan(df)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"stream_tumbling_append", "stream_kmeans", "linear_forecast", "gbt_forecast", "model_comparison", "feature_importances", "sgd_forecast", "sgd_convergence", "format_benchmark"}))
def test_no_product_and_no_single_task_window(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert name in ONE_ROW or "BroadcastNestedLoopJoin" not in plan
    python = re.findall(r"\) (?:MapInPandas|ArrowEvalPython|BatchEvalPython|MapInArrow)", plan)
    assert not python or name in {"online_kmeans", "kmeans_snapshots", "cluster_counts", "cluster_characterisation"}


def test_filters_and_columns_reach_the_scan(spark):
    plan = _plan(QUERIES["temporal_cube"](spark, SF))
    assert "GreaterThanOrEqual(ts" in plan and "ReadSchema: struct<ts:timestamp_ntz>" in plan
    plan = _plan(QUERIES["yearly_rollup"](spark, SF))
    assert "GreaterThanOrEqual(o_orderdate" in plan and "ReadSchema: struct<o_orderdate:timestamp_ntz>" in plan


def test_market_queries_scan_once(spark):
    assert "ReusedExchange" in _ran(QUERIES["monthly_combined"](spark, SF))


def test_top_k_is_not_a_sort(spark):
    assert "TakeOrderedAndProject" in _plan(QUERIES["top10_pickup_zones"](spark, SF))


def test_roles_that_nobody_asks_for_are_not_joined(spark):
    assert "customer.parquet" not in _plan(QUERIES["zone_counts"](spark, SF))
    assert "supplier.parquet" not in _plan(QUERIES["quality_by_year"](spark, SF))
