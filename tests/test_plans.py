"""Plan properties that must hold for every registered query (scale guards)."""

import re

import pytest

from conftest import SF_SMALL
from ledgerline import registry

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "MapInPandas", "FlatMapGroupsInPandas"]
_plans = {}


def final_plan(spark, key):
    if key not in _plans:
        spark.conf.set("spark.sql.maxMetadataStringLength", "4000")   # untruncated filter lists
        df = registry.QUERIES[key](spark, SF_SMALL)
        df.collect()
        _plans[key] = df._jdf.queryExecution().executedPlan().toString()
    return _plans[key]


@pytest.mark.parametrize("key", sorted(registry.QUERIES))
def test_no_cartesian_nested_loop_or_python(spark, key):
    plan = final_plan(spark, key)
    assert [f for f in FORBIDDEN if f in plan] == []


@pytest.mark.parametrize("key,table,pushed", [
    ("portfolio_day_stats", "events", ["GreaterThanOrEqual(ts,2024-01-15", "LessThan(ts,2024-01-16"]),
    ("asset_price_summary", "events", ["GreaterThanOrEqual(ts,2024-01-15", "LessThan(ts,2024-01-16"]),
    ("user_cashflow", "events", ["EqualTo(event_type,purchase)", "GreaterThanOrEqual(ts,2024-01-15"]),
    ("budget_performance", "orders", ["GreaterThanOrEqual(o_orderdate,1998-06-01", "LessThan(o_orderdate,1998-06-16"]),
    ("asset_holdings_asof", "lineitem", ["LessThan(l_shipdate,1998-06-16"]),
    ("filter_on_day", "events", ["GreaterThanOrEqual(ts,2024-01-15", "LessThan(ts,2024-01-16"]),
])
def test_day_filters_reach_the_scan(spark, key, table, pushed):
    plan = final_plan(spark, key)
    scans = [line for line in plan.split("\n") if "FileScan" in line and f"{table}.parquet" in line]
    assert scans, plan
    assert any(all(p in s for p in pushed) for s in scans), scans


@pytest.mark.parametrize("key,table,columns", [
    ("asset_holdings_asof", "lineitem", {"l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate"}),
    ("portfolio_day_stats", "events", {"user_id", "ts", "value"}),
    ("compaction_plan", "documents", {"source", "n_chars"}),
])
def test_scans_read_only_needed_columns(spark, key, table, columns):
    plan = final_plan(spark, key)
    schemas = [re.search(r"ReadSchema: struct<([^>]*)>", line).group(1)
               for line in plan.split("\n") if "FileScan" in line and f"{table}.parquet" in line]
    read = [{c.split(":")[0] for c in s.split(",")} for s in schemas]
    assert read and all(r <= columns for r in read), read


@pytest.mark.parametrize("key", ["asset_holdings_asof", "portfolio_day_stats", "user_cashflow",
                                 "budget_performance", "asset_price_summary", "goal_progress",
                                 "access_matrix", "snapshot_retention", "orphan_files"])
def test_work_runs_in_whole_stage_codegen(spark, key):
    plan = final_plan(spark, key)
    codegen = re.findall(r"\*\(\d+\) (\w+)", plan)
    # scans, filters, projections, hash aggregates and joins are compiled stages
    assert {"ColumnarToRow", "Project"} & set(codegen) or "HashAggregate" in codegen, codegen
    assert any(op in codegen for op in ("HashAggregate", "BroadcastHashJoin", "SortMergeJoin", "Project"))
