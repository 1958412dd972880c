"""Shape of the physical plans: what would not survive large tables must not appear."""

from __future__ import annotations

import re

import pytest

from lunario.workload import derive
from lunario.workload.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
#: Queries whose branches must share one pass over each fact table.
ONE_SCAN = {
    "k1_macro_panel": 2,
    "k2_bank_spread": 1,
    "k3_real_lending_rate": 1,
    "k4_us_inflation": 1,
    "k6_crawl_gap": 1,
    "k10_reserve_coverage": 2,
    "k11_rate_parity": 1,
    "k19_relative_inflation_gap": 1,
    "d1_spine_join": 1,
    "d5_deflator_left": 1,
    "f3_yoy_calendar": 1,
    "f5_running_count": 1,
    "f6_group_fill": 1,
    "j6_report_tidy": 1,
    "j7_unpivot_rates": 1,
    "j8_report_upsert": 2,
    "b3_upsert": 2,
    "l2_named_kpis": 2,
    "l4_l5_macro_states": 1,
}
PUSHED = {
    "c3_compare": "GreaterThanOrEqual(o_totalprice,250000.0)",
    "c4_between": "LessThan(l_shipdate,2001-01-01",
    "c5_in": "In(o_orderpriority",
    "c7_like": "StringStartsWith(p_name,red)",
    "c8_year_filter": "GreaterThanOrEqual(o_orderdate,1998-01-01",
    "k22_money_differences": "GreaterThanOrEqual(o_orderdate,2000-07-01",
}


@pytest.fixture(autouse=True)
def long_metadata(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def planned(spark, name) -> str:
    return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_cartesian_python_or_sorted_aggregate(spark, name):
    plan = planned(spark, name)
    for operator in ("CartesianProduct", "NestedLoopJoin", "Python", "Pandas", "SortAggregate"):
        assert operator not in plan


@pytest.mark.parametrize("name, scans", ONE_SCAN.items())
def test_branches_share_the_fact_scan(spark, name, scans):
    df = QUERIES[name](spark, SF_DIR)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall("FileScan parquet", final)) == scans


@pytest.mark.parametrize("name, text", PUSHED.items())
def test_filters_reach_the_reader(spark, name, text):
    assert text in planned(spark, name)


def test_only_needed_columns_are_read(spark):
    plan = planned(spark, "k4_us_inflation")
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {field.split(":")[0] for field in schema.split(",")} == {
        "l_extendedprice", "l_linestatus", "l_shipdate"
    }


def lines_dealt(plan: str) -> set[int]:
    """Tasks that the fact's lines are dealt to by series and month, not summed before."""
    below = plan.rsplit("Exchange hashpartitioning", 1)[1]
    assert "Scan parquet" in below and "HashAggregate" not in below
    return {int(n) for n in re.findall(r"hashpartitioning\(entidad#\d+L, fecha#\d+, (\d+)\)", plan)}


def test_rate_lines_are_summed_in_as_many_tasks_as_the_files_need(spark, monkeypatch):
    size = derive.bytes_of(spark, f"{SF_DIR}/lineitem.parquet")
    for tasks in (30, 60):
        monkeypatch.setattr(derive, "SPREAD_BYTES", size / tasks)
        plan = planned(spark, "j7_unpivot_rates")
        assert lines_dealt(plan) == {tasks}
