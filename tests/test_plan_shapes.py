"""Physical plans: no nested-loop joins, no row UDFs, filters and columns reach the scan, top lists don't sort all."""

import contextlib
import io

import pytest

from plotwright.plans.catalogue import QUERIES

#: These join frames of one row each.
ONE_ROW = {"metrics_materialised", "host_funnel"}
EAGER = {"refusal_stream", "claimed_once", "ttl_stream"}


def explain(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_joins(spark, sf, name):
    plan = explain(QUERIES[name](spark, sf))
    assert "BatchEvalPython" not in plan
    if name not in ONE_ROW:
        assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name,part", [
    ("over_budget", "ReadSchema: struct<l_suppkey:bigint,l_extendedprice:double>"),
    ("not_delivered", "GreaterThanOrEqual(o_orderdate"),
    ("ilike_and_list", "ReadSchema: struct<p_partkey:bigint,p_name:string,p_brand:string>"),
    ("source_counts", "GreaterThan(o_totalprice,100000.0)"),
    ("people_rank", "TakeOrderedAndProject"),
    ("url_frontier", "TakeOrderedAndProject"),
    ("error_streak", "WindowGroupLimit"),
    ("not_delivered", "LeftAnti"),
    ("either_path", "LeftSemi"),
    ("metrics_filter", "partial_count"),
])
def test_pushed(spark, sf, name, part):
    assert part in explain(QUERIES[name](spark, sf))
