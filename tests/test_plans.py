"""Plans that would not hold at scale are caught here."""

from __future__ import annotations

import re

import pytest

from quern.operators.provenance import capped_links
from quern.plans.registry import QUERIES


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_product_of_tables(spark, data, name):
    plan = plan_of(QUERIES[name](spark, data))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["d2_run_urls", "d12_list_runs", "g2_facts_page", "c3_pages_by_part", "j7_touched_searches", "m1_url_provenance"])
def test_bodies_are_not_read(spark, data, name):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(QUERIES[name](spark, data)))
    assert schemas and not any(body in s for s in schemas for body in ("raw_html", "clean_html", "embedding"))


def test_a_run_narrows_its_scans(spark, data):
    from quern.operators.runs import run_urls

    assert "EqualTo(run_id,x)" in plan_of(run_urls(spark, data, "x"))


def test_filters_reach_the_scan(spark, data):
    from quern.runtime import read_table

    plan = plan_of(read_table(spark, data, "urls", ["id", "url"]).where("url = 'x' and id is not null"))
    assert "EqualTo(url,x)" in plan and "IsNotNull(id)" in plan


def test_top_rows_are_taken_before_the_sort(spark, data):
    assert "TakeOrderedAndProject" in plan_of(QUERIES["g2_logs_page"](spark, data))
    assert "WindowGroupLimit" in plan_of(capped_links(spark, data, 5))
