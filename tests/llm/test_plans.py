"""Plans of the training-data queries that would not hold at scale are caught here."""

from __future__ import annotations

import inspect

import pytest

import quern.llm as package
from quern.llm import boilerplate, encoding, language, mixing, neighbours, queries, repeated, residue, signatures, splitting, tokens


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"p1_main", "p2_found", "p6_restored", "p10_found"}))
def test_no_product_of_tables(spark, data, name):
    plan = queries.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_no_local_checkpoints():
    for module in (package, boilerplate, encoding, language, mixing, neighbours, repeated, residue, signatures, splitting, tokens):
        assert "localCheckpoint" not in inspect.getsource(module)
