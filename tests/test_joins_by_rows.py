"""Frames that grow with the claims or lines never go through the driver, however small their files look."""

import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name, most", [("evidence_roles", 0), ("authorized_relations", 0)])
def test_no_broadcast(spark, name, most):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") <= most
