"""Assignments are recovered from one pass over the lines."""

from test_plans_small import planned


def test_assignments_are_read_once(spark):
    assert "parquet" not in planned(spark, "recovered_assignments")
