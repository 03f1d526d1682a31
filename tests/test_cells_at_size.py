"""Cells of one row meet by a merge, so no table of them goes through the driver."""

import __spark_entry__ as entry


def test_cells_meet_their_row_by_a_merge(spark):
    plan = entry.queries()["cell_values"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join [" in line and "row_ord" in line]
    assert len(joins) == 2 and all("SortMergeJoin" in line for line in joins)
