"""Plans over deep expressions hold each of them once: what the driver analyses, copies and prints stays small."""

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
PATTERN = r"https?://[^<>\s]+"  # stands once in the pattern of all literals


def planned(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.debug.maxToStringFields",)}
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("name, most", [
    ("labelled_values", 2), ("labelled_value_quotes", 2), ("next_line_values", 2), ("recovered_assignments", 4), ("distinct_labelled_values", 0),
    ("overflowing_label_values", 0), ("cell_values", 2)])
def test_literals_are_read_in_few_places(spark, name, most):
    assert planned(spark, name).count(PATTERN) <= most
