"""Equal lines are read once, whatever files they stand in, and every line still gives its own values."""

import pytest

from factloom.operators import extract
from factloom.plans.registry import Tables
from test_plans_small import PATTERN, planned

SAID = "Fee: $5\nOwner\nAnn\nOwner\nBo\nThe document lists owner\n  Cy | x\nÖwner — Dee\nOwner: Eve; fee = 7\nshort line\n"


@pytest.mark.parametrize("name", ["labelled_values", "labelled_value_quotes", "next_line_values"])
def test_literals_are_read_before_the_lines_meet_their_values(spark, name):
    assert planned(spark, name).count(PATTERN) == 0


def test_small_table_is_dealt_out_without_a_setting(spark):
    spread = spark.conf.get("spark.factloom.spread")
    spark.conf.unset("spark.factloom.spread")
    try:
        assert Tables(spark, "/root/testdata/sf0.001").dealt("part").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.factloom.spread", spread)


def test_equal_lines_give_their_values_at_every_place(spark):
    blocks = spark.createDataFrame([(k, 0, 1 + 100 * k, ("\n" * k) + SAID) for k in range(40)], "file_id int, block_ord int, line_start int, text string")
    targets = spark.createDataFrame([(0, "owners"), (1, "fee")], "target_id int, target string")
    got = {}
    for r in extract.extract_many(blocks, ["file_id", "block_ord"], targets).collect():
        assert (("\n" * r.file_id) + SAID)[r.quote_start:].startswith(r.quote)
        got.setdefault(r.file_id, set()).add((r.line_no - 1 - 101 * r.file_id, r.target_id, r.form, r.norm))
    assert set(got) == set(range(40)) and all(found == got[0] for found in got.values())
    assert got[0] == {(0, 1, "separator", "$ 5"), (1, 0, "next_line", "Ann"), (3, 0, "next_line", "Bo"), (8, 0, "separator", "Eve"), (8, 1, "separator", "7")}
