"""The short tests of a cell's kind agree with ``typed_cell`` and leave plain cells to generated code."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import typing
from factloom.functions.text import norm_key
from factloom.operators import relational as rel

MARKS = ["", "-", "+", "$", "€", " ", "  ", "\t", "\n", "\x00", "\xa0", "%", ",", ".", "/", ":", "_", "'", "é", "１", "USD", "usd ", " Eur", "CAD", "GBP", "O", "F"]
BODIES = ["", "0", "7", "00", "012", "12.50", "1,234", "1,234.5", "1 234", "12-5", "1997-01-01", "3/4/1998", "ORD-17", "N", "true", "n/a", "March 3, 1998", "1.5,234",
          "123456789012345678901", "1e5", "A1", "a-b", "v1.2", "-", "$"]


@pytest.fixture(scope="module")
def cells(spark):
    values = {None, *(a + b + c for a in MARKS for b in BODIES for c in MARKS)}
    return spark.createDataFrame([(v,) for v in values], "v string").repartition(4)


def test_number_test_agrees_with_typed_cell(cells):
    t = typing.typed_cell(F.col("v"))
    off = cells.where(typing.is_number_cell(F.col("v")) != (t["kind"] == "number"))
    assert [r.v for r in off.collect()] == []


def test_cells_that_are_no_numbers_skip_the_general_test(spark):
    odd = spark.createDataFrame([(v,) for v in ("ORD-17", "F", "1997-01-01", "1-URGENT", "", "3/4/1998")], "v string")
    assert odd.where(F.col("v").rlike(typing.NO_NUMBER)).count() == 6


def test_keyed_cells_agree_with_typed_cell(cells):
    t = typing.typed_cell(F.col("v"))
    want = cells.select("v", (t["kind"] == "null").alias("null"), (t["kind"] == "identifier").cast("long").alias("ident"), norm_key(t["raw"]).alias("key"))
    assert want.exceptAll(typing.keyed_cells(cells, "v", "v")).collect() == []


def test_keyed_cells_type_nothing_cell_by_cell(spark):
    plan = rel.rank_identity_columns(spark.createDataFrame([("A1", "x y")], "a string, b string"), ["a", "b"])
    assert "lambda" not in plan._jdf.queryExecution().optimizedPlan().toString().split("java_method")[0].split("invoke")[0]


def test_plain_numbers_of_two_columns_are_compared_before_typing(cells, spark):
    pair = cells.where("v IS NOT NULL AND length(v) < 5").select("v", F.lit("7").alias("w")).limit(3000)
    for op in ("gt", "le", "ne"):
        general = typing.condition(typing.typed_cell(F.col("v")), op, typing.typed_cell(F.col("w")))
        assert pair.where(rel.predicate(("v", op, F.col("w"))) != general).count() == 0
