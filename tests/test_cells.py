import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from factloom.functions import literals, text, typing
from factloom.operators import ordering
from factloom.operators import relational as rel

CELLS = [
    ("", "null"), (" - ", "null"), ("N/A", "null"), ("Unknown", "null"), ("no", "boolean"), ("Y", "boolean"),
    ("007", "identifier"), ("0", "number"), ("10USD", "identifier"), ("10 USD", "number"), ("5%", "number"), (".5", "number"),
    ("1,234.50", "number"), ("1 234", "number"), ("-3", "number"), ("+", "text"), (".", "text"), ("1/2/2026", "date"),
    ("2026-02-30", "text"), ("2026-02-28", "date"), ("March 4, 2021", "date"), ("4 mar 2021", "date"), ("A-17/b", "identifier"),
    ("two words 2", "text"), ("€ 7", "number"), ("abc", "text"), (None, "null"),
]


@pytest.fixture(scope="module")
def typed(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CELLS)], "i int, c string")
    return {r.i: r for r in df.select("i", typing.typed_cell(F.col("c")).alias("t"), typing.number_cell(F.col("c")).alias("n"),
                                      typing.date_cell(F.col("c")).alias("d")).collect()}


@pytest.mark.parametrize("i", range(len(CELLS)))
def test_kinds(typed, i):
    r = typed[i]
    assert r.t.kind == CELLS[i][1], CELLS[i]
    assert (r.n.kind == "number") == (r.t.kind == "number")
    assert (r.d.kind == "date") == (r.t.kind == "date")
    if r.t.kind == "number":
        assert (r.n.num, r.n.unit) == (r.t.num, r.t.unit)


def test_units_and_values(spark):
    df = spark.createDataFrame([("$1,234.50",), ("7 eur",), ("£ 3 USD",), ("12%",), ("1" * 25,)], "c string")
    got = [(r.t.unit, r.t.num) for r in df.select(typing.typed_cell(F.col("c")).alias("t")).collect()]
    assert got == [("USD", Decimal("1234.5")), ("EUR", Decimal(7)), ("USD", Decimal(3)), ("%", Decimal(12)), (None, None)]


def test_number_beyond_decimal_refuses(spark):
    df = spark.createDataFrame([("a", "1" * 25), ("a", "2")], "k string, v string")
    assert rel.aggregate_by(df, ["k"], [("sum", "v")]).status.first().status == "unsupported"


def test_null_never_matches(spark):
    df = spark.createDataFrame([(1, "5"), (2, "-"), (3, "abc"), (4, "6 EUR"), (5, "6 USD"), (6, None)], "i int, v string")
    assert [r.i for r in rel.where_typed(df, [("v", "ne", 5)]).orderBy("i").collect()] == [4, 5]
    assert [r.i for r in rel.where_typed(df, [("v", "eq", "$6")]).collect()] == [5]
    assert [r.i for r in rel.where_typed(df, [("v", "is_null")]).orderBy("i").collect()] == [2, 6]


def test_dates_compare_across_styles(spark):
    df = spark.createDataFrame([(1, "3/1/2021"), (2, "2021-03-02"), (3, "Mar 3 2021")], "i int, v string")
    assert [r.i for r in rel.where_typed(df, [("v", "gt", datetime.date(2021, 3, 1))]).orderBy("i").collect()] == [2, 3]


def test_nulls_sort_last_both_ways(spark):
    df = spark.createDataFrame([(1, "3"), (2, "n/a"), (3, "10")], "i int, v string")
    assert [r.i for r in ordering.sort_typed(df, [("v", "asc")], "i").collect()] == [1, 3, 2]
    assert [r.i for r in ordering.sort_typed(df, [("v", "desc")], "i").collect()] == [3, 1, 2]
    with pytest.raises(ValueError):
        ordering.sort_groups(df, [("v", "asc")], ["i"])


def test_unicode_keys(spark):
    import re
    import unicodedata

    raw = ["naïve Café", "Straße", "ＡＢＣ１２", "ﬁne_print", "étude", "ΣΑΣ İx", "a-b_c", "½ cup", ""]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string")
    got = [r.k for r in df.orderBy("i").select(text.norm_key(F.col("r")).alias("k")).collect()]
    want = [" ".join(m.casefold() for m in re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", r))) for r in raw]
    assert got == want


def test_forms(spark):
    want = {"policies": {"policies", "policy"}, "boxes": {"boxes", "box", "boxe"}, "named": {"named", "nam", "name"}, "cats": {"cats", "cat"},
            "news": {"news"}, "gas": {"gas"}, "pcs": {"pcs", "pc"}, "bus": {"bus"}, "glass": {"glass"}, "a1s": {"a1s"}}
    df = spark.createDataFrame([(w,) for w in want], "w string")
    assert {r.w: set(r.f) for r in df.select("w", text.token_forms(F.col("w")).alias("f")).collect()} == want


def test_question_tokens(spark):
    df = spark.createDataFrame([("What is the Fee of the plan, the plan fee and the 7 plans?",)], "q string")
    assert df.select(text.query_tokens(F.col("q")).alias("t")).first().t == ["fee", "plan", "of", "7", "plans"]


def test_literals(spark):
    said = "On Feb. 29, 2024 (not Feb 30, 2024) USD 1,000 or 5.50 EUR, -3% of A-1/B2 at x.y@z.org, https://a.b/c?d=1. 12.5 v1.2"
    df = spark.createDataFrame([(said,)], "t string")
    got = [(x.kind, x.norm, said[x.start:x.stop]) for x in df.select(literals.extract_literals(F.col("t")).alias("l")).first().l]
    assert got == [
        ("date", "2024-02-29", "Feb. 29, 2024"), ("number", "30", "30"), ("number", "2024", "2024"), ("money", "USD 1000", "USD 1,000"),
        ("money", "EUR 5.5", "5.50 EUR"), ("percent", "-3%", "-3%"), ("identifier", "A-1/B2", "A-1/B2"), ("email", "x.y@z.org", "x.y@z.org"),
        ("url", "https://a.b/c?d=1", "https://a.b/c?d=1"), ("number", "12.5", "12.5")]
