"""Tables found inside the row of a text, against those found among lines that were dealt out."""

import random

from factloom.operators import blocks, tables

COLUMNS = ("file_id", "table_line", "title", "headers", "line_no", "cells", "malformed")


def found(df):
    return sorted(((r["file_id"], r["table_line"], r["title"] or "", tuple(r["headers"]), r["line_no"], tuple(r["cells"]), r["malformed"]) for r in df.collect()))


def test_equal_to_the_rows_found_among_lines(spark):
    rng = random.Random(3)
    kinds = ["plain words", "", "   ", "A | B | C", "--- | :--: | ---", "1 | 2 | 3", "1 | 2 | 3 | 4", "| x  y | z |", "| | b |", "a\tb", "c\td\te", "---\t---", "one | pipe"]
    texts = ["\n".join(rng.choice(kinds) for _ in range(rng.randrange(30))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "file_id bigint, text string")
    lines = blocks.source_lines(df.selectExpr("file_id", "text", "1 AS line_start"), ["file_id"])
    want = found(tables.detect_text_tables(lines))
    assert found(tables.text_tables(df)) == want and len(want) > 300
    plan = tables.text_tables(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_corner_texts(spark):
    long = "Head | Two | x\n" + "1 | 2 | 3\n" * 50000
    rows = [(1, None), (2, ""), (3, "a | b | c"), (4, "t\r\na\tb\r\n1\t2"), (4, "a\tb\n1\t2"), (None, "a\tb\n1\t2"), (5, long)]
    df = spark.createDataFrame([(k, t, "clash") for k, t in rows], "file_id bigint, text string, line_no string")
    got = tables.text_tables(df)
    assert tuple(got.columns) == COLUMNS and tables.text_tables(df.limit(0)).count() == 0
    small = got.where("file_id IS NULL OR file_id < 5").collect()
    assert sorted((str(r["file_id"]), r["table_line"], r["title"], r["line_no"], *r["cells"]) for r in small if r["title"]) == [("4", 2, "t", 3, "1", "2")]
    assert sorted(str(r["file_id"]) for r in small) == ["4", "4", "None"] and got.where("file_id = 5").count() == 50000
