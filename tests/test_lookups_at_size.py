from factloom.operators import relational as rel


def test_words_are_compared_for_requests_with_one_row_only(spark):
    rows = [(1, "5", "price of bolts", "bolts price"), (2, "6", "price of bolts", "bolts price"), (2, "7", "price", "price"), (3, "8", "colour of gaskets", "bolts price"),
            (4, "n/a", "price", "price"), (5, None, "price", "price"), (6, "9", None, None)]
    df = spark.createDataFrame(rows, "r int, v string, asked string, said string")
    out = rel.lookup_cell(df, ["r"], "v", "asked", "said")
    assert sorted(map(tuple, out.collect())) == [(1, "5"), (6, "9")]
    below = out._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[-1]
    assert "lambda" not in below
