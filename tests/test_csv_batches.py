from factloom.sources import files


def test_cells_leave_the_parser_as_arrow_columns(spark):
    rows = [("a", b"x,y\n1,\"p  q\"\nragged\n3,\n"), ("b", b"x,y\nonly\n"), ("c", b"\xff"), ("d", b"")]
    out = files.parse_csv_tables(spark.createDataFrame(rows, "path string, content binary"))
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    got = sorted(((*r,) for r in out.collect()), key=repr)
    nothing = (None,) * 8
    assert got == sorted([
        ("a", None, 1, None, None, 1, 2, 1, "x", "1", 1), ("a", None, 1, None, None, 1, 2, 2, "y", "p q", 1),
        ("a", None, 1, None, None, 2, 4, 1, "x", "3", 1), ("a", None, 1, None, None, 2, 4, 2, "y", "", 1),
        ("b", "no_rows", *nothing, 1), ("c", "invalid_encoding", *nothing, None), ("d", "no_text", *nothing, None)], key=repr)
