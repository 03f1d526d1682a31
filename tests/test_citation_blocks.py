"""Blocks of one source share no line, so a wrong line is no right one of a near copy."""

import __spark_entry__ as entry


def test_near_copy_does_not_hold_a_wrong_line(spark, tmp_path):
    text = "some words in a row and others that follow them"
    copy = text.replace("some words", "some\nwords")  # the same source, each quote one line further down
    spark.createDataFrame([(5, text), (25, copy), (45, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.case_id: (r.codes, r.citations_ok) for r in entry.queries()["citation_integrity"](spark, str(tmp_path)).collect()}
    assert got[5] == ("not_in_source", False) and got[25] == ("not_in_source", False)
