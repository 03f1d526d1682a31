"""Streams over tables that are a folder of several files, as Spark writes them, and over one without rows."""

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def blocks_of(spark, folder):
    return sorted(tuple(r) for r in entry.queries()["streamed_blocks"](spark, folder).collect())


def test_a_table_of_many_files_is_streamed_whole(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = blocks_of(spark, str(tmp_path))
    assert got and got == blocks_of(spark, FOLDER)


def test_a_table_without_rows_gives_no_blocks(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert blocks_of(spark, str(tmp_path)) == []
