"""The stored word index against the searches without one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import catalog, search, wordindex

FOLDER = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


@pytest.fixture(params=[(1 << 14, 1 << 10), (16, 3)])
def sizes(request, monkeypatch):
    monkeypatch.setattr(wordindex, "PART_ROWS", request.param[0])
    monkeypatch.setattr(wordindex, "QUESTION_ROWS", request.param[1])


def test_index_gives_the_rows_of_the_plain_searches(spark, tmp_path, sizes):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    asked = spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", tx.query_tokens(F.col("text")).alias("tokens"))
    index = wordindex.build_index(docs, "doc_id", wordindex.text_words(F.col("text")), f"file://{tmp_path}/words")
    for k in (1, 7, 32):
        want = search.lexical_search(docs, ["doc_id"], asked, "item_id", k=k)
        assert rows(wordindex.index_search(index, asked, "item_id", "doc_id", k), "item_id", "doc_id", "matches", "rank") == rows(want, "item_id", "doc_id", "matches", "rank")
    forms = wordindex.build_index(docs, "doc_id", wordindex.text_forms(F.col("text")), f"file://{tmp_path}/forms")
    want = catalog.token_coverage(docs, "doc_id", asked, "item_id")
    assert rows(wordindex.index_coverage(forms, asked, "item_id", "doc_id"), "doc_id", "item_id", "coverage") == rows(want, "doc_id", "item_id", "coverage")


def test_corner_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red house"), (2, None), (3, ""), (None, "red"), (4, "houses houses"), (4, "red"), (5, "x " * 5000 + "house")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, ["red", "house", "red"]), (2, []), (3, None), (None, ["red"]), (4, ["nowhere"])], "item_id bigint, tokens array<string>")
    index = wordindex.build_index(docs, "doc_id", wordindex.text_words(F.col("text")), f"file://{tmp_path}/words")
    assert rows(wordindex.index_search(index, asked, "item_id", "doc_id"), "item_id", "doc_id", "matches", "rank") == [(1, 1, 2, 1), (1, 4, 2, 2), (1, 5, 1, 3)]
    assert wordindex.index_search(index, asked.limit(0), "item_id", "doc_id").count() == 0
    none = wordindex.build_index(docs.limit(0), "doc_id", wordindex.text_words(F.col("text")), f"file://{tmp_path}/none")
    assert wordindex.index_search(none, asked, "item_id", "doc_id").count() == 0


def test_index_reads_the_buckets_of_asked_words(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"word{k} common") for k in range(200)], "doc_id bigint, text string")
    index = wordindex.build_index(docs, "doc_id", wordindex.text_words(F.col("text")), f"file://{tmp_path}/words")
    asked = spark.createDataFrame([(1, ["common"])], "item_id bigint, tokens array<string>")
    plan = wordindex.index_search(index, asked, "item_id", "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_counted_keeps_the_best():
    rng = np.random.default_rng(1)
    for _ in range(200):
        lists = [np.unique(rng.integers(0, 60, rng.integers(1, 50))) for _ in range(rng.integers(1, 8))]
        ids, score = wordindex.counted(lists, None)
        want = sorted(zip(-score, ids, strict=True))
        for k in (1, 3, 20):
            some, own = wordindex.counted(lists, k)
            assert sorted(zip(-own, some, strict=True)) == want[:k]
