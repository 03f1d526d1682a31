"""The number of probed lists holds for other questions than those it was found with, and every question gets its results."""

import random

from factloom.operators import search, vectorindex

DIMS = 8


def test_short_lists_are_filled_up_from_the_next_ones(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, [rng.gauss(0, 1) for _ in range(DIMS)]) for k in range(60)]
    e = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    index = vectorindex.build_index(e, str(tmp_path / "index"), DIMS, lists=30, k=5)
    found = vectorindex.index_search(index, e.withColumnRenamed("vec_id", "query_id"), 5, probes=1)
    assert found.count() == 5 * 60


def test_recall_of_the_asked_questions_lies_above_the_wanted_one(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, [rng.gauss(0, 1) for _ in range(DIMS)]) for k in range(1500)]
    e = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    index = vectorindex.build_index(e, str(tmp_path / "index"), DIMS, k=5, questions=64)
    asked = e.withColumnRenamed("vec_id", "query_id")
    assert index.recall > 0.9 + 0.01
    assert vectorindex.recall_of(vectorindex.index_search(index, asked, 5), search.vector_search(e, asked, 5, DIMS)) >= 0.9
