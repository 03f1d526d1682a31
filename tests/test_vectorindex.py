"""The stored vector index against the exact search, with a list that holds a third of all vectors."""

import random

import numpy as np
from pyspark.sql import functions as F

from factloom.operators import search, vectorindex

DIMS = 16


def vectors(spark, count=3000):
    rng = random.Random(3)
    middles = [[rng.gauss(0, 1) for _ in range(DIMS)] for _ in range(12)]
    rows = [(k, [float(m + rng.gauss(0, 0.35)) for m in middles[0 if k % 3 == 0 else k % 12]]) for k in range(count)]
    rows += [(count + k, rows[0][1]) for k in range(40)]  # copies
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")


def test_recall_reaches_what_is_asked_for_and_is_stored(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectorindex, "BLOCK_ROWS", 200)
    monkeypatch.setattr(search, "BLOCK_ROWS", 500)
    e = vectors(spark)
    index = vectorindex.build_index(e, str(tmp_path / "index"), DIMS, k=10)
    assert index.lists.count() == e.count() and index.recall >= 0.9 and index.probes < len(index.centroids)
    again = vectorindex.VectorIndex(spark, index.folder, DIMS)  # by its folder alone
    asked = e.withColumnRenamed("vec_id", "query_id").where("query_id % 7 = 0")
    exact = search.vector_search(e, asked, 10, DIMS)
    found = vectorindex.index_search(again, asked, 10)
    assert vectorindex.recall_of(found, exact) >= 0.88
    off = found.join(exact.select("query_id", "vec_id", F.col("similarity").alias("sure")), ["query_id", "vec_id"]).where("abs(similarity - sure) > 1e-8")
    assert off.count() == 0
    every = vectorindex.index_search(again, asked, 10, probes=len(index.centroids))
    assert sorted(map(tuple, every.select("query_id", "vec_id", "rank").collect())) == sorted(map(tuple, exact.select("query_id", "vec_id", "rank").collect()))


def test_unusable_vectors_and_empty_tables(spark, tmp_path):
    rows = [(1, [1.0] * DIMS), (2, None), (3, [1.0]), (4, [float("nan")] * DIMS), (None, [1.0] * DIMS), (5, [0.0] * DIMS)]
    e = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    index = vectorindex.build_index(e, str(tmp_path / "a"), DIMS)
    assert {r["vec_id"] for r in index.lists.collect()} == {1, 5}
    assert vectorindex.index_search(index, e.withColumnRenamed("vec_id", "query_id"), 3).where("query_id = 1").first()["vec_id"] == 1
    none = vectorindex.build_index(e.where("false"), str(tmp_path / "b"), DIMS)
    assert none.lists.count() == 0 and vectorindex.index_search(none, e.withColumnRenamed("vec_id", "query_id"), 3).count() == 0


def test_centroids_fill_empty_lists():
    rng = np.random.default_rng(1)
    sample = search._unit(rng.normal(size=(300, 8)))
    centroids = vectorindex.fitted(sample, 20)
    assert centroids.shape == (20, 8) and (np.bincount((sample @ centroids.T).argmax(axis=1), minlength=20) > 0).sum() >= 18
