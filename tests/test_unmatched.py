from factloom.operators import reconcile as rec


def test_unmatched_keys_are_grouped_once_and_joined_nowhere(spark):
    left = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    right = spark.createDataFrame([("b",), ("c",), ("c",), ("b",)], "k string")
    out = rec.unmatched(left, right, "k")
    assert sorted(map(tuple, out.collect())) == [("", "left"), ("a", "left"), ("c", "right")]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_join_key_is_found_in_one_reading_and_ties_find_none(spark):
    left = spark.createDataFrame([("A1", "x"), ("A2", "y")], "a string, b string")
    right = spark.createDataFrame([("a1", "z"), ("A3", "w")], "a string, b string")
    out = rec.infer_join_key(left, right, [("a", "a"), ("b", "b")])
    assert [(r.left_key, r.overlap) for r in out.collect()] == [("a", 1)]
    assert "scalar-subquery" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert rec.infer_join_key(left, left, [("a", "a"), ("a", "a")]).count() == 0
    assert rec.infer_join_key(left, right, [("b", "b")]).count() == 0
