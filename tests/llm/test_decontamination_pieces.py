"""Windows carry a piece of their text, so a text full of passages takes no more memory than its pieces."""

from pyspark.sql import functions as F

from factloom.llm import decontamination as dec


def test_pieces_are_bounded_and_hold_every_window_with_its_neighbours(spark):
    n = 5 * dec.PIECE + 7
    texts = spark.createDataFrame([(1, [f"w{k}" for k in range(n)]), (2, ["", "a"]), (3, [""])], "doc_id bigint, words array<string>")
    beyond = max(map(len, dec.MASKS)) - 1 + dec.REACH
    seen = []
    for r in dec.pieces(texts, list(dec.MASKS), "doc_id").orderBy("doc_id", "origin").collect():
        assert len(r.words) <= dec.REACH + dec.PIECE + beyond
        if r.doc_id == 1:
            assert r.words == [f"w{k}" for k in range(r.origin, min(n, r.origin + r.own + dec.PIECE + beyond))]
            seen += range(r.origin + r.own, min(n, r.origin + r.own + dec.PIECE))
        else:
            assert (r.origin, r.own) == (-1, 0)
    assert seen == list(range(n))


def test_passages_across_the_ends_of_pieces_are_found_whole(spark):
    story = " ".join(f"s{k}" for k in range(40))
    ahead = [*range(0, 3), *range(dec.PIECE - 60, dec.PIECE + 30), 2 * dec.PIECE - 20]
    docs = spark.createDataFrame([(k, ("" if k % 2 else "(") + " ".join([*(f"x{k}y{i}" for i in range(k)), story, "end."])) for k in ahead], "doc_id bigint, text string")
    found = {r.doc_id: r for r in dec.contaminated(docs, spark.createDataFrame([(1, story)], "item_id bigint, text string")).collect()}
    assert {k: (r.first_token, r.last_token, r.similarity) for k, r in found.items()} == {k: (k, k + 39, 1.0) for k in ahead}


def test_text_full_of_passages(spark):
    story = " ".join(f"s{k}" for k in range(12))
    docs = spark.range(1).select("id", F.repeat(F.lit(story + " "), 10_000).alias("text"))
    found = dec.contaminated(docs, spark.createDataFrame([(1, story)], "item_id bigint, text string"), doc="id").collect()
    assert [(r.first_token, r.last_token) for r in found] == [(0, 119_999)]
