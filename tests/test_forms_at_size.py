from pyspark.sql import functions as F

from factloom.functions.text import token_forms
from factloom.operators.search import extractive_answer


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_passage_is_judged_once_and_only_what_fits_is_grouped(spark):
    rows = [(1, "What is the agreed premium", "The agreed premium is $500", "a.txt", 1), (1, "What is the agreed premium", "Nothing of that kind", "b.txt", 2),
            (2, "When was it issued", "It was issued then", "a.txt", 1), (3, None, "The agreed premium", "a.txt", 1), (4, "agreed premium", None, "a.txt", 1)]
    out = extractive_answer(spark.createDataFrame(rows, "q long, question string, quote string, source string, ord int"), "q", "question", "quote", "source", "ord")
    assert [tuple(r) for r in out.collect()] == [(1, 1, "The agreed premium is $500", 13)]
    # each pattern of a word's letters stands once for the question, the quote and the source
    assert _plan(out).count(r"^\p{L}+$") <= 6


def test_forms_of_a_token_without_an_ending_need_no_pattern(spark):
    tokens = ["premium", "parties", "boxes", "houses", "was", "gas", "gods", "lies", "bus", "news", "agreed", "red", "7s", "cds", None]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", token_forms(F.col("t")).alias("f"))
    assert {r["t"]: r["f"] for r in got.collect()} == {
        "premium": ["premium"], "parties": ["parties", "party"], "boxes": ["boxes", "boxe", "box"], "houses": ["houses", "house", "hous"], "was": ["was"], "gas": ["gas"],
        "gods": ["gods", "god"], "lies": ["lies", "lie"], "bus": ["bus"], "news": ["news"], "agreed": ["agreed", "agre", "agree"], "red": ["red"], "7s": ["7s"],
        "cds": ["cds", "cd"], None: []}
