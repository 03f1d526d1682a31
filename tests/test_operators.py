import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import blocks, coverage, extract, hierarchy, search, tables, tagging, verify


def _first_fit(files, max_bytes, cap):
    """Sequential model of the budget rule."""
    out = {}
    for run in {f[0] for f in files}:
        mine = sorted((f for f in files if f[0] == run), key=lambda f: (not f[3], f[2]))
        left = max(0, cap - mine[0][6])
        for _, file_id, _, _, size, n, _ in mine:
            if left == 0:
                out[file_id] = "block_cap"
            elif size > max_bytes:
                out[file_id] = "file_size_limit"
            elif n > left:
                out[file_id] = "block_cap"
            else:
                out[file_id] = "accepted"
                left -= n
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_caps_are_first_fit(spark, seed):
    rnd = random.Random(seed)
    files = [(i % 3, i, rnd.randrange(10_000) * 1000 + i, rnd.random() < 0.3, rnd.randrange(120), rnd.choice([0, 1, 1, 2, 3, 9, 40]), i % 3)
             for i in range(300)]
    df = spark.createDataFrame(files, "run_id int, file_id int, ordinal long, is_pdf boolean, bytes int, n_blocks int, used int")
    got = {r.file_id: r.outcome for r in hierarchy.apply_caps(df, 100, 50).collect()}
    assert got == _first_fit(files, 100, 50)


def _chunks(text, limit):
    """Sequential model of chunking."""
    out, cur = [], 0
    while cur < len(text):
        end = min(cur + limit, len(text))
        if end < len(text):
            cut = max(i for i in [-1, *[j for j in range(cur + limit // 2, end) if text[j] in " \n"]])
            end = cut if cut > cur else end
        piece = text[cur:end].strip()
        if piece:
            out.append(piece)
        cur = end
        while cur < len(text) and text[cur].isspace():
            cur += 1
    return out


def test_chunks_match_model_and_spans(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab é\n ") for _ in range(n)).strip() for n in (10, 700, 3000)] + ["x" * 1000, "a\n" * 500]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "d int, text string")
    got = blocks.chunk_text(df, ["d"], limit=200).orderBy("d", "block_ord").collect()
    for i, t in enumerate(texts):
        mine = [r for r in got if r.d == i]
        assert [r.text for r in mine] == _chunks(t, 200)
        assert all(t[r.start:r.stop] == r.text and r.line_start == 1 + t.count("\n", 0, r.start) for r in mine)
    lines = blocks.chunk_lines(df, ["d"], limit=200).collect()
    assert all("\n" not in texts[3][r.start:r.stop] for r in lines if r.d == 3)
    with pytest.raises(ValueError):
        blocks.chunk_text(df, ["d"], limit=100)


@pytest.mark.parametrize("blocks", [{}, {"vector_blocks": 3, "query_blocks": 4}])
def test_vector_search_is_exact(spark, blocks):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8)).astype("float32")
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<float>")
    q = df.where("vec_id < 20").withColumnRenamed("vec_id", "query_id")
    got = {(r.query_id, r.rank): r.vec_id for r in search.vector_search(df, q, 4, dims=8, **blocks).collect()}
    unit = v.astype("float64") / np.linalg.norm(v.astype("float64"), axis=1, keepdims=True)
    for i in range(20):
        best = np.argsort(-(unit @ unit[i]), kind="stable")[:4]
        assert [got[(i, k + 1)] for k in range(4)] == list(best)


@pytest.mark.parametrize("seed", range(3))
def test_conflicts_match_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = sorted({(rnd.randrange(12), "number", rnd.randrange(3), rnd.randrange(3)) for _ in range(60)})
    df = spark.createDataFrame(rows, "s int, kind string, file_id int, norm int")
    got = {r.s: (r.left_file, r.left_value, r.right_file, r.right_value) for r in verify.find_conflicts(df, ["s"]).collect()}
    want = {}
    for s in {r[0] for r in rows}:
        pairs = [(a[2], a[3], b[2], b[3]) for a in rows for b in rows if a[0] == b[0] == s and a[2] != b[2] and a[3] != b[3]]
        if pairs:
            want[s] = min(pairs)
    assert got == want


def test_quotes(spark):
    b = spark.createDataFrame([("b", "f", "aa aaa\nend", 3)], "block_id string, file_id string, text string, line_start int")
    e = spark.createDataFrame([(1, "b", "aaa"), (2, "b", "aa"), (3, "b", "zz"), (4, "x", "aa"), (5, "b", "aaa\n")], "i int, block_id string, quote string")
    got = {r.i: (r.reason, r.start, r.first_line, r.last_line) for r in verify.resolve_quotes(e, b).collect()}
    assert got[1] == (None, 3, 3, 3) and got[5] == (None, 3, 3, 3)
    assert [got[i][0] for i in (2, 3, 4)] == ["ambiguous_exact_quote", "exact_quote_not_found", "unknown_evidence_block"]


def test_hierarchy_ends_on_cycles_and_limits(spark):
    edges = spark.createDataFrame(
        [("r", "a", "A", True, False), ("a", "r", "R", True, False), ("a", "b", "B", True, False), ("b", "f", "F", False, False),
         ("a", "t", "T", False, True)], "parent_id string, id string, name string, is_folder boolean, trashed boolean")
    roots = spark.createDataFrame([("r", "R")], "id string, name string")
    res, gaps = hierarchy.expand_hierarchy(edges, roots, max_depth=5)
    assert {(r.id, r.depth) for r in res.collect()} == {("a", 1), ("r", 2), ("b", 2), ("t", 2), ("f", 3)} and gaps.count() == 0
    res, gaps = hierarchy.expand_hierarchy(edges, roots, max_depth=5, max_resources=2)
    assert res.count() == 2 and [g.reason for g in gaps.collect()] == ["resource_limit"]


def test_hierarchy_limit_met_exactly_on_a_level(spark):
    edges = spark.createDataFrame([("w", "a", "A", True, False), ("w", "b", "B", False, False), ("a", "c", "C", False, False)],
                                  "parent_id string, id string, name string, is_folder boolean, trashed boolean")
    roots = spark.createDataFrame([("w", "W")], "id string, name string")
    for limit, found, reasons in ((1, 1, ["resource_limit"]), (2, 2, ["resource_limit"]), (3, 3, []), (4, 3, [])):
        res, gaps = hierarchy.expand_hierarchy(edges, roots, max_resources=limit)
        assert (res.count(), [g.reason for g in gaps.collect()]) == (found, reasons)


def test_one_label_is_found_like_many_in_every_inflection(spark):
    said = "Sky: blue\nFly = green\nowner_id: A-17\nBox is red\nA very long label of far more than eight words in one single row: " + "x" * 300
    b = spark.createDataFrame([(1, 0, 1, said)], "file_id int, block_ord int, line_start int, text string")
    names = ["skies", "flies", "owner_id", "boxes", "very long label of far more than eight words in one single row"]
    targets = spark.createDataFrame(list(enumerate(names)), "target_id int, target string")
    many = {r.target_id: r.raw for r in extract.extract_many(b, ["file_id", "block_ord"], targets).collect()}
    one = {i: r.raw for i, n in enumerate(names) for r in extract.extract_labeled(b, ["file_id", "block_ord"], n).collect()}
    assert many == one == {0: "blue", 1: "green", 2: "A-17", 3: "red", 4: "x" * 300}


def test_questions_are_tagged_by_their_words(spark):
    want = {"List all orders where price is above 5": ("filter,list", "structured", True), "How many rows per region, sorted by count?": ("aggregate,group,order", "structured", True),
            "Compare revision 1 and revision 2": ("compare", "mixed", False), "Do all records have an owner?": ("completeness,list", "structured", True),
            "Reconcile orders against invoices": ("join", "mixed", True), "Summarize the table": ("summary", "structured", True),
            "Summarize the story": ("summary", "direct", False), "List each name": ("list", "exhaustive", True), "What is the fee?": ("lookup", "direct", False), "": ("lookup", "direct", False)}
    df = spark.createDataFrame([(q,) for q in want] + [(None,)], "q string")
    got = {r.q: (",".join(r.intents), r.mode, r.needs_complete_data) for r in tagging.tag_questions(df, "q").collect()}
    assert got == {**want, None: ("lookup", "direct", False)}


def test_authority_looks_at_denials_near_by(spark):
    df = spark.createDataFrame([("Approved by the board: X", 4), ("This was not, as some say, approved: X", -6), ("No rain. " + "word " * 9 + "signed X", 4),
                                ("draft X", -4), ("Revision id 7, X", 2), ("pending change request X", -6), ("plain X", 0)], "t string, s int")
    for r in df.select("t", "s", verify.authority_score(F.col("t"), F.lit("X")).alias("got")).collect():
        assert r.got == r.s, r.t


def test_one_value_per_label_form(spark):
    said = ("Project owner: Ann Lee; Fee = $5.00\nThe source lists renewal date — May 1, 2024\nStatus is open. Owner was Bo\n"
            "| Owner | Cy |\n2024-01-02 - Review date\nBudget of 7 EUR\nLead\n\nDee")
    b = spark.createDataFrame([("d", 1, said)], "d string, line_start int, text string")
    targets = spark.createDataFrame([(i, x) for i, x in enumerate(["owners", "fee", "renewal date", "status", "review date", "budget", "lead"])],
                                    "target_id int, target string")
    got = sorted((r.target_id, r.kind, r.norm) for r in extract.extract_many(b, ["d"], targets).collect())
    assert got == [(0, "text", "Ann Lee"), (0, "text", "Bo"), (0, "text", "Cy"), (1, "money", "$ 5"), (2, "date", "2024-05-01"), (3, "text", "open"),
                   (4, "date", "2024-01-02"), (5, "money", "EUR 7"), (6, "text", "Dee")]


def test_ragged_text_table_is_malformed(spark):
    b = spark.createDataFrame([("d", 1, "Title\nA | B | C\n1 | 2 | 3\n\n1 | 2 | 3 | 4\nend")], "file_id string, line_start int, text string")
    rows = tables.detect_text_tables(blocks.source_lines(b, ["file_id"])).orderBy("line_no").collect()
    assert [(r.title, r.headers, r.malformed) for r in rows] == [("Title", ["A", "B", "C"], False), ("Title", ["A", "B", "C"], True)]


def test_transitions(spark):
    log = spark.createDataFrame([("f", 1, "discovered", None), ("f", 2, "admitted", None), ("f", 3, "capped", None), ("g", 1, "admitted", None)],
                                "file_id string, seq int, status string, error_stage string")
    assert {(r.file_id, r.seq) for r in coverage.check_transitions(log).collect()} == {("f", 3), ("g", 1)}


def test_value_literals(spark):
    df = spark.createDataFrame([("$1,250.50", "paid $1250.5"), ("€5", "paid $5"), ("05/01/2024", "on May 1st, 2024"), ("+3%", "3%"), ("In  Full", "paid IN full")],
                               "v string, q string")
    assert [r.ok for r in df.select(verify.literal_supported(F.col("v"), F.col("q")).alias("ok")).collect()] == [True, False, True, False, True]
