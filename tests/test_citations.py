"""Citations on claims, nested answers, citation integrity, and the limit on distinct values."""

from factloom.operators import coverage, extract, ordering, verify


def test_claims_take_citations_from_different_files(spark):
    blocks = spark.createDataFrame([(1, "f", 5, "one\ntwo words"), (2, "f", 9, "two"), (3, "g", 1, "two"), (4, "h", 1, None)],
                                   "block_id int, file_id string, line_start int, text string")
    cites = spark.createDataFrame([
        ("a", 1, 1, 4, 7), ("a", 2, 2, 0, 3), ("a", 3, 3, 0, 3),  # the second is from the first one's file
        ("b", 1, 3, 0, 9), ("b", 2, 4, 0, 1), ("b", 3, 77, 0, 1), ("b", 4, 2, 2, 2),  # outside the block, no text, no block, empty
        ("c", 1, 3, None, 3), ("c", 2, 3, 1, 3), ("c", 2, 3, 1, 3)], "claim_id string, ordinal int, block_id int, start int, stop int")
    claims = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z"), ("d", "no")], "claim_id string, said string")
    got = {r.claim_id: [(c["rank"], c.file_id, c.line, c.quote) for c in r.citations] for r in verify.cite_claims(claims, cites, blocks).collect()}
    assert got == {"a": [(1, "f", 6, "two"), (2, "g", 1, "two")], "c": [(1, "g", 1, "wo")]}
    assert verify.cite_claims(claims.limit(0), cites.limit(0), blocks.limit(0)).count() == 0


def test_newest_answers_carry_their_claims(spark):
    answers = spark.createDataFrame([("w", i, i // 2) for i in range(5)] + [("v", 9, 0)], "w string, answer_id int, made int")
    claims = spark.createDataFrame([(4, 2, "second"), (4, 1, "first"), (0, 1, "old")], "answer_id int, ordinal int, said string")
    cites = spark.createDataFrame([(4, 1, 2, "q2"), (4, 1, 1, "q1"), (0, 1, 1, "old")], "answer_id int, claim_ordinal int, ordinal int, quote string")
    rows = ordering.latest_answers(answers, claims, cites, ["w"], ["made", "answer_id"], 3).orderBy("w", "position").collect()
    assert [(r.w, r.position, r.answer_id) for r in rows] == [("v", 1, 9), ("w", 1, 2), ("w", 2, 3), ("w", 3, 4)]
    assert [(c.said, [x.quote for x in c.citations]) for c in rows[-1].claims] == [("first", ["q1", "q2"]), ("second", [])]
    assert rows[0].claims == []


def test_integrity_of_citations_is_computed(spark):
    text = "\n".join(f"line {i}" for i in range(200))
    corpus = spark.createDataFrame([(1, "s", 1, text), (2, "s", 500, "Fee: 12 EUR"), (3, "other", 1, "Fee: 12 EUR"), (4, "s", 1, None)],
                                   "block_id int, source string, line_start int, text string")
    spot = text.index("line 150")
    rows = [  # citation, case, claim, source, quote, start, stop, line
        (1, "right", 1, "s", "line 150", spot, spot + 8, 151), (2, "case of letters", 1, "s", "Fee: 12 EUR", 0, 11, 500), (3, "line", 1, "s", "line 150", spot, spot + 8, 150),
        (4, "span", 1, "s", "line 150", spot, spot + 9, 151), (5, "value", 1, "s", "line 150", spot, spot + 8, 151), (6, "source", 1, "other", "Fee: 12 EUR", 0, 11, 1),
        (7, "forbidden", 1, "s", "line 150", spot, spot + 8, 151), (8, "null", 1, "s", None, 0, 1, 1), (9, "block", 1, "s", "Fee: 12 EUR", 0, 11, 1)]
    cites = spark.createDataFrame(rows, "citation_id int, case_id string, claim_id int, source string, quote string, start int, stop int, line_start int")
    value = {"case of letters": "12 eur", "value": "151", "right": "150", "null": "x"}
    claims = spark.createDataFrame([(r[1], 1, value.get(r[1])) for r in rows] + [("bare", 1, "x")], "case_id string, claim_id int, value string")
    names = [r[1] for r in rows] + ["bare", "silent", "nothing asked"]
    cases = spark.createDataFrame([(n, ["s"] if n not in ("bare", "silent", "nothing asked") else None, {"forbidden": "forbidden", "nothing asked": "optional"}.get(n, "required"))
                                   for n in names], "case_id string, sources array<string>, mode string")
    got = {r.case_id: (r.codes, r.citations_ok) for r in coverage.citation_integrity(cases, claims, cites, corpus).collect()}
    lost = ["not_in_source"]
    assert got == {"right": ([], True), "case of letters": ([], True), "line": (lost, False), "span": (lost, False), "block": (lost, False),
                   "value": (["value_without_support"], False), "source": (["source_missing"], False), "forbidden": (["citation_forbidden"], False),
                   "null": (lost + ["value_without_support"], False), "bare": (["claim_without_citation"], False), "silent": (["claim_missing"], False),
                   "nothing asked": ([], True)}


def test_too_many_values_give_none(spark):
    values = spark.createDataFrame([("a", i, 2) for i in range(3)] + [("b", i, 1) for i in range(4)], "target string, norm int, occurrences long")
    assert {r.target for r in extract.limited_values(values, ["target"], 3).collect()} == {"a"}
    assert {tuple(r) for r in extract.value_overflow(values, ["target"], 3).collect()} == {("a", 3, 6, False), ("b", 4, 4, True)}
