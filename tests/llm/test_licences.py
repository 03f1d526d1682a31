"""Licences in wrapped paragraphs, and similarity and word pairs against brute force."""

import re
import textwrap

import pytest

from factloom.llm import licences

SCHEMA = "doc_id bigint, text string, lang string, words string, label string, n int"
GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
       "Software Foundation, either version 3 of the License, or (at your option) any later version.")
MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
       "to deal in the Software without restriction, including without limitation the rights to use, copy and modify it.")
BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
       "Redistributions of source code must retain the above copyright notice.")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "clash", "clash", 1) for i, t in rows], SCHEMA)


def pairs(text):
    w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    return set(zip(w, w[1:]))


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return docs.selectExpr("doc_id + 10000 AS doc_id", "text", "lang", "'c' AS words", "'c' AS label", "1 AS n")


def test_wrapped_headers_are_found_with_their_lines(spark, corpus):
    rows, want = [], set()
    for family, text in (("gpl", GNU), ("mit", MIT), ("bsd", BSD)):
        for width in (60, 72, 79):
            for mark in ("", "# ", " * ", "// "):
                lines = [mark + x for x in textwrap.wrap(text, width)]
                k = len(rows)
                rows.append((k, "\n".join(["import this", "  ", *lines, mark.rstrip() if not mark.strip() else "", "def f(): pass"])))
                want.add((k, 2, 1 + len(lines), family))
    found = licences.licences(frame(spark, rows).union(corpus)).where("doc_id < 10000 AND confirmed").collect()
    got = {(r["doc_id"], r["line"], r["last_line"], r["family"]) for r in found}
    spans = {(r["doc_id"], r["family"]) for r in found}
    assert spans == {(k, f) for k, _, _, f in want}  # every header, under its family
    for doc, first, last, _ in got:
        assert any(doc == k and a <= first <= last <= b for k, a, b, _ in want)


def test_similarity_and_paragraphs_equal_brute_force(spark, corpus):
    long = "word " * 200_000
    rows = [(1, None), (2, ""), (3, " \n\t\n "), (4, MIT), (5, f"{long}\nAll rights reserved.\n{long}"), (6, "All rights reserved.\n\n\nReleased under the MIT License.\r\n"),
            (7, "All rights reserved."), (7, "All rights reserved."), (None, "All rights reserved."), (8, " All rights\treserved. x\n1\t2\n3\tlicense")]
    found = licences.candidates(frame(spark, rows)).collect()
    text = {i: (t or "") for i, t in rows}
    words = licences.key_words()
    has = lambda x: any(w in re.split(r"[\W_]+", x) if len(w) < 4 else w in x for w in words)
    for r in found:
        lines = text[r["doc_id"]].lower().split("\n")[r["line"]:r["last_line"] + 1]
        assert r["said"] == " ".join(lines) and all(x.strip() for x in lines) and has(r["said"])
    want = {(i, k) for i, t in text.items() for k, x in enumerate(t.lower().split("\n")) if has(x)}
    assert {(r["doc_id"], r["line"]) for r in found if r["line"] == r["last_line"]} == want
    scored = licences.licences(frame(spark, rows).union(corpus)).where("doc_id < 10000 OR doc_id IS NULL").collect()
    for r in scored:
        said = pairs(" ".join(text[r["doc_id"]].split("\n")[r["line"]:r["last_line"] + 1]))
        assert abs(r["similarity"] - max(len(pairs(t) & said) / len(pairs(t)) for t in licences.TEMPLATES[r["family"]])) < 1e-9
        assert r["confirmed"] == (r["similarity"] >= licences.CONFIRMED)
    sure = sorted((str(r["doc_id"]), r["line"], r["family"]) for r in scored if r["confirmed"])
    assert sure == sorted([("4", 0, "mit"), ("5", 1, "proprietary"), ("6", 0, "proprietary"), ("6", 3, "mit"), ("7", 0, "proprietary"), ("7", 0, "proprietary"),
                           ("None", 0, "proprietary"), ("8", 0, "proprietary")])


def test_grams_equal_plain_ones(spark):
    texts = ["", "one", "one two", "One TWO, three-four", "é 1 é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, g in df.select("t", licences.grams(licences.F.col("t"))).collect():
        w = [x for x in re.split(r"[\W_]+", t.lower()) if x]
        assert g["words"] == w and g["pairs"] == [f"{a} {b}" for a, b in zip(w, w[1:])] and g["both"] == g["words"] + g["pairs"]
