"""Recall of spaced seeds at every item length, and hits against brute force over the given documents."""

import itertools
import random
import re

import pytest

from factloom.llm import decontamination as dec

SCHEMA = "doc_id bigint, text string, lang string, words string, seed string, at int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "clash", "clash", 1) for i, t in rows], SCHEMA)


def plain(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def allowed(length):
    return length - -(-8 * length // 10)


@pytest.mark.parametrize("length", [*range(3, 17), 20, 24])
def test_masks_hit_items_with_every_fifth_token_replaced(length):
    rng = random.Random(length)
    places = [{at + k for k in dec.compared(m)} for m in dec.masks_of(length) for at in range(length - len(m) + 1)]
    lost = list(itertools.combinations(range(length), allowed(length)))
    lost = rng.sample(lost, 4000) if len(lost) > 4000 else lost
    assert sum(any(not p & set(c) for p in places) for c in lost) >= 0.95 * len(lost)


def test_recall_at_every_length(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items, docs, want = [], [], {}
    for length in [*range(3, 17), 20, 24, 30, 45]:
        items.append((length, " ".join(word() for _ in range(length))))
        for k in range(40):
            said = items[-1][1].split()
            for gone in rng.sample(range(length), min(k % 5, allowed(length))):
                said[gone] = word()
            doc = 1000 * length + k
            docs.append((doc, " ".join([*(word() for _ in range(rng.randint(0, 30))), *said, *(word() for _ in range(rng.randint(0, 30)))])))
            want.setdefault(length, set()).add(doc)
    docs += [(k, " ".join(word() for _ in range(60))) for k in range(200)]
    found = {(r["doc_id"], r["item_id"]) for r in dec.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    for length, which in want.items():
        assert sum((d, length) in found for d in which) >= 0.9 * len(which), length
    assert all(d in want[i] for d, i in found)


def test_given_documents_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r["doc_id"], r["item_id"]): r for r in dec.contaminated(docs, items).collect()}
    texts = {r["doc_id"]: plain(r["text"]) for r in docs.collect()}
    tests = {r["item_id"]: plain(r["text"]) for r in items.collect()}
    exact = set()  # documents that hold twelve tokens of an item as they are
    for i, t in tests.items():
        parts = {tuple(t[k:k + 12]) for k in range(len(t) - 11)}
        exact |= {(d, i) for d, w in texts.items() if any(tuple(w[k:k + 12]) in parts for k in range(len(w) - 11))}
    assert exact and exact <= set(found)
    for (d, i), r in found.items():  # the span that is said to match does, up to the share that is said
        said, test = texts[d][r["first_token"]:r["last_token"] + 1], tests[i]
        best = max(sum(a == b for a, b in zip(said[max(0, -k):], test[max(0, k):])) for k in range(-len(said), len(test)))
        assert r["similarity"] >= 0.8 and best >= 0.8 * min(12, len(test))


def test_corner_cases(spark):
    story = " ".join(f"w{k}" for k in range(40))
    long = "x y z " * 30_000
    docs = [(1, None), (2, ""), (3, "  \n\t "), (4, story), (4, story), (5, "¿" + story.upper()), (6, long), (7, long + story), (None, story), (8, "Größe ñandú 日本語 🙂 é")]
    items = [(1, story), (2, story), (3, None), (4, ""), (5, "größe, Ñandú: 日本語"), (6, "x"), (None, " ".join(f"w{k}" for k in range(5, 30)))]
    found = {(r["doc_id"], r["item_id"]): r for r in dec.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert set(found) == {(d, i) for d in (4, 5, 7, None) for i in (1, 2, None)} | {(8, 5)}
    assert (found[5, 1]["first_token"], found[5, 1]["last_token"]) == (0, 39) == (found[4, 1]["first_token"], found[4, 1]["last_token"])
    assert found[7, 1]["first_token"] == 90_000
    kept = dec.decontaminated(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 6]
    assert dec.contaminated(frame(spark, docs), spark.createDataFrame([], "item_id bigint, text string")).count() == 0
    assert dec.contaminated(frame(spark, []), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0
