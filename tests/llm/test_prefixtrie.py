"""The prefix trie against a plain one, with cut conversations, small shards, ties and copies."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from factloom.llm import prefixtrie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n_convs int, depth string, owner string"


def talk(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", "clash") for r in rows], SCHEMA)


def plain(rows, tie=lambda role, text: 0):
    said = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            said[c].append((t is not None, t or 0, role or "", tie(role or "", text or ""), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in said.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return collections.Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if whole[c] == p).encode()).hexdigest()) for p, m in members.items())


def got(spark, rows, **more):
    return collections.Counter(tuple(r) for r in prefixtrie.trie(talk(spark, rows), **more).collect())


def conversations(rng, count=260):
    rows = []
    for c in [*range(count), 500, 501, 777, -5, -100, -101, 2**40]:
        rows += [(c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.2 else ["user", "assistant"][t % 2], rng.choice(["a", "bb", "é🙂", "", None]))
                 for t in range(rng.choice([1, 2, 3, 4, 8, 13]))]
    for c in range(1000, 1060):  # copies of one long conversation
        rows += [(c, t, "user", f"t{t}") for t in range(11)]
    rows += [(2000, None, None, None), (2000, None, None, None), (2000, 3, "user", "x" * 200_000), (None, 0, "user", "no id"), (2001, 5, "", "")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{}, {"segment": 3, "most": 7}, {"segment": 1, "most": 1}])
def test_trie_equals_plain_one(spark, sizes):
    rows = conversations(random.Random(8))
    assert got(spark, rows, **sizes) == plain(rows)


def test_ids_of_a_node_are_joined_in_pieces(spark):
    rows = [(c, 0, "user", "same") for c in range(3000)]
    turns, longest = prefixtrie.rebuilt(talk(spark, rows))
    nodes = prefixtrie.tables(turns, longest, 10, 64)
    ends = collections.Counter(r["ends_sha256"] for r in prefixtrie.ended(nodes, piece=17).collect())
    assert ends == collections.Counter(r[7] for r in plain(rows).elements() if r[1] > 0)  # none ends in the root


def test_ties_and_empty_tables(spark):
    assert got(spark, []) == got(spark, [(None, 1, "user", "a")]) == collections.Counter()
    rows = [(c, 1, role, text) for c in range(20) for role in ("b", None, "a") for text in ("x", "y", "x", None)]
    hashes = {(r["role"], r["text"]): r["k"] for r in spark.createDataFrame(
        [(a or "", b or "") for _, _, a, b in rows], "role string, text string").selectExpr("*", "xxhash64(1, role, text) AS k").collect()}
    assert got(spark, rows) == plain(rows, tie=lambda role, text: hashes[role, text])


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(-2**62, 2**62, 5000) for _ in range(2))
    a[:2000] = a[0]  # half of a digest may be shared
    slots = prefixtrie.Slots(a, b)
    assert sorted(slots.of(a, b)) == list(range(5000))
    assert (slots.of(a, b + 1) == -1).all() and (prefixtrie.Slots(a[:0], b[:0]).of(a, b) == -1).all()
    with pytest.raises(ValueError):
        node = {"conv_id": np.array([1, 1]), "d": np.array([1, 2]), "x1": np.array([5, 0]), "x2": np.array([6, 0]), "c1": np.zeros(2, int), "c2": np.zeros(2, int),
                "chars": np.array([1, 1]), "last": np.array([False, True])}
        list(prefixtrie.node_table(node, 0, 0))  # a turn that leaves the digest as it was
