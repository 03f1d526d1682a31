"""Hard negatives against brute force, with ties, copies and extreme values."""

import collections
import math
import random

import numpy as np
import pyarrow as pa

from factloom.llm import hardnegatives

SCHEMA = "vec_id bigint, label int, embedding array<float>, anchor_id int, windows string, q string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", "clash") for r in rows], SCHEMA)


def brute(rows, every=100, most=5, least=80):
    kept = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v))
        if row not in kept:
            kept.append(row)
    out = []
    for a in kept:
        if a[0] % every:
            continue
        pairs = [(max(-2**55, min(2**55, sum(x * y for x, y in zip(a[2], b[2])))), b[0], b[1]) for b in kept if b[0] != a[0]]
        pairs.sort(key=lambda p: (-p[0], p[1]))
        for ps, pid, _ in [p for p in pairs if p[2] == a[1]][:most]:
            near = [p for p in pairs if p[2] != a[1] and least * ps <= 100 * p[0] <= 100 * ps][:most]
            out += [(a[0], pid, k + 1, p[1], ps, p[0]) for k, p in enumerate(near)]
    return collections.Counter(out)


def got(spark, rows, **more):
    return collections.Counter(tuple(r) for r in hardnegatives.mined(vectors(spark, rows), **more).collect())


def test_mined_rows_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k, rng.randint(0, 3), [rng.choice([0.5, 0.25, -0.1, 0.9]) for _ in range(6)]) for k in range(0, 900)]
    rows += [(2000 + k, 1 if k % 9 else 2, [0.5, 0.25, 0.9, 0.5, 0.5, 0.5]) for k in range(300)]  # copies of one vector
    rng.shuffle(rows)
    want = brute(rows, every=50)
    assert want and got(spark, rows, every=50) == want
    monkeypatch.setattr(hardnegatives, "ROWS", 100)
    monkeypatch.setattr(hardnegatives, "ANCHORS", 7)
    monkeypatch.setattr(hardnegatives, "TILE", 3)
    assert got(spark, rows, every=50) == want


def test_corner_cases(spark):
    v = [0.5, 0.5]
    rows = [(0, 1, v), (0, 1, v), (1, 1, v), (2, 2, v), (2, 2, v), (3, None, v), (None, 1, v), (4, 1, None), (5, 2, [0.5, None]), (6, 2, [0.5, float("nan")]),
            (7, 2, [0.5, float("inf")]), (8, 2, [0.5]), (9, 2, [0.5, 0.5, 9.0]), (10, 2, []), (100, 1, [0.25, 0.0]), (200, 2, [-0.5, -0.5]), (100, 2, [0.25, 0.5]),
            (11, 1, [0.0, 0.0]), (-100, 3, [0.1, 0.1]), (12, 3, [0.1, 0.1])]
    assert got(spark, rows) == brute(rows)
    huge = [(0, 1, [3e38, 1.0]), (1, 1, [3e38, 1.0]), (2, 2, [2e38, -5.0]), (3, 2, [1e20, 1e20]), (300, 2, [0.001, 1e30]), (4, 1, [-3e38, 1.0])]
    assert got(spark, huge) == brute(huge)
    assert got(spark, []) == got(spark, [(1, 1, v)]) == collections.Counter()
    assert got(spark, [(0, 1, v)]) == collections.Counter()


def test_first_of_and_windows_hold_ties():
    scores = np.array([3, 5, 5, 5, 1, 4])
    assert set(hardnegatives.first_of(scores, np.arange(6), 2)) == {1, 2}
    keys = [(0, 0, hardnegatives.packed(s, n), i) for s, n, i in [(10, False, 1), (10, True, 2), (9, False, 3), (9, True, 4), (8, True, 5), (7, True, 6)]]
    given = sorted(keys)
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*given[k:k + 2])], names=list("abcd")) for k in range(0, len(given), 2)]
    rows = list(hardnegatives.windowed(iter(batches), 2, 80))
    assert rows == [(0, 1, 1, 2, 10, 10), (0, 1, 2, 4, 10, 9), (0, 3, 1, 4, 9, 9), (0, 3, 2, 5, 9, 8)]
