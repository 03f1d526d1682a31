"""A question is sent once to each chunk of lists, and what is shuffled doesn't grow with the lists it probes."""

import numpy as np
import pandas as pd

from factloom.operators import search, vectorindex


def test_chunks_are_bounded():
    counts = np.array([3, 0, 4, 9, 50, 1, 1, 7])
    assert vectorindex.chunked(counts, 10).tolist() == [0, 0, 0, 1, 2, 3, 3, 3]


def test_blocks_grow_before_their_number_does():
    assert [search.blocks_of(n, 64) for n in (0, 4096, 4097, 51_282, 262_144, 1_000_000)] == [1, 1, 2, 8, 8, 31]


def test_only_probed_lists_are_compared(monkeypatch):
    monkeypatch.setattr(vectorindex, "HITS_HELD", 10)
    rng = np.random.default_rng(4)
    v = pd.DataFrame({"vec_id": np.arange(300), "vector": list(rng.normal(size=(300, 8))), "list": np.arange(300) % 7})
    q = pd.DataFrame({"query_id": np.arange(40), "vector": list(rng.normal(size=(40, 8))), "lists": [rng.permutation(9)[:1 + i % 4].astype(np.int32) for i in range(40)]})
    got = vectorindex.probed(v, q, 5)
    for _, row in q.iterrows():
        near = v[v["list"].isin(row["lists"])]
        sims = np.array([np.round(x @ row["vector"] / np.linalg.norm(x) / np.linalg.norm(row["vector"]), 9) for x in near["vector"]])
        want = near["vec_id"].to_numpy()[np.argsort(-sims, kind="stable")[:5]]
        assert got[got["query_id"] == row["query_id"]]["vec_id"].tolist() == want.tolist()
