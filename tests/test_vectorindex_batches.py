import numpy as np
import pandas as pd
import pytest

from factloom.operators import vectorindex


class _Captured:
    """Stands for a frame and hands the batch function out."""

    def select(self, *columns):
        return self

    def mapInPandas(self, run, schema):
        return run


@pytest.mark.usefixtures("spark")
def test_placing_passes_on_bounded_batches_and_loses_no_list():
    rng = np.random.default_rng(3)
    centroids = vectorindex._unit(rng.normal(size=(300, 8)))
    frame = pd.DataFrame({"query_id": np.arange(3000), "embedding": list(rng.normal(size=(3000, 8)).astype(np.float32))})
    held = np.full(300, 2)
    out = list(vectorindex._nearest(_Captured(), "query_id", centroids, 40, held, 100)(iter([frame])))
    assert max(map(len, out)) <= 4096
    whole = pd.concat(out)
    assert len(whole) == 3000 * 50  # 50 lists hold the 100 vectors asked for
    sims = np.round(vectorindex._unit(np.stack(frame["embedding"]).astype(np.float64)) @ centroids.T, 9)
    assert (whole["list"].to_numpy().reshape(3000, 50) == np.argsort(-sims, axis=1, kind="stable")[:, :50]).all()
    nearest = pd.concat(vectorindex._nearest(_Captured(), "query_id", centroids, 1)(iter([frame])))
    assert (nearest["list"].to_numpy() == sims.argmax(axis=1)).all() and (nearest["place"] == 1).all()
