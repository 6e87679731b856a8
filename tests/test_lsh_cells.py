"""Large buckets are searched by matrix products, with the pairs and ties of the small ones."""

import numpy as np
import pandas as pd
import pytest

from labelloom.models import lsh


@pytest.fixture()
def cell():
    rng = np.random.default_rng(1)
    t = pd.DataFrame({"id": rng.permutation(400)[:200], "x": list(rng.normal(size=(200, 3)).round()), "bucket": rng.integers(0, 9, 200)})
    each = list(rng.normal(size=(60, 3)).round())
    q = pd.DataFrame({"id": rng.integers(0, 60, 300), "bucket": rng.integers(0, 12, 300)}).drop_duplicates()
    return t, q.assign(x=[each[i] for i in q["id"]])


@pytest.mark.parametrize("k", [1, 3, 50])
def test_large_and_small_buckets_agree(monkeypatch, cell, k):
    found = []
    for dense in (1, 200, 10**9):
        monkeypatch.setattr(lsh, "DENSE", dense)
        got = lsh._nearest_of_cell(*cell, k).astype({"key": int, "neighbour": int})
        found.append(got.sort_values(["key", "distance", "neighbour"]).reset_index(drop=True))
    assert found[0].equals(found[1]) and found[0].equals(found[2])
    t, q = cell
    for key, own in found[0].groupby("key"):
        asked = q[q["id"] == key]
        rows = t[t["bucket"].isin(asked["bucket"])]
        want = sorted((float(((asked["x"].iloc[0] - x) ** 2).sum()), i) for i, x in zip(rows["id"], rows["x"]))[:k]
        assert list(zip(own["distance"], own["neighbour"])) == want
