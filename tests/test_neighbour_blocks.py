"""The exact search measures few pairs and loses none."""

import numpy as np
import pytest

from labelloom.models import neighbours as N


def brute(x, y, k, p):
    with np.errstate(all="ignore"):
        d = np.stack([N._sums(x.T, np.broadcast_to(row[:, None], x.T.shape), p) for row in y])
    nearest = np.argsort(d, axis=1, kind="stable")[:, :k]
    return nearest.ravel(), np.take_along_axis(d, nearest, axis=1).ravel()


@pytest.mark.parametrize("p", [1, 1.5, 2, 3, 4])
@pytest.mark.parametrize("kind", ["plain", "ties", "odd", "far"])
def test_blocks_equal_brute_force(monkeypatch, kind, p):
    rng = np.random.default_rng(5)
    for _ in range(10):
        for name, most in (("TILE", 20), ("FOLD", 5), ("CHUNK", 50)):
            monkeypatch.setattr(N, name, int(rng.integers(1, most)))
        n, m, dim, k = rng.integers(1, 60), rng.integers(1, 30), rng.integers(1, 6), rng.integers(1, 7)
        x, y = rng.normal(size=(n, dim)), rng.normal(size=(m, dim))
        if kind == "ties":
            x, y = np.round(x), np.round(y)
        elif kind == "far":
            x, y = x + 1e8, y + 1e8
        elif kind == "odd":
            x[rng.random(x.shape) < 0.05], x[rng.random(x.shape) < 0.03] = np.nan, 1e200
            y[rng.random(y.shape) < 0.05] = np.inf
        at, rows, d = N.nearest_rows(x, y, k, p)
        want_rows, want_d = brute(x, y, min(k, n), p)
        assert (at == np.repeat(np.arange(m), min(k, n))).all()
        assert (rows == want_rows).all() and (d == want_d).all()


@pytest.mark.parametrize("p,share", [(2, 0.01), (3, 0.2)])
def test_few_pairs_are_measured(monkeypatch, p, share):
    x, y = (np.random.default_rng(i).normal(size=(n, 16)) for i, n in ((1, 4000), (2, 256)))
    measured = []
    sums = N._sums
    monkeypatch.setattr(N, "_sums", lambda a, b, power: (out := sums(a, b, power), measured.append(out.size))[0])
    N.nearest_rows(x, y, 4, p)
    assert sum(measured) < share * len(x) * len(y)


def test_rows_are_copied_to_few_blocks(spark, monkeypatch):
    """Pairs of blocks stop growing with both sides: the larger the sides, the larger the blocks."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=2).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, x array<double>")
    monkeypatch.setattr(N, "BLOCK_ROWS", 4)
    got = [N.neighbours(df, df, "id", "x", 3, 2, b).orderBy("id", "rank").collect() for b in (None, 50)]
    assert got[0] == got[1] and len(got[0]) == 900
    seen = N.block_size(300, 300)
    assert seen == 37 and N.block_size(10**6, 10**6) == N.MOST_ROWS and N.block_size(3, 3) == 4
