"""UMAP: curve, memberships, moves against plain loops; layouts that keep neighbours, in one cell and in several."""

import math

import numpy as np
import pytest

from quantgrid.errors import ValidationError
from quantgrid.operators import umap
from quantgrid.operators.matrix import row_arrays

from .test_scores import cells_of


def test_curve():
    """Values that the published method gives for its usual distances."""
    assert umap.curve(0.1) == pytest.approx((1.5769, 0.8951), abs=2e-3)
    assert umap.curve(0.5) == pytest.approx((0.5830, 1.3342), abs=2e-3)


def plain_memberships(d, goal):
    rho = min((x for x in d if x > 0), default=0.0)
    low, high = 1e-12, 1e6
    for _ in range(200):
        mid = math.sqrt(low * high)
        if sum(math.exp(-max(x - rho, 0) / mid) for x in d) > goal:
            high = mid
        else:
            low = mid
    sigma = max(mid, 1e-3 * sum(d) / (len(d) + 1))
    return [math.exp(-max(x - rho, 0) / sigma) if x > rho else 1.0 for x in d]


def test_memberships_and_union(spark):
    rng = np.random.default_rng(0)
    d = np.sort(rng.exponential(size=(9, 7)), axis=1)
    d[2, :3] = 0
    assert np.allclose(umap.calibrated(d, 3.0), [plain_memberships(r, 3.0) for r in d], atol=1e-7)
    assert np.allclose(umap.calibrated(np.zeros((2, 4)), 2.0), 1)
    assert umap.calibrated(np.array([[1.0, np.inf]]), 1.0).tolist() == [[1.0, 0.0]]

    x = rng.normal(size=(25, 4))
    for metric in umap.METRICS:
        z = x - x.mean(1, keepdims=True) if metric == "correlation" else x
        unit = z / np.linalg.norm(z, axis=1, keepdims=True)
        far = np.sqrt(((x[:, None] - x[None]) ** 2).mean(2)) if metric == "euclidean" else 1 - unit @ unit.T
        w = np.zeros((25, 25))
        for i in range(25):
            near = [j for j in np.argsort(far[i], kind="stable") if j != i][:5]
            w[i, near] = plain_memberships(far[i][near], math.log2(6))
        want = w + w.T - w * w.T
        got = np.zeros((25, 25))
        for r in umap.fuzzy_graph(row_arrays(cells_of(spark, x)), 6, metric=metric).collect():
            got[int(r["a"][1:]), int(r["b"][1:])] = r["w"]
        assert np.allclose(got, want, atol=1e-6), metric


def test_epoch_moves_as_plain_loops_do():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(8, 2))
    y[3] = y[0]  # a pull and pushes of length 0
    head, tail = np.array([0, 0, 0, 1, 2, 2, 4]), np.array([3, 6, 1, 0, 7, 1, 2])
    pushers = rng.integers(0, 5, (7, umap.PUSHES))
    got, want, (a, b) = y.copy(), y.copy(), umap.curve(0.1)
    umap.epoch(got, head, tail, pushers, 0.7, a, b)
    place = [0, 1, 2, 0, 0, 1, 0]
    for wave in range(3):
        on = [i for i in range(7) if place[i] == wave]
        pulled = want.copy()
        for i in on:
            gap = want[head[i]] - want[tail[i]]
            if s := float(gap @ gap):
                pulled[head[i]] += 1.4 * np.clip(-2 * a * b * s ** (b - 1) / (1 + a * s**b) * gap, -4, 4)
        want = pulled.copy()
        for i in on:
            for j in pushers[i]:
                gap = pulled[head[i]] - pulled[j]
                if s := float(gap @ gap):
                    want[head[i]] += 0.7 * np.clip(2 * b / ((0.001 + s) * (1 + a * s**b)) * gap, -4, 4)
    assert np.allclose(got, want)


def preserved(x, y, k):
    """The share of the k nearest in x that are among the k nearest in y."""
    near = lambda z: [set(np.argsort(r, kind="stable")[1 : k + 1]) for r in ((z[:, None] - z[None]) ** 2).sum(2)]
    return np.mean([len(p & q) / k for p, q in zip(near(x), near(y))])


@pytest.mark.parametrize("options", [{}, {"init": "random"}, {"block": 40, "n_epochs": 200}, {"block": 64, "most": 12, "n_epochs": 200}])
def test_layout_keeps_neighbours(spark, options):
    rng = np.random.default_rng(3)
    kind = np.arange(150) % 3
    x = rng.normal(size=(3, 8))[kind] * 6 + rng.normal(size=(150, 8)) @ np.diag([1.5, 1, 0.3, 0.1, 0.1, 0.1, 0.1, 0.1])
    x[149] = x[146]
    cells = cells_of(spark, x)
    run = lambda: np.array([r["vec"] for r in umap.umap(cells, 2, n_neighbors=10, **options).orderBy("sample_id").collect()])
    y = run()
    assert y.shape == (150, 2) and np.isfinite(y).all()
    far = ((y[:, None] - y[None]) ** 2).sum(2)
    np.fill_diagonal(far, np.inf)
    assert np.mean(kind[far.argmin(1)] == kind) > 0.98
    assert preserved(x, y, 15) > 0.5 > 0.2 > preserved(x, rng.normal(size=(150, 2)), 15)
    if options.get("block") == 40:
        assert np.allclose(run(), y, atol=1e-6)


def test_odd_input(spark):
    x = np.arange(12.0).reshape(6, 2)
    cells = cells_of(spark, x)
    assert [len(r["vec"]) for r in umap.umap(cells, 3, n_neighbors=2, n_epochs=5).collect()] == [3] * 6
    same = umap.umap(cells_of(spark, np.ones((6, 2))), n_neighbors=3, n_epochs=5)
    assert all(np.isfinite(r["vec"]).all() for r in same.collect())
    gap = x.copy()
    gap[0, 0] = np.nan
    for bad, options in ((cells, {"n_neighbors": 6}), (cells, {"n_neighbors": 1}), (cells, {"min_dist": 2}), (cells, {"metric": "odd", "n_neighbors": 2}), (cells, {"n_components": 0}), (cells_of(spark, gap), {"n_neighbors": 2})):
        with pytest.raises(ValidationError):
            umap.umap(bad, **options)
