"""Scanorama against numpy: matches of all pairs of batches, the order of joining, shifts."""

import numpy as np
import pytest

from quantgrid.errors import ValidationError
from quantgrid.functions import metrics
from quantgrid.operators import neighbors, scanorama
from quantgrid.operators.matrix import row_arrays

from .test_scores import cells_of


def brute(x, batch, k, sigma, alpha):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    names, n = sorted(set(batch)), len(x)
    far = ((x[:, None] - x[None]) ** 2).sum(2)
    near = np.zeros((n, n), bool)
    for i in range(n):
        for b in set(names) - {batch[i]}:
            there = np.flatnonzero(batch == b)
            near[i, there[np.argsort(far[i, there], kind="stable")[:k]]] = True
    mutual = near & near.T
    share = lambda b, c: mutual[np.ix_(batch == b, batch == c)].any(1).mean()
    scores = sorted(((max(share(b, c), share(c, b)), b, c) for i, b in enumerate(names) for c in names[i + 1 :]), key=lambda r: (-r[0], r[1], r[2]))
    group, joined = {b: frozenset([b]) for b in names}, []
    for score, b, c in scores:
        if score <= alpha or group[b] == group[c]:
            continue
        ours, theirs = group[b], group[c]
        if len(ours) > 1 and len(theirs) == 1:
            ours, theirs = theirs, ours
        mine, other = (np.flatnonzero(np.isin(batch, list(g))) for g in (ours, theirs))
        pairs = [(i, j) for i in mine for j in other if mutual[i, j]]
        old = x.copy()
        for i in mine:
            w = np.array([np.exp(-sigma / 2 * ((old[i] - old[p]) ** 2).sum()) for p, _ in pairs])
            x[i] = old[i] + w @ np.array([old[q] - old[p] for p, q in pairs]) / w.sum()
        joined.append((b, c))
        for name in ours | theirs:
            group[name] = ours | theirs
    return x, joined


def batches(seed):
    """Four batches of two shared clusters with shifts; the last one is of a cluster of its own."""
    rng = np.random.default_rng(seed)
    batch = np.array([f"b{i}" for i in rng.permutation(np.repeat(range(4), [24, 18, 15, 9]))])
    kind = np.arange(len(batch)) % 2
    x = np.array([[6.0, 1, 1, 0, 2], [1, 6.0, 0, 2, 1]])[kind] + rng.normal(size=(len(batch), 5)) * 0.3
    x += np.array([{"b0": [0, 0, 0, 0, 0], "b1": [0.8, 0.8, -0.6, 0, 0], "b2": [0, 0, 1.0, 1.0, 0], "b3": [0, 0, 0, 0, 0]}[b] for b in batch])
    x[batch == "b3"] = np.array([-4.0, -4, 5, 5, -6]) + rng.normal(size=(9, 5)) * 0.1
    return x, batch, kind


def test_scanorama(spark):
    x, batch, kind = batches(0)
    cells = cells_of(spark, x)
    obs = spark.createDataFrame([(f"s{i:03d}", b) for i, b in enumerate(batch)], "sample_id string, batch string")
    report = []
    got = scanorama.integrate_scanorama(cells, obs, knn=3, report=report)
    have = np.array([r["value"] for r in got.orderBy("sample_id", "feature_id").collect()]).reshape(x.shape)
    want, joined = brute(x, batch, 3, 15.0, 0.1)
    assert [(b, c) for _, b, c, on in report if on] == joined and len(joined) >= 2
    assert np.allclose(have, want, atol=1e-8)
    few = scanorama.integrate_scanorama(cells, obs, knn=3, anchors=5)
    near = np.array([r["value"] for r in few.orderBy("sample_id", "feature_id").collect()]).reshape(x.shape)
    assert np.isfinite(near).all() and np.abs(near - have).mean() < 0.1
    labels = obs.where("batch <> 'b3'").withColumnRenamed("batch", "label")
    mixed = [metrics.lisi(row_arrays(c).join(labels, "sample_id", "left_semi"), labels, 10).agg({"lisi": "avg"}).first()[0] for c in (cells, got)]
    assert mixed[1] > mixed[0] + 0.2
    shared = batch != "b3"
    assert np.linalg.norm(have[shared & (kind == 0)].mean(0) - have[shared & (kind == 1)].mean(0)) > 0.5


def test_two_of_two_panoramas_and_axes(spark):
    """Two pairs of close batches form panoramas of their own, which are then joined; more axes than features change nothing."""
    rng = np.random.default_rng(5)
    batch = np.array([f"b{i % 4}" for i in range(48)])
    x = rng.normal(size=(48, 6)) * 0.3 + 3
    x[:, 0] += np.array([{"b0": 0.0, "b1": 0.0, "b2": 1.2, "b3": 1.2}[b] for b in batch])
    cells, obs = cells_of(spark, x), spark.createDataFrame([(f"s{i:03d}", b) for i, b in enumerate(batch)], "sample_id string, batch string")
    want, joined = brute(x, batch, 2, 15.0, 0.01)
    for dimred in (None, 6):
        report = []
        got = scanorama.integrate_scanorama(cells, obs, knn=2, alpha=0.01, dimred=dimred, report=report)
        have = np.array([r["value"] for r in got.orderBy("sample_id", "feature_id").collect()]).reshape(x.shape)
        assert [(b, c) for _, b, c, on in report if on] == joined and len(joined) == 3
        assert np.allclose(have, want, atol=1e-8)
    assert np.isfinite([r["value"] for r in scanorama.integrate_scanorama(cells, obs, dimred=3).collect()]).all()


def test_matches_of_large_batches(spark, monkeypatch):
    """Pair by pair, at once, or both: the same matches."""
    x, batch, _ = batches(1)
    rows = row_arrays(cells_of(spark, x)).join(spark.createDataFrame([(f"s{i:03d}", b) for i, b in enumerate(batch)], "sample_id string, batch string"), "sample_id")
    sizes = {b: int((batch == b).sum()) for b in set(batch)}
    want = {tuple(r) for r in neighbors.mutual_between(rows, 3, sizes).select("a", "b").collect()}
    assert want and all((b, a) in want for a, b in want)
    for block in (5, 16):
        monkeypatch.setattr(neighbors, "BLOCK", block)
        pairs = [tuple(r) for r in neighbors.mutual_between(rows, 3, sizes).select("a", "b").collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_odd_input(spark):
    x, batch, _ = batches(2)
    cells, obs = cells_of(spark, x), spark.createDataFrame([(f"s{i:03d}", b) for i, b in enumerate(batch)], "sample_id string, batch string")
    for bad, options in ((obs.selectExpr("sample_id", "'x' as batch"), {}), (obs.selectExpr("sample_id", "nullif(batch, 'b1') as batch"), {}), (obs, {"sigma": 0}), (obs, {"alpha": 1}), (obs, {"knn": 0})):
        with pytest.raises(ValidationError):
            scanorama.integrate_scanorama(cells, bad, **options)
    x[0] = 0
    zero = scanorama.integrate_scanorama(cells_of(spark, x), obs)
    assert zero.count() == x.size and not zero.where("value is null or isnan(value)").count()
    x[0, 0] = np.nan
    with pytest.raises(ValidationError):
        scanorama.integrate_scanorama(cells_of(spark, x), obs)
