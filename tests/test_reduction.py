"""Wide PCA, Leiden communities, linkage and Harmony against numpy."""

import numpy as np
import pytest

from quantgrid.errors import ValidationError
from quantgrid.functions import metrics
from quantgrid.operators import harmony, linkage, reduce
from quantgrid.operators.matrix import row_arrays

from .test_scores import cells_of


@pytest.mark.parametrize("options", [{}, {"scale": True}, {"center": False}])
def test_randomized_pca(spark, options):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(70, 6)) @ rng.normal(size=(6, 120)) * 3 + rng.normal(size=(70, 120)) * 0.05 + 2
    x[:, 7] = 5.0
    cells = cells_of(spark, x)
    full, wide = (reduce.pca(cells, 4, svd_solver=s, **options) for s in ("full", "randomized"))
    for name, key in (("variance", "component"), ("loadings", "feature_id"), ("scores", "sample_id")):
        a, b = ({r[0]: np.atleast_1d(r[1]) for r in t[name].collect()} for t in (full, wide))
        assert a.keys() == b.keys() and all(np.allclose(a[i], b[i], atol=1e-5) for i in a), name
    a, b = ({r[0]: r["ratio"] for r in t["variance"].collect()} for t in (full, wide))
    assert all(a[i] == pytest.approx(b[i], abs=1e-7) for i in a)


def test_pca_of_50_000_features(spark):
    rng = np.random.default_rng(1)
    factors, axes = rng.normal(size=(24, 3)) * [9, 5, 2], np.linalg.qr(rng.normal(size=(50_000, 3)))[0].T
    x = factors @ axes + rng.normal(size=(24, 50_000)) * 1e-4
    rows = [(f"s{i:03d}", [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "sample_id string, vec array<double>").selectExpr("sample_id", "posexplode(vec) as (i, value)").selectExpr("sample_id", "lpad(i, 6, '0') as feature_id", "value", "0 as mask")
    found = reduce.pca(df, 3, iterations=2)
    got = [r["eigenvalue"] for r in found["variance"].orderBy("component").collect()]
    assert np.allclose(got, np.linalg.svd(x - x.mean(0), compute_uv=False)[:3] ** 2 / 23, rtol=1e-6)
    with pytest.raises(ValidationError):
        reduce.pca(df.where("not (sample_id = 's003' and feature_id = '000007')"), 3)


def edges_of(spark, pairs):
    return spark.createDataFrame([(f"n{a:02d}", f"n{b:02d}", float(w)) for i, j, w in pairs for a, b in ((i, j), (j, i))], "a string, b string, w double")


def test_leiden(spark):
    """A ring of cliques: the cliques come back, modularity never falls from level to level, every community is connected."""
    cliques, size = 5, 4
    pairs = [(c * size + i, c * size + j, 1) for c in range(cliques) for i in range(size) for j in range(i)]
    pairs += [(c * size, (c + 1) % cliques * size + 1, 1) for c in range(cliques)]
    edges, report = edges_of(spark, pairs), []
    got = {r["node"]: r["label"] for r in reduce.leiden(edges, rounds=4, report=report).collect()}
    assert len(got) == cliques * size and all(len({got[f"n{c * size + i:02d}"] for i in range(size)}) == 1 for c in range(cliques))
    assert len(set(got.values())) >= cliques // 2
    assert all(b >= a - 1e-9 for a, b in zip(report, report[1:]))
    rng = np.random.default_rng(2)
    random = [(i, j, int(rng.integers(1, 4))) for i in range(22) for j in range(i) if rng.random() < 0.15]
    edges, report = edges_of(spark, random), []
    labels = reduce.leiden(edges, resolution=1.2, rounds=4, report=report)
    got = {r["node"]: r["label"] for r in labels.collect()}
    assert all(b >= a - 1e-9 for a, b in zip(report, report[1:]))
    for label in set(got.values()):
        left = {n for n in got if got[n] == label}
        grow = [left.pop()]
        while grow:
            n = grow.pop()
            near = {b for i, j, _ in random for a, b in ((f"n{i:02d}", f"n{j:02d}"), (f"n{j:02d}", f"n{i:02d}")) if a == n} & left
            left -= near
            grow += near
        assert not left, label
    assert reduce.modularity(edges, labels, 1.2) == pytest.approx(report[-1])


def test_split_of_a_loose_community(spark):
    edges = edges_of(spark, [(0, 1, 1), (1, 2, 1), (3, 4, 1), (2, 3, 1)])
    labels = spark.createDataFrame([("n00", "x"), ("n01", "x"), ("n02", "y"), ("n03", "x"), ("n04", "x")], "node string, label string")
    assert {r["node"]: r["label"] for r in reduce.split(edges, labels).collect()} == {"n00": "n00", "n01": "n00", "n02": "n02", "n03": "n03", "n04": "n03"}


def test_connected_long_chain(spark):
    n = 40
    edges = edges_of(spark, [(i, i + 1, 1) for i in range(n) if i != 20])
    nodes = edges.selectExpr("a as node").distinct()
    got = {r["node"]: r["part"] for r in reduce.connected(edges, nodes).collect()}
    assert all(got[f"n{i:02d}"] == ("n00" if i <= 20 else "n21") for i in range(n + 1))


def brute_linkage(d, method):
    """Merges one by one by the least distance, ties by names; Lance and Williams' updates."""
    n = len(d)
    size, dist, out = {i: 1 for i in range(n)}, {(i, j): float(d[i, j]) for i in range(n) for j in range(i + 1, n)}, []
    while dist:
        i, j = min(dist, key=lambda p: (dist[p], p))
        h, ni, nj = dist.pop((i, j)), size[i], size.pop(j)
        for k in list(size):
            if k == i:
                continue
            x, y = dist[tuple(sorted((i, k)))], dist.pop(tuple(sorted((j, k))))
            if method == "ward":
                v = np.sqrt(((ni + size[k]) * x * x + (nj + size[k]) * y * y - size[k] * h * h) / (ni + nj + size[k]))
            else:
                v = {"single": min(x, y), "complete": max(x, y), "average": (ni * x + nj * y) / (ni + nj)}[method]
            dist[tuple(sorted((i, k)))] = v
        size[i] = ni + nj
        out.append((f"n{i:02d}", f"n{j:02d}", h, ni + nj))
    return out


@pytest.mark.parametrize("method", ["single", "average", "complete", "ward"])
def test_linkage(spark, method):
    x = np.random.default_rng(3).normal(size=(14, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    table = spark.createDataFrame([(f"n{i:02d}", f"n{j:02d}", float(d[i, j])) for i in range(14) for j in range(i)], "a string, b string, distance double")
    merges = linkage.linkage(table, method)
    got = [(r["a"], r["b"], r["n"], round(r["height"], 9)) for r in merges.orderBy("step").collect()]
    assert got == [(a, b, n, round(h, 9)) for a, b, h, n in brute_linkage(d, method)]
    order = [r["name"] for r in linkage.leaf_order(merges).orderBy("place").collect()]
    assert sorted(order) == [f"n{i:02d}" for i in range(14)]
    members = {f"n{i:02d}": {f"n{i:02d}"} for i in range(14)}
    for a, b, *_ in got:  # the leaves of every cluster stand side by side
        members[a] |= members.pop(b)
        at = sorted(order.index(m) for m in members[a])
        assert at[-1] - at[0] == len(at) - 1
    labels = {r["name"]: r["label"] for r in linkage.cut_tree(merges, 3).collect()}
    assert len(set(labels.values())) == 3


@pytest.mark.parametrize("method", ["single", "average", "complete", "ward"])
def test_linkage_in_few_jobs(spark, monkeypatch, method):
    x = np.random.default_rng(5).normal(size=(60, 2)).round(1)  # with copies and ties
    x[40:] = x[:20]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    table = spark.createDataFrame([(f"n{i:02d}", f"n{j:02d}", float(d[i, j])) for i in range(60) for j in range(i)], "a string, b string, distance double")
    expected = [round(h, 6) for _, _, h, _ in brute_linkage(d, method)] if method == "single" else None
    found = []
    for tail, most in ((linkage.TAIL, 16), (50, 200)):  # all rounds on the matrix; the first ones in Spark
        monkeypatch.setattr(linkage, "TAIL", tail)
        monkeypatch.setattr(linkage, "TOGETHER", 100)
        spark.sparkContext.setJobGroup(f"linkage {method} {tail}", "")
        found.append([(r["a"], r["b"], r["n"], round(r["height"], 6)) for r in linkage.linkage(table, method).orderBy("step").collect()])
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"linkage {method} {tail}")) <= most
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(found[0]) == sorted(found[1]) and len(found[0]) == 59
    assert expected is None or [h for *_, h in found[0]] == expected


def test_linkage_ties_and_few(spark):
    ring = [("n00", "n01", 1.0), ("n01", "n02", 1.0), ("n02", "n03", 1.0), ("n03", "n00", 1.0), ("n00", "n02", 1.0), ("n01", "n03", 1.0)]
    table = spark.createDataFrame(ring, "a string, b string, distance double")
    for method in linkage.METHODS:
        assert [r["n"] for r in linkage.linkage(table, method).orderBy("step").collect()][-1] == 4
    assert linkage.linkage(table.limit(0), "single").count() == linkage.linkage(table.limit(0), "ward").count() == 0
    loose = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 2.0)], "a string, b string, distance double")
    assert [tuple(r)[1:4] for r in linkage.linkage(loose, "single").orderBy("step").collect()] == [("a", "b", 1.0), ("c", "d", 2.0)]
    with pytest.raises(ValidationError):
        linkage.linkage(table, "median")


def brute_harmony(z, batch, k, start, rounds, inner, theta=2.0, lamb=1.0, sigma=0.1):
    n, b = len(z), batch.max() + 1
    onehot, unit = np.eye(b)[batch], lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    now, centre, seen, expected = z.copy(), start, np.ones((k, b)), np.ones((k, b))

    def soft():
        r = np.exp(-2 * (1 - unit(now) @ centre.T) / sigma) * (((expected + 1) / (seen + 1)) ** theta)[:, batch].T
        return r / r.sum(1, keepdims=True)

    for _ in range(rounds):
        for _ in range(inner):
            r = soft()
            centre, seen = unit(r.T @ unit(now)), r.T @ onehot
            expected = np.outer(r.sum(0), onehot.mean(0))
        r, fixed = soft(), z.copy()
        phi = np.column_stack([np.ones(n), onehot])
        for c in range(k):
            gram = phi.T @ (phi * r[:, [c]]) + np.diag([0.0] + [lamb] * b)
            w = np.linalg.solve(gram, phi.T @ (z * r[:, [c]]))
            w[0] = 0
            fixed -= r[:, [c]] * (phi @ w)
        now = fixed
    return now


def test_harmony(spark, monkeypatch):
    """As numpy does it from the same centres; batches mix: the batches' means come together, the clusters stay apart."""
    rng = np.random.default_rng(4)
    kind, batch = np.arange(80) % 2, (np.arange(80) // 2) % 2
    z = np.array([[6.0, 0, 1, 0], [0, 6.0, 0, 1]])[kind] + rng.normal(size=(80, 4)) * 0.3 + batch[:, None] * np.array([1.5, 1.0, -1.0, 0.5])
    start = np.array([[1.0, 0, 0.2, 0], [0, 1.0, 0, 0.2]])

    class Fixed:
        def __init__(self, **_):
            pass

        def fit(self, _):
            return self

        def clusterCenters(self):
            return list(start)

    cells = cells_of(spark, z)
    obs = spark.createDataFrame([(f"s{i:03d}", f"b{v}") for i, v in enumerate(batch)], "sample_id string, batch string")
    with monkeypatch.context() as m:
        m.setattr(harmony, "KMeans", Fixed)
        got = harmony.integrate_harmony(cells, obs, nclust=2, max_iter_harmony=2, max_iter_cluster=3, epsilon_cluster=0.0, epsilon_harmony=-1.0)
        have = np.array([r["value"] for r in got.orderBy("sample_id", "feature_id").collect()]).reshape(80, 4)
    unit = start / np.linalg.norm(start, axis=1, keepdims=True)
    assert np.allclose(have, brute_harmony(z, batch, 2, unit, 2, 3), atol=1e-8)
    gap = lambda x: max(np.linalg.norm(x[(kind == k) & (batch == 0)].mean(0) - x[(kind == k) & (batch == 1)].mean(0)) for k in (0, 1))
    assert gap(have) < 0.4 * gap(z) and np.linalg.norm(have[kind == 0].mean(0) - have[kind == 1].mean(0)) > 5
    labels = obs.select("sample_id", "batch").withColumnRenamed("batch", "label")
    mixed = [metrics.lisi(row_arrays(c), labels, 10).agg({"lisi": "avg"}).first()[0] for c in (cells, got)]
    assert mixed[1] > mixed[0] + 0.2
    with pytest.raises(ValidationError):
        harmony.integrate_harmony(cells, obs.selectExpr("sample_id", "'x' as batch"))
    with pytest.raises(ValidationError):
        harmony.integrate_harmony(cells, obs, sigma=0)


@pytest.mark.parametrize("method", ["average", "complete", "ward"])
def test_linkage_merges_copies_at_once(spark, monkeypatch, method):
    """10 copies each of 10 points: 9 rounds of Spark before, none now; the merges are those made one by one."""
    monkeypatch.setattr(linkage, "TAIL", 12)
    x = np.random.default_rng(6).normal(size=(10, 3))[np.random.default_rng(7).permutation(100) % 10]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    table = spark.createDataFrame([(f"n{i:02d}", f"n{j:02d}", float(d[i, j])) for i in range(100) for j in range(i)], "a string, b string, distance double")
    key = lambda a, b, n, h: (round(h, 9), n, a, b)
    want = sorted(key(a, b, n, h) for a, b, h, n in brute_linkage(d, method))
    for unique in (False, True):
        spark.sparkContext.setJobGroup(f"copies {method} {unique}", "")
        got = sorted(key(r["a"], r["b"], r["n"], r["height"]) for r in linkage.linkage(table, method, unique=unique).collect())
        assert got == want
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"copies {method} {unique}")) <= 18
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_copies_are_all_at_distance_0():
    names = list("abcdef")
    assert linkage.copies(names, [1, 2, 1, 1, 1, 0], [("a", "b"), ("b", "c"), ("d", "e")]) == [[3, 4]]  # a and c are apart
    assert linkage.copies(names, [2, 2, 2, 0, 0, 0], [("b", "c"), ("a", "c")]) == [[0, 1, 2]]
