"""Nearest neighbours by cells, shells and blocks against numpy over all pairs."""

import numpy as np
import pytest

from quantgrid.operators.neighbors import nearest


def rows_of(spark, x, names, prefix="s"):
    rows = []
    for i, v in enumerate(x):
        seen = [(f, float(a)) for f, a in zip(names, v) if not np.isnan(a)]
        rows.append((f"{prefix}{i:04d}", [f for f, _ in seen], [a for _, a in seen]))
    return spark.createDataFrame(rows, "sample_id string, names array<string>, vec array<double>").repartition(4)


def brute(x, y, k, same):
    out = {}
    for i, a in enumerate(x):
        d = []
        for j, b in enumerate(y):
            shared = ~np.isnan(a) & ~np.isnan(b)
            if shared.any() and not (same and i == j):
                d.append((np.sqrt(np.mean((a[shared] - b[shared]) ** 2)), j))
        out[i] = [round(v, 6) for v, _ in sorted(d)[:k]]
    return out


def check(got, want):
    have = {}
    for r in got.orderBy("sample_id", "place").collect():
        have.setdefault(int(r["sample_id"][1:]), []).append(round(r["distance"], 6))
    for i, d in want.items():
        assert have.get(i, []) == pytest.approx(d, abs=2e-6), i


def clusters(rng, n, f, groups, spread=0.05):
    return rng.normal(size=(groups, f))[rng.integers(0, groups, n)] * 5 + rng.normal(size=(n, f)) * spread


@pytest.mark.parametrize("gaps", [0.0, 0.08, 0.6])
def test_blocks_against_all_pairs(spark, gaps):
    """Clusters, with few and many missing values: the same neighbours, and far fewer pairs where little is missing."""
    rng = np.random.default_rng(int(100 * gaps))
    x = clusters(rng, 300, 24, 12)
    x[:40] = x[0]  # a hot point: ties, dealt over blocks
    x[rng.random(x.shape) < gaps] = np.nan
    x[7] = np.nan
    x[:, 0][8:] = np.where(np.isnan(x[:, 0][8:]), 0.0, x[:, 0][8:])
    names, report = [f"f{i:02d}" for i in range(24)], {}
    check(nearest(rows_of(spark, x, names), 6, block=16, report=report), brute(x, x, 6, True))
    assert report["all"] == 300 * 300
    if gaps == 0.0:
        assert report["compared"] < report["all"] / 3


def test_others_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    x, y = clusters(rng, 90, 10, 5), clusters(rng, 200, 12, 6)
    y[rng.random(y.shape) < 0.1] = np.nan
    names, report = [f"f{i:02d}" for i in range(12)], {}
    wide = np.full((90, 12), np.nan)
    wide[:, :10] = x
    check(nearest(rows_of(spark, wide, names, "q"), 4, rows_of(spark, y, names), block=20, report=report), brute(wide, y, 4, False))
    assert report["compared"] <= report["all"]


def test_work_grows_less_than_pairs(spark):
    """Twice the samples of one mixture: pairs compared grow by clearly less than four times."""
    rng = np.random.default_rng(1)
    counts = []
    for n in (200, 800):
        report = {}
        nearest(rows_of(spark, clusters(rng, n, 8, 40, 0.01), [f"f{i}" for i in range(8)]), 3, block=20, report=report).count()
        counts.append(report["compared"])
    assert counts[1] < 10 * counts[0]  # 16 for all pairs


def test_few_rows(spark):
    x = np.array([[0.0, 1.0], [np.nan, np.nan], [0.0, 1.0], [5.0, np.nan]])
    rows = rows_of(spark, x, ["a", "b"])
    for block in (1, 2, 1024):
        check(nearest(rows, 3, block=block), brute(x, x, 3, True))
    assert nearest(rows.limit(0), 3).count() == 0 and nearest(rows, 3, rows.limit(0)).count() == 0
    first = nearest(rows, 1, block=2).where("sample_id = 's0003'").first()
    assert first["other"] == "s0000"  # a tie goes to the lesser id


def test_copies_are_at_no_distance(spark):
    """Copies of samples of large values with many gaps are at distance 0, lesser ids first, and each row is sent once a block."""
    rng = np.random.default_rng(3)
    x = np.repeat(np.round(rng.uniform(1e3, 1e5, (60, 40)), 2), 5, 0)
    x[np.repeat(rng.random((60, 40)) < 0.6, 5, 0)] = np.nan
    names, report = [f"f{i:02d}" for i in range(40)], {}
    got = nearest(rows_of(spark, x, names), 4, block=30, report=report).orderBy("sample_id", "place").collect()
    assert [r["distance"] for r in got] == [0.0] * 1200
    assert [r["other"] for r in got] == [f"s{j:04d}" for i in range(300) for j in range(i // 5 * 5, i // 5 * 5 + 5) if j != i]
    assert report["sent"] == 300 * 10


@pytest.mark.parametrize("kind", ["unit", "far", "copies", "missing"])
def test_a_block_keeps_its_nearest_of_all_chunks(monkeypatch, kind):
    """The nearest of a block that meets chunks one by one are those of numpy, and few pairs are measured by their differences."""
    from quantgrid.operators import neighbors

    rng = np.random.default_rng(8)
    x = rng.normal(size=(1600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "far":  # single precision can't tell the samples of a cluster apart
        x = x * 1e-6 + np.where(np.arange(1600) % 2, 1e3, -1e3)[:, None]
    if kind == "copies":
        x = np.repeat(x[:320], 5, 0)
    if kind == "missing":
        x[rng.random(x.shape) < 0.2] = np.nan
    measured, distances = [], neighbors.distances
    monkeypatch.setattr(neighbors, "distances", lambda a, b: measured.append(len(a)) or distances(a, b))
    chunks = [neighbors.Chunk(neighbors.pa.array([f"s{i:04d}" for i in range(a, a + 100)]), np.arange(16), x[a : a + 100]) for a in range(0, 1600, 100)]
    state = neighbors.Nearest(chunks[0], 6)
    state.meet(chunks[0], True)
    for c in chunks[1:]:
        state.meet(c)
    got = state.result().to_pydict()
    work = sum(measured)
    for i in range(100):
        d = distances(np.repeat(x[i : i + 1], 1600, 0), x)
        d[i] = np.inf
        best = np.lexsort((np.arange(1600), d))[:6]
        here = slice(6 * i, 6 * i + 6)
        assert got["sample_id"][here] == [f"s{i:04d}"] * 6 and got["other"][here] == [f"s{j:04d}" for j in best]
        assert got["distance"][here] == pytest.approx(d[best], abs=1e-12)
    if kind in ("unit", "missing"):
        assert work < 100 * 1600 / 4


def test_few_that_ask_many(spark):
    """One block of samples that ask, many chunks of others: dealt over tasks, the nearest of all."""
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(40, 12)), rng.normal(size=(500, 12))
    names, report = [f"f{i:02d}" for i in range(12)], {}
    check(nearest(rows_of(spark, x, names, "q"), 5, rows_of(spark, y, names), block=50, report=report), brute(x, y, 5, False))
    assert report["sent"] <= 540
