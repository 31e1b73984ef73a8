"""Hold-out, scores of method selection, profiles on sparse pairs, and limma's small systems against numpy."""

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quantgrid.errors import ValidationError
from quantgrid.functions import benchmarks, metrics
from quantgrid.operators import aggregate, integrate, normalize
from quantgrid.operators.matrix import row_arrays
from quantgrid.plans import autoselect, plots


def cells_of(spark, x, mask=None):
    rows = [(f"s{i:03d}", f"F{j:03d}", None if np.isnan(v) else float(v), int(mask[i, j]) if mask is not None else 0) for i, row in enumerate(x) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "sample_id string, feature_id string, value double, mask int").repartition(4)


def test_holdout_counts(spark):
    rng = np.random.default_rng(0)
    x, mask = rng.normal(size=(40, 50)), rng.choice([0, 1, 2], (40, 50), p=[0.7, 0.2, 0.1])
    x[rng.random(x.shape) < 0.1] = np.nan
    cells, seen = cells_of(spark, x, mask), ~np.isnan(x)
    n = {m: int((seen & (mask == m)).sum()) for m in (0, 1, 2)}
    total = sum(n.values())
    for options, goal in (({"least": 128}, max(128, int(0.05 * total))), ({"most": 30}, 30), ({}, int(0.05 * total)), ({"least": 10**6}, total)):
        held = benchmarks.holdout(cells, 0.05, **options)
        assert held.columns == [*cells.columns, "held"] and held.count() == x.size
        rows = held.where("held").collect()
        got = Counter(r["mask"] for r in rows)
        assert sum(got.values()) == goal and all(r["value"] is not None for r in rows)
        assert all(abs(got[m] - goal * n[m] / total) < 1 for m in n)
    rows = benchmarks.holdout(cells, 0.5, state=2).where("held").collect()
    assert len(rows) == int(0.5 * n[2]) and {r["mask"] for r in rows} == {2}
    again = benchmarks.holdout(cells.repartition(7), 0.5, state=2).where("held").collect()
    assert {(r[0], r[1]) for r in rows} == {(r[0], r[1]) for r in again}
    other = benchmarks.holdout(cells, 0.5, 7, state=2).where("held").collect()
    assert {(r[0], r[1]) for r in rows} != {(r[0], r[1]) for r in other}
    assert benchmarks.holdout(cells.limit(0), 0.5, least=128).count() == 0
    assert benchmarks.holdout(cells, 0.5, state=6).where("held").count() == 0


def test_pair_agreement(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 12)) * np.array([9, 5, 3] + [0.2] * 9)
    rows = row_arrays(cells_of(spark, x))
    low = row_arrays(cells_of(spark, x[:, :3]))
    pairs = [(r["a"], r["b"]) for r in metrics.sampled_pairs(rows, 200, 50).collect()]
    assert len(pairs) == len(set(map(frozenset, pairs))) == 200 and all(a != b for a, b in pairs) and len({i for p in pairs for i in p}) == 50
    at = [(int(a[1:]), int(b[1:])) for a, b in pairs]
    d, e = (np.array([np.linalg.norm(y[i] - y[j]) for i, j in at]) for y in (x, x[:, :3]))
    assert metrics.pair_agreement(rows, low, 200, 50) == pytest.approx((1 + np.corrcoef(d, e)[0, 1]) / 2)
    assert metrics.pair_agreement(rows.limit(5), low) == 0.0
    assert metrics.sampled_pairs(rows.where("sample_id < 's004'"), 1000).count() == 6  # all pairs of four


def test_reduction_scores(spark):
    """Clear clusters kept by the scores: all four are high, and the weights are those of the four."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(3, 20)) * 6
    x = centre[np.arange(60) % 3] + rng.normal(size=(60, 20)) * 0.1
    cells = cells_of(spark, x)
    points = spark.createDataFrame([(f"s{i:03d}", [float(v) for v in row]) for i, row in enumerate((x - x.mean(0)) @ np.linalg.svd(x - x.mean(0))[2][:2].T)], "sample_id string, vec array<double>")
    got = autoselect.reduction_scores(cells, points)
    assert set(got) == set(autoselect.WEIGHTS["reduce"]) and sum(autoselect.WEIGHTS["reduce"].values()) == pytest.approx(1)
    assert got["variance_explained"] == 1.0 and got["reconstruction_error"] > 0.95 and got["clustering_potential"] > 0.9 and 0 < got["local_structure"] <= 1


def test_adaptive_threshold(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 30)) + np.linspace(0, 5, 30)
    cells = cells_of(spark, x)
    frequency = [r["frequency"] for r in normalize.rank_invariance(cells).collect()]
    want = np.clip(max(np.quantile(frequency, 0.95), 2 / 12), 0.01, 0.5)
    assert autoselect.adaptive_threshold(cells) == pytest.approx(want)
    assert autoselect.adaptive_threshold(cells.limit(0)) == 0.5


def test_saturation(spark):
    runs = spark.createDataFrame([("a", 1, 50), ("a", 2, 94), ("a", 3, 95), ("a", 4, 96), ("b", 1, 60), ("b", 2, 90)], "group string, place int, n_union long")
    assert [tuple(r) for r in plots.saturation(runs, 100).collect()] == [("a", 3)]  # b never sees 95 of the 100


def test_profile_of_many_samples():
    """A long chain and a dense set: levels as lstsq gives them; a set stands for itself; 20,000 samples take no matrix."""
    rng = np.random.default_rng(4)
    names = [f"s{i:05d}" for i in range(120)]
    edges = [(i, i + 1) for i in range(59)] + [(i, j) for i in range(60, 120) for j in range(i + 1, 120) if rng.random() < 0.3]
    pairs = pd.DataFrame({"protein": "p", "a": [names[i] for i, _ in edges], "b": [names[j] for _, j in edges], "ratio": rng.normal(size=len(edges)), "n": rng.integers(1, 9, len(edges))})
    got = aggregate.profile(pairs).set_index("sample_id")
    a = np.zeros((len(edges), 120))
    for k, (i, j) in enumerate(edges):
        a[k, j], a[k, i] = 1, -1
    w = np.sqrt(pairs["n"].to_numpy(float))
    want = np.linalg.lstsq(a * w[:, None], pairs["ratio"].to_numpy() * w, rcond=None)[0]
    used = [int(s[1:]) for s in got.index]
    for lo, hi in ((0, 60), (60, 120)):
        mine = [i for i in used if lo <= i < hi]
        mean = want[mine] - want[mine].mean()
        assert np.allclose(got.loc[[names[i] for i in mine], "level"], mean, atol=1e-8)
        assert got.loc[[names[i] for i in mine], "set"].nunique() == 1
    big = np.arange(20_000)
    x = aggregate.laplacian_solve(np.repeat(big[:-3], 3), np.repeat(big[:-3], 3) + np.tile([1, 2, 3], len(big) - 3), np.ones(3 * len(big) - 9), np.tile([1.0, 2.0, 3.0], len(big) - 3), len(big), tol=1e-9)
    assert np.allclose(np.diff(x), 1, atol=1e-3)


def test_pivoted_solve():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 4))
    x = np.column_stack([x, x[:, 0] + 2 * x[:, 1]])
    y = rng.normal(size=30)
    beta, rank = integrate.pivoted_solve(x.T @ x, x.T @ y)
    assert rank == 4 and (beta == 0).sum() == 1
    assert np.allclose(x @ beta, x @ np.linalg.lstsq(x, y, rcond=None)[0])
    assert integrate.pivoted_solve(np.zeros((2, 2)), np.zeros(2))[1] == 0


def test_limma_of_features_without_a_batch(spark):
    """Few samples, a batch without values in one feature, a numeric covariate: as pivoted columns of the whole design give it."""
    rng = np.random.default_rng(6)
    n = 18
    batch, group, age = np.arange(n) % 3, (np.arange(n) // 3) % 2, rng.normal(size=n)
    x = rng.normal(size=(n, 6)) + batch[:, None] + 2 * group[:, None] + age[:, None]
    x[batch == 2, 1] = np.nan
    x[3:, 2] = np.nan
    x[:, 3] = np.nan
    obs = spark.createDataFrame([(f"s{i:03d}", "abc"[batch[i]], f"g{group[i]}", float(age[i])) for i in range(n)], "sample_id string, batch string, group string, age double")
    got = {(r[0], r[1]): r[2] for r in integrate.integrate_limma(cells_of(spark, x), obs, covariates=("group", "age")).collect()}
    contrast = np.vstack([np.eye(2), [-1, -1]])[batch]
    design = np.column_stack([np.ones(n), group, age, contrast])
    for f in range(6):
        at = ~np.isnan(x[:, f])
        left, keep = design[at].copy(), []
        for _ in range(min(left.shape)):  # pivoted Gram-Schmidt
            size = (left**2).sum(0)
            size[keep] = -1
            p = int(np.argmax(size >= size.max() * (1 - 1e-9)))
            if size[p] <= 1e-9:
                break
            q = left[:, p] / np.sqrt(size[p])
            keep.append(p)
            left -= np.outer(q, q @ left)
        coef = np.zeros(5)
        coef[sorted(keep)] = np.linalg.lstsq(design[at][:, sorted(keep)], x[at, f], rcond=None)[0] if at.any() else 0
        want = x[:, f] - contrast @ coef[3:]
        for i in range(n):
            have = got[(f"s{i:03d}", f"F{f:03d}")]
            assert (have is None and np.isnan(want[i])) or have == pytest.approx(want[i], abs=1e-7), (i, f)
    with pytest.raises(ValidationError):
        integrate.integrate_limma(cells_of(spark, x), obs.withColumn("same", F.col("batch")), covariates=("same",))


def unsteady(df, column):
    """df whose column differs in its last digits each time it is computed, as means do whose sums are taken in another order."""

    def run(batches):
        for b in batches:
            x = b[column].to_numpy(zero_copy_only=False)
            yield b.set_column(b.schema.get_field_index(column), column, pa.array(x * (1 + 1e-12 * np.random.default_rng().random(len(x)))))

    return df.mapInArrow(run, df.schema)


def test_scores_that_are_computed_again_meet(spark):
    rng = np.random.default_rng(3)
    species, change = np.where(rng.random(300) < 0.4, "one", "other"), rng.normal(size=300)
    table = unsteady(spark.createDataFrame(list(zip(species.tolist(), change.tolist())), "species string, log2_fc double"), "log2_fc")
    got = benchmarks.ratio_metrics(table, spark.createDataFrame([("one", 0.0), ("other", 0.5)], "species string, fc double"), "one").first()
    one, other = change[species == "one"], change[species == "other"]
    won = (other[:, None] > one).mean()
    assert got["n"] == 300 and got["pairwise_auc"] == pytest.approx(max(won, 1 - won))
    assert got["changed_auc"] == pytest.approx((np.abs(other)[:, None] > np.abs(one)).mean())
    ranks = benchmarks.ranked(table, "log2_fc", "place").select("place").collect()
    assert sorted(r["place"] for r in ranks) == list(range(1, 301))
