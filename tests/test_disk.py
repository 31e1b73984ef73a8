"""Steps over pairs leave on disk what goes by the rows that come in, not by their pairs."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quantgrid.operators import aggregate, impute, neighbors, pairs


def shuffled(spark):
    """Bytes of the shuffle files that there are."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().endswith(".data"))


def left_on_disk(spark, make):
    spark._jvm.System.gc()
    before = shuffled(spark)
    make().write.format("noop").mode("overwrite").save()
    return shuffled(spark) - before


def test_maxlfq_sends_no_pairs(spark):
    """120 samples share 40 peptides of one protein, and another set of 120 shares 40 others: 571,200 pairs of values."""
    rng = np.random.default_rng(0)
    rows = [("P", f"F{p}", f"S{i}", float(rng.lognormal())) for p in range(80) for i in range(p // 40 * 120, p // 40 * 120 + 120)]
    df = spark.createDataFrame(rows, "protein string, feature_id string, sample_id string, value double").repartition(4)
    assert left_on_disk(spark, lambda: aggregate.maxlfq(df, 2)) < 100 * len(rows)
    assert aggregate.maxlfq(df, 2).count() == 240
    ratios = aggregate.pair_ratios(df.withColumnRenamed("value", "x"), 2)
    assert ratios.count() == 2 * 120 * 119 // 2


def test_polish_room_by_values():
    """A protein of 600,000 values takes less than 60 bytes a value, where it took 110."""
    rng = np.random.default_rng(1)
    samples = np.sort(rng.integers(0, 30_000, (20_000, 30)), 1).ravel()
    ends = pa.array((np.arange(20_001) * 30).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (np.array([f"{i:06d}" for i in range(30_000)])[samples], rng.lognormal(size=len(samples)))]
    rows = pa.table([pa.array(["P"] * 20_000), *lists], names=["protein", "samples", "x"])
    tracemalloc.start()
    found = aggregate._polish(2.0)(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == len(np.unique(samples)) and peak < 60 * len(samples)


def samples_of(spark, n, f=40):
    rng = np.random.default_rng(2)
    x = np.round(rng.uniform(0, 9, (n, f)), 3)
    x[rng.random(x.shape) < 0.6] = np.nan
    rows = [(f"s{i}", [f"f{j}" for j in np.flatnonzero(~np.isnan(v))], v[~np.isnan(v)].tolist()) for i, v in enumerate(x)]
    seen = ~np.isnan(x)
    met = (seen.astype(int) @ seen.T > 0).sum() - n
    return spark.createDataFrame(rows, "sample_id string, names array<string>, vec array<double>"), seen.sum() * 16, met // 2


def test_samples_do_not_travel_for_their_pairs(spark, monkeypatch):
    """Many chunks: each sample is dealt to its chunk once, and chunks meet in tasks that read them."""
    for name, value in (("LEAST", 8), ("WIDEST", 8), ("SIDE", 50)):
        monkeypatch.setattr(pairs, name, value)
    rows, size, met = samples_of(spark, 400)
    for measure in ("distance", "mismatch", "jaccard"):
        assert left_on_disk(spark, lambda measure=measure: pairs.all_pairs(rows, measure)) < 3 * size
    assert pairs.all_pairs(rows, "distance").count() == met


def test_samples_do_not_travel_for_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "SIDE", 50)
    rows, size, _ = samples_of(spark, 300)
    assert left_on_disk(spark, lambda: neighbors.nearest(rows, 1, block=4)) < 4 * size


@pytest.mark.parametrize("weights", ["uniform", "distance"])
def test_neighbours_values_do_not_travel_to_each_sample(spark, monkeypatch, weights):
    """Each value is sent to its feature, not with all others to 16 samples; the means are those of the nearest that have one."""
    monkeypatch.setattr(impute, "ASKING", 100)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(250, 60)), 3)
    x[rng.random(x.shape) < 0.5] = np.nan
    x[:, 7] = np.nan
    cells = spark.createDataFrame([(f"s{i}", f"f{j}", None if np.isnan(v) else float(v), 0) for i, row in enumerate(x) for j, v in enumerate(row)], "sample_id string, feature_id string, value double, mask int").repartition(4)
    assert left_on_disk(spark, lambda: impute.impute_knn(cells, weights=weights)) < 45 * x.size
    got = {(r["sample_id"], r["feature_id"]): (r["value"], r["mask"]) for r in impute.impute_knn(cells, weights=weights).collect()}
    assert len(got) == x.size
    d = np.array([[np.sqrt(np.nanmean((a - b) ** 2)) for b in x] for a in x])
    np.fill_diagonal(d, np.inf)
    for i in range(0, 250, 7):
        near = np.lexsort(([f"s{j}" for j in range(250)], d[i]))[:16]
        for j in range(60):
            some = [n for n in near if not np.isnan(x[n, j])][:5]
            w = np.ones(len(some)) if weights == "uniform" else 1 / d[i][some]
            seen = x[:, j][~np.isnan(x[:, j])]
            want = (w @ x[some, j] / w.sum() if some else seen.mean() if len(seen) else 0.0) if np.isnan(x[i, j]) else x[i, j]
            assert got[f"s{i}", f"f{j}"] == (pytest.approx(want), 5 if np.isnan(x[i, j]) else 0)
