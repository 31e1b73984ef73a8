"""Tables under several passes are computed once, and results of steps that were made lighter stay the same."""

from quantgrid.functions import benchmarks
from quantgrid.operators.harmony import integrate_harmony


def counted(spark, df):
    """df, and an accumulator that counts the rows that are computed of it."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


def test_holdout_computes_cells_once(spark):
    rows = [(f"s{i % 20}", f"f{i // 20}", float(i), i % 3) for i in range(600)]
    cells, seen = counted(spark, spark.createDataFrame(rows, "sample_id string, feature_id string, value double, mask int"))
    held = benchmarks.holdout(cells, 0.1)
    found = {r["mask"]: (r["n_observed"], r["n_held"]) for r in benchmarks.state_profile(held).collect()}
    assert found == {0: (200, 20), 1: (200, 20), 2: (200, 20)}
    assert seen.value == 600


def test_shifts_of_anchors_meet_as_vectors():
    """A sample's shift is the weighted mean of whole vectors, so that no row is made for an anchor's single feature."""
    import numpy as np
    import pyarrow as pa

    from quantgrid.operators.scanorama import weighted_means

    rng = np.random.default_rng(4)
    ids, w, x = [f"s{i % 3}" for i in range(12)], rng.random(12), rng.normal(size=(12, 5))
    out = weighted_means(pa.table({"sample_id": ids, "w": w, "shift": pa.array(list(x), pa.list_(pa.float64()))})).to_pydict()
    for i, name in enumerate(out["sample_id"]):
        mine = np.array(ids) == name
        assert np.allclose(out["bias"][i], np.average(x[mine], axis=0, weights=w[mine]))
    assert sorted(out["sample_id"]) == ["s0", "s1", "s2"]


def test_harmony_computes_cells_once(spark):
    rows = [(f"s{i % 12}", f"f{i // 12}", float(i % 7 + i % 12 % 2), 0) for i in range(36)]
    cells, seen = counted(spark, spark.createDataFrame(rows, "sample_id string, feature_id string, value double, mask int"))
    obs = spark.createDataFrame([(f"s{i}", str(i % 2)) for i in range(12)], "sample_id string, batch string")
    out = integrate_harmony(cells, obs, nclust=2, max_iter_harmony=1, max_iter_cluster=2).collect()
    assert len(out) == 36 and all(r["value"] is not None for r in out)
    assert seen.value == 36
