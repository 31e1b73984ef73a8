"""Hand-computed cases and invariants of the operators."""

import pytest
from pyspark.sql import functions as F

from quantgrid.operators import aggregate, impute, normalize, qc
from quantgrid.model import MaskCode
from quantgrid.sources import tables
from quantgrid.streaming import ingest

PEPTIDES = ["pep1", "pep2", "pep3"]


def matrix(spark, *samples, masks=None):
    """Cells of samples S1, S2, ... by pep1, pep2, ...; None is missing."""
    out = [(f"S{i + 1}", f"pep{j + 1}", None if v is None else float(v), (masks or {}).get((i, j), 0)) for i, row in enumerate(samples) for j, v in enumerate(row)]
    return spark.createDataFrame(out, "sample_id string, feature_id string, value double, mask int")


def links(spark):
    return spark.createDataFrame([("pep1", "P1"), ("pep2", "P1"), ("pep3", "P2")], "source_id string, target_id string")


def values(cells):
    return {(r["sample_id"], r["feature_id"]): r["value"] for r in cells.collect()}


@pytest.mark.parametrize(
    "method, given, expect",
    [
        ("sum", [(1, 3, 5), (2, 4, None)], {("S1", "P1"): 4, ("S1", "P2"): 5, ("S2", "P1"): 6, ("S2", "P2"): None}),
        ("max", [(1, 3, 5), (2, 4, None)], {("S1", "P1"): 3, ("S1", "P2"): 5, ("S2", "P1"): 4, ("S2", "P2"): None}),
        ("mean", [(1, 3, 5), (2, 4, None)], {("S1", "P1"): 2, ("S1", "P2"): 5, ("S2", "P1"): 3, ("S2", "P2"): None}),
        ("median", [(1, 9, 5), (3, 7, 1)], {("S1", "P1"): 5, ("S1", "P2"): 5, ("S2", "P1"): 5, ("S2", "P2"): 1}),
    ],
)
def test_aggregate(spark, method, given, expect):
    assert values(aggregate.aggregate_to_protein(matrix(spark, *given), links(spark), method)) == expect


def test_aggregate_keeps_the_worst_mask(spark):
    out = aggregate.aggregate_to_protein(matrix(spark, (1, 3, 5), (2, 4, None), masks={(1, 2): int(MaskCode.LOD)}), links(spark), "sum")
    assert {(r["sample_id"], r["feature_id"]): r["mask"] for r in out.collect()}["S2", "P2"] == MaskCode.LOD


def test_top_one(spark):
    out = values(aggregate.aggregate_to_protein(matrix(spark, (1, 100, 5), (2, 200, 6)), links(spark), "top_n", top_n=1))
    assert (out["S1", "P1"], out["S2", "P1"]) == (100, 200)


@pytest.mark.parametrize("method", ["maxlfq", "tmp"])
def test_ratios_survive(spark, method):
    out = values(aggregate.aggregate_to_protein(matrix(spark, (10, 20, 5), (20, 40, 10)), links(spark), method))
    for protein in ("P1", "P2"):
        assert out["S2", protein] == pytest.approx(2 * out["S1", protein], rel=1e-4)


def test_quantile_of_two_rows(spark):
    out = values(normalize.norm_quantile(matrix(spark, (1, 2, 3), (10, 20, 30))))
    assert [out[s, p] for s in ("S1", "S2") for p in PEPTIDES] == [5.5, 11, 16.5] * 2


@pytest.mark.parametrize("method", sorted(set(impute.IMPUTERS) - {"none"}))
def test_imputers_fill_missing_cells_alone(spark, method):
    given = matrix(spark, *[[None if (7 * i + 3 * j) % 5 == 0 else 10 + i + 2 * j + (i * j) % 3 for j in range(8)] for i in range(10)])
    rounds = {"max_iter": 4} if method in ("lls", "bpca", "iterative_svd", "softimpute") else {}
    run = lambda: impute.IMPUTERS[method](given, **rounds)
    before, out = values(given), {(r["sample_id"], r["feature_id"]): r for r in run().collect()}
    again = values(run())
    assert out.keys() == before.keys()
    for place, old in before.items():
        assert out[place]["value"] is not None and out[place]["value"] == pytest.approx(again[place])
        assert (out[place]["mask"] == MaskCode.IMPUTED) == (old is None)
        assert old is None or out[place]["value"] == pytest.approx(old)


def test_wide_table(spark, tmp_path):
    path = tmp_path / "report.pg_matrix.tsv"
    path.write_text("Protein.Group\tProtein.Ids\tGenes\tS1.raw\tS2.raw\nP1\tP1\tG1\t100\t200\nP2\tP2\tG2\t300\t\n")
    ds = tables.load_quant_table(spark, f"file://{path}")
    layer = next(iter(next(iter(ds.assays.values())).layers.values()))
    found = {k: v for k, v in values(layer).items() if v is not None}
    assert found == {("S1", "P1"): 100, ("S1", "P2"): 300, ("S2", "P1"): 200}


def test_streamed_windows_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("ts", "event_type as key", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    ingest.windowed_means(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted((str(r["start"]), r["key"], r["n"]) for r in df.collect())
    assert key(spark.table("windows")) == key(ingest.windowed_means(events))


@pytest.mark.parametrize("name", ["preflight", "doublets", "low_quality_samples"])
def test_filters_compute_their_input_once(spark, name):
    """Thresholds need several passes; the table under them is computed once."""
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    rows = [(f"S{i}", f"F{j}", float(10 + i + j), 0) for i in range(12) for j in range(12)]
    given = spark.createDataFrame(rows, "sample_id string, feature_id string, value double, mask int").withColumn("value", F.udf(count, "double")("value")).repartition(3)
    out = getattr(qc, name)(given)
    assert (out["cells"] if name == "preflight" else out).toArrow().num_rows > 0
    assert seen.value == 144
