"""Functions of the user's own on samples, features and whole layers, run by Spark in tasks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import CELL
from ..operators.matrix import dense, feature_list, row_arrays


def reduce_axis(cells: DataFrame, axis: str, fn: Callable[[np.ndarray], float], *, out: str = "value") -> DataFrame:
    """(axis, out): fn of the values that a sample or feature has, in ascending order of the other id."""
    other = "feature_id" if axis == "sample_id" else "sample_id"
    values = cells.where("value is not null").groupBy(axis).agg(F.array_sort(F.collect_list(F.struct(other, "value"))).alias("x")).select(axis, F.col("x.value").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [float(fn(np.array(x, float))) for x in batch["x"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch[axis], pa.array(found, pa.float64())], [axis, out])

    return values.mapInArrow(run, f"{axis} string, {out} double")


def map_samples(cells: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Cells with new values: fn takes some samples over all features (NaN: missing) and returns as many; masks stay.

    Samples come in batches, so fn must treat each on its own. For at most MAX_FEATURES features.
    """
    rows = row_arrays(cells)
    width = feature_list(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(width, object)
        for batch in batches:
            new = np.asarray(fn(dense(batch, width)), float)
            i, j = np.nonzero(~np.isnan(new))
            yield pa.RecordBatch.from_arrays([batch["sample_id"].take(pa.array(i)), pa.array(names[j], pa.string()), pa.array(new[i, j])], ["sample_id", "feature_id", "new"])

    new = rows.mapInArrow(run, "sample_id string, feature_id string, new double")
    return cells.join(new, ["sample_id", "feature_id"], "left").withColumn("value", F.col("new")).select(*CELL)


def apply_layer(cells: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The steps one after the other, each from cells to cells."""
    for step in steps:
        cells = step(cells).select(*CELL)
    return cells
