"""Samples as arrays over a fixed list of features, and sums over samples of feature by feature size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..model import CELL
from ..storage import once

CHUNK = 16_384  # numbers of a sum that travel together
MAX_FEATURES = 4096  # the sums hold its square; the driver sees one such matrix at a time


def by_sample() -> WindowSpec:
    return Window.partitionBy("sample_id")


def by_feature() -> WindowSpec:
    return Window.partitionBy("feature_id")


def beside(cells: DataFrame, key: str, **stats: Column) -> DataFrame:
    """cells with columns of statistics of each value of key: grouped, then joined, so that no task holds a key's cells.

    The grouped side has one row a key; Spark broadcasts it where it turns out small. cells are computed once for both sides.
    """
    cells = once(cells)
    return cells.join(cells.groupBy(key).agg(*(c.alias(n) for n, c in stats.items())), key)


def cosine_normalized(cells: DataFrame) -> DataFrame:
    """Each sample's values by the root of their squares' sum."""
    return beside(cells, "sample_id", __norm=F.sqrt(F.sum(F.col("value") ** 2))).withColumn("value", F.try_divide("value", "__norm")).select(*CELL)


def row_arrays(cells: DataFrame) -> DataFrame:
    """(sample_id, names, vec): each sample's observed features, ascending, and their values."""
    seen = cells.where("value is not null")
    pairs = seen.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("feature_id", "value"))).alias("x"))
    return pairs.select("sample_id", F.col("x.feature_id").alias("names"), F.col("x.value").alias("vec"))


def feature_list(rows: DataFrame) -> list[str]:
    """All features of row_arrays, ascending; at most MAX_FEATURES."""
    found = rows.select(F.explode("names").alias("f")).distinct().limit(MAX_FEATURES + 1).collect()
    if len(found) > MAX_FEATURES:
        raise ValidationError(f"more than {MAX_FEATURES} features")
    return sorted(r["f"] for r in found)


def check_width(rows: DataFrame) -> list[str]:
    return feature_list(rows)


def dense(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    """The samples of a batch over all features, NaN where there is no value."""
    place = {f: i for i, f in enumerate(features)}
    out = np.full((batch.num_rows, len(features)), np.nan)
    for i, (names, vec) in enumerate(zip(batch["names"].to_pylist(), batch["vec"].to_pylist())):
        out[i, [place[n] for n in names]] = vec
    return out


def summed(rows: DataFrame, task: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum over all batches of an array of `size` numbers: each task adds its own, then they are added by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += task(batch)
        for i in range(0, size, CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array([i // CHUNK], pa.int32()), pa.array([total[i : i + CHUNK].tobytes()], pa.binary())], ["part", "x"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x) for x in rows["x"].to_pylist()], axis=0)
        return pa.table({"part": rows["part"][:1], "x": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(size)
    for r in rows.mapInArrow(run, "part int, x binary").groupBy("part").applyInArrow(add, "part int, x binary").collect():
        out[r["part"] * CHUNK : r["part"] * CHUNK + len(r["x"]) // 8] = np.frombuffer(r["x"])
    return out


def gram_sums(rows: DataFrame, *, means: np.ndarray | None = None, means_only: bool = False, width: list[str]) -> tuple:
    """(samples, sums, counts) per feature; or (samples, Gram matrix of complete samples less the means)."""
    m = len(width)
    if means_only:
        both = summed(rows, lambda b: np.concatenate([[b.num_rows], np.nansum(x := dense(b, width), 0), (~np.isnan(x)).sum(0)]), 2 * m + 1)
        return int(both[0]), both[1 : m + 1], both[m + 1 :]

    def task(batch: pa.RecordBatch) -> np.ndarray:
        x = dense(batch, width) - means
        return np.concatenate([[len(x)], (x.T @ x).ravel()])

    both = summed(rows, task, m * m + 1)
    return int(both[0]), both[1:].reshape(m, m)
