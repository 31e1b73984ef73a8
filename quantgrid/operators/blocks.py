"""Chunks of samples, one row each, and all pairs of them: a task reads the chunks of two files, so that no sample travels for its pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

NUMBERS = 1 << 19  # of the samples of a chunk

CHUNKS_SQL = "chunk int, ids array<string>, n binary, features binary, vec binary"
COLUMNS = ("chunk", "ids", "n", "features", "vec")


def lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a list column, and how many each row has."""
    whole = column.combine_chunks()
    return whole.flatten().to_numpy(zero_copy_only=False), np.diff(whole.offsets.to_numpy())


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The samples of a task in one row; their features once, where all have the same."""
    table = [b for b in batches if b.num_rows]
    if not table:
        return
    table = pa.Table.from_batches(table)
    features, n = lists(table["features"])
    alike = (n == n[0]).all() and (features.reshape(len(n), -1) == features[: n[0]]).all()
    parts = (n.astype(np.int64), features[: n[0]] if alike else features, lists(table["vec"])[0].astype(np.float64))
    ids = table["sample_id"].combine_chunks()
    yield pa.record_batch([table["chunk"][:1].combine_chunks(), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts)], names=COLUMNS)


def packed(df: DataFrame, n: int, long: float, least: int = 1) -> DataFrame:
    """Chunks of (sample_id, features, vec), whose n samples have `long` features in the mean; at least `least` chunks."""
    chunks = max(1, least, -(-n // max(1, int(NUMBERS // max(1.0, long)))))
    chunk = F.pmod(F.xxhash64("sample_id", F.lit(11)), F.lit(chunks)).cast("int").alias("chunk")
    return materialize(df.select("sample_id", "features", "vec", chunk).repartitionById(chunks, "chunk").mapInArrow(_pack, CHUNKS_SQL))


def pairs_of(left: DataFrame, right: DataFrame, condition: Column | None = None) -> DataFrame:
    """Each chunk of the left one beside each of the right one (x_ and y_ before their columns), in the order of the left ones.

    Tasks read the files of both: a Cartesian product, which neither sends nor broadcasts rows.
    """
    x, y = (df.select(*(F.col(c).alias(f"{side}_{c}") for c in COLUMNS)) for df, side in ((left, "x"), (right, "y")))
    x = x.hint("shuffle_replicate_nl")
    return x.crossJoin(y) if condition is None else x.join(y, condition)


def one_way() -> Column:
    """Of each two chunks one order of the two, half of each chunk's pairs as the left one; and each chunk beside itself."""
    x, y = F.col("x_chunk"), F.col("y_chunk")
    return (x == y) | ((F.pmod(x + y, F.lit(2)) == 0) == (x < y))


def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict]]:
    """The two chunks of each row; a chunk that stays is the same object."""
    kept: list[dict | None] = [None, None]
    for batch in batches:
        for r in range(batch.num_rows):
            for at, side in enumerate("xy"):
                chunk = batch[f"{side}_chunk"][r].as_py()
                if kept[at] is None or kept[at]["chunk"] != chunk:
                    numbers = {c: np.frombuffer(batch[f"{side}_{c}"][r].as_buffer(), kind) for c, kind in (("n", np.int64), ("features", np.int64), ("vec", np.float64))}
                    kept[at] = {"chunk": chunk, "ids": batch[f"{side}_ids"][r].values, **numbers}
            yield kept[0], kept[1]
