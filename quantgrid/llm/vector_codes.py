"""Product quantization of vectors in whole numbers: codebooks of a few entries for each part of a vector.

Each round the driver builds a kd-tree of every codebook and broadcasts them; tasks look each part up by branch and bound, and
send sums of the parts of every entry, from which the driver takes the new entries. What is broadcast and what comes back has
the size of the codebooks (parts * entries * components), whatever the number of rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import materialize
from .topk import quantized

LEAF = 8  # entries of a leaf
MOST = 1 << 62  # components are kept within plus and minus this
WIDE = pa.decimal128(38, 0)


class Tree:
    """A kd-tree over the rows of entries; node 0 is the root, and an inner node has no rows of its own."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.low, self.high = [], []
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray | None] = []
        if len(entries):
            self._grow(np.arange(len(entries)))

    def _grow(self, rows: np.ndarray) -> int:
        """Halve rows at the median of their widest component until LEAF or fewer are left."""
        at, low, high = len(self.low), self.entries[rows].min(0), self.entries[rows].max(0)
        self.low.append(low)
        self.high.append(high)
        self.children.append(None)
        self.rows.append(np.sort(rows) if len(rows) <= LEAF else None)
        if len(rows) > LEAF:
            widest = max(range(len(low)), key=lambda i: int(high[i]) - int(low[i]))
            half = np.array_split(rows[np.argsort(self.entries[rows, widest], kind="stable")], 2)
            self.children[at] = (self._grow(half[0]), self._grow(half[1]))
        return at

    def bound(self, node: int, points: np.ndarray) -> np.ndarray:
        """The least squared distance that an entry under node can have."""
        gap = np.maximum(np.maximum(self.low[node] - points, points - self.high[node]), 0)
        return (gap * gap).sum(1)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each point the nearest entry, the lowest index among equals, and the squared distance.

        Points go down together, each first into the child whose bound is lower. A node is left out only where its bound is
        above the best distance: at an equal bound it could still hold an equal entry of lower index.
        """
        far = np.inf if points.dtype == object else np.iinfo(np.int64).max
        best, index = np.full(len(points), far, points.dtype), np.full(len(points), len(self.entries))
        stack = [(0, np.arange(len(points)), self.bound(0, points))] if len(points) else []
        while stack:
            node, who, bound = stack.pop()
            who = who[bound <= best[who]]
            if not len(who):
                continue
            rows, children = self.rows[node], self.children[node]
            if children is None:
                gap = points[who][:, None, :] - self.entries[rows]
                d = (gap * gap).sum(2)
                pick = np.argmin(d, axis=1)  # the first of equals; rows ascend
                d, pick = d[np.arange(len(who)), pick], rows[pick]
                better = (d < best[who]) | ((d == best[who]) & (pick < index[who]))
                best[who[better]], index[who[better]] = d[better], pick[better]
                continue
            left, right = (self.bound(c, points[who]) for c in children)
            first = left <= right
            stack.append((children[1], who[first], right[first]))
            stack.append((children[0], who[~first], left[~first]))
            stack.append((children[0], who[first], left[first]))
            stack.append((children[1], who[~first], right[~first]))
        return index, best


def _matrices(batch: pa.RecordBatch, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, rows) of a batch: those whose distances fit in 64 bits, then the others as Python integers."""
    column = batch.column("vec")
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
    small = math.isqrt((1 << 60) // max(1, x.shape[1]))
    fits = ((x <= small) & (x >= -small)).all(1) & (least <= small)
    for rows, dtype in ((np.flatnonzero(fits), np.int64), (np.flatnonzero(~fits), object)):
        if len(rows):
            yield rows, x[rows].astype(dtype)


def _typed(trees: list[Tree], dtype) -> list[Tree]:
    return trees if dtype == np.int64 else [Tree(t.entries.astype(object)) for t in trees]


def _largest(codebooks: list[np.ndarray]) -> int:
    return max((abs(int(v)) for book in codebooks for v in book.ravel()), default=0)


def sum_parts(trees, entries: int):
    """Rows and sums of the parts of each entry: one row for every entry in use, from each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = trees.value
        width, largest = books[0].entries.shape[1], _largest([t.entries for t in books])
        count = np.zeros((len(books), entries), np.int64)
        sums = np.zeros((len(books), entries, width), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            for _, x in _matrices(batch, largest):
                for p, tree in enumerate(_typed(books, x.dtype)):
                    part = x[:, p * width : (p + 1) * width]
                    index, _ = tree.nearest(part)
                    count[p] += np.bincount(index, minlength=entries)
                    own = np.zeros((entries, width), x.dtype)
                    np.add.at(own, index, part)
                    sums[p] += own.astype(object)
        part, entry = np.nonzero(count)
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry])]
        columns += [pa.array([Decimal(int(v)) for v in sums[part, entry, i]], WIDE) for i in range(width)]
        yield pa.record_batch(columns, names=["part", "entry", "n", *(f"s{i}" for i in range(width))])

    return run



def look_up(trees):
    """code and error of every row; null errors where a long is too small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = trees.value
        width, largest = books[0].entries.shape[1], _largest([t.entries for t in books])
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.zeros((batch.num_rows, len(books)), np.uint8)
            errors: list[int | None] = [None] * batch.num_rows
            for rows, x in _matrices(batch, largest):
                total = 0
                for p, tree in enumerate(_typed(books, x.dtype)):
                    codes[rows, p], d = tree.nearest(x[:, p * width : (p + 1) * width])
                    total = total + d
                for row, error in zip(rows.tolist(), total.tolist()):
                    errors[row] = error if error < 1 << 63 else None
            texts = [row.tobytes().hex() for row in codes]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.record_batch([*kept, pa.array(texts, pa.string()), pa.array(errors, pa.int64())], names=[*batch.schema.names[:-1], "code", "error"])

    return run


def codebooks_digest(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(str(int(v)) for book in codebooks for v in book.ravel()).encode()).hexdigest()


def fit_codebooks(vectors: DataFrame, *, parts: int = 16, entries: int = 64, rounds: int = 2, vec_id: str = "vec_id", vec: str = "vec") -> list[np.ndarray]:
    """One array (entries, components) for each part, from whole-number vectors of one length.

    A codebook starts as the parts of the `entries` least ids in ascending order; rows of equal ids go by their vectors, null
    ids last. A table of fewer rows gives that many entries, an empty one none. Unused entries stay.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    x = F.col(vec).alias("vec")
    first = [r["vec"] for r in vectors.select(F.col(vec_id).alias("id"), x).orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).collect()]
    if not first:
        return [np.zeros((0, 0), np.int64)] * parts
    books = [np.array([row[i : i + len(row) // parts] for row in first], np.int64) for i in range(0, len(first[0]), len(first[0]) // parts)]
    width = books[0].shape[1]
    fields = ["part int", "entry int", "n long", *(f"s{i} decimal(38,0)" for i in range(width))]
    for _ in range(rounds):
        trees = vectors.sparkSession.sparkContext.broadcast([Tree(book) for book in books])
        sums = vectors.select(x).mapInArrow(sum_parts(trees, len(first)), ", ".join(fields))
        total = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(width)))
        books = [book.copy() for book in books]
        for row in total.collect():
            books[row["part"]][row["entry"]] = [int(row[f"s{i}"]) // row["n"] for i in range(width)]
        trees.destroy()
    return books


def compress_vectors(vectors: DataFrame, *, parts: int = 16, entries: int = 64, rounds: int = 2, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of each row; code holds two hex digits a part.

    Components become floor(256 * x), within plus and minus 2**62. Vectors that are null or hold a null or non-finite component
    are dropped. The codebooks are those of the length that the vector of the least id has (null ids last); rows whose length
    is another, or isn't a positive multiple of `parts`, stay with null code and error. label_error adds the errors of equal
    labels, nulls together. Rows that repeat an id each have a row of their own. error and label_error are null where a long
    is too small for them. Other columns don't matter.
    """
    spark = vectors.sparkSession
    kept = F.transform(quantized(F.col(embedding)), lambda v: F.greatest(F.least(v, F.lit(MOST)), F.lit(-MOST)))
    clean = materialize(vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), kept.alias("vec")).where("vec is not null"))
    whole = (F.size("vec") > 0) & (F.size("vec") % parts == 0)
    dims = clean.where(whole).select("vec_id", F.size("vec").alias("dims")).orderBy(F.col("vec_id").asc_nulls_last(), "dims").limit(1).collect()
    fits = F.size("vec") == (dims[0]["dims"] if dims else 0)
    books: list[np.ndarray] = []
    fields = [f for f in clean.schema.fields if f.name != "vec"] + [StructField("code", StringType()), StructField("error", LongType())]
    if dims:
        books = fit_codebooks(clean.where(fits), parts=parts, entries=entries, rounds=rounds)
        trees = spark.sparkContext.broadcast([Tree(book) for book in books])
        coded = clean.where(fits).mapInArrow(look_up(trees), StructType(fields))
        odd = clean.where(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        coded = coded.unionByName(odd)
    else:
        coded = clean.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = materialize(coded)
    totals = coded.groupBy(F.col("label").alias("same")).agg(F.try_sum("error").alias("label_error"))
    found = coded.join(totals, F.col("label").eqNullSafe(F.col("same")), "left")
    return found.select("vec_id", "label", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
