"""Nearest neighbours between samples, exact over shared features, without comparing all pairs.

Samples are dealt to the nearest of a few pivots (Voronoi cells), a cell is cut into shells by the distance from its pivot, and
a shell into blocks of bounded size. Each sample first searches the block where it would lie. That gives a kth distance, and it is
sent on only to the blocks that could hold a nearer one, by the triangle inequality. Where that is more than a grid of chunks would
take, each chunk of samples meets all others in tasks that read them from files, so that none is sent. The inequality is made to hold for missing
values too: a sum of squares over shared features is at most that over all observed ones, and at least that less the largest
squares, as many as features can be missing on the other side.

A feature travels as the 64-bit hash of its name, and values as one array of doubles, so that numpy alone lays out a block.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..storage import materialize, once
from . import blocks
from .blocks import lists as _lists

BLOCK = 1024  # samples of a block, and of those that meet it in a task
PIVOTS, PIVOT_CELLS = 256, 1 << 22  # pivots, and numbers in all of them
SHELLS = 64  # of a cell
SLACK = 1e-9  # relative, for sums in another order
NOISE = 1e-12  # of the largest square, for products of matrices
TILE = 1 << 21  # distances at a time
SIDE = 12  # blocks of the grid, before they are as large as they may be; how often a sample may be sent
ROOM, WIDEST = 1 << 22, 1 << 15  # numbers and samples of a block of the grid

FOUND = "sample_id string, other string, distance double"
KINDS = pa.schema([("sample_id", pa.string()), ("other", pa.string()), ("distance", pa.float64())])


def _dense(*tables: pa.Table) -> list[np.ndarray]:
    """The rows of tables over all features that any of them has."""
    lists = [_lists(t["features"]) for t in tables]
    names = np.unique(np.concatenate([x for x, _ in lists]))
    out = []
    for t, (features, n) in zip(tables, lists):
        x = np.full((t.num_rows, len(names)), np.nan)
        x[np.repeat(np.arange(t.num_rows), n), np.searchsorted(names, features)] = _lists(t["vec"])[0]
        out.append(x)
    return out


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Root mean square of the differences of rows side by side over the features that both have; infinite where there are none."""
    d = x - y
    both = ~np.isnan(d)
    n = both.sum(1)
    return np.where(n > 0, np.sqrt(np.square(np.where(both, d, 0.0)).sum(1) / np.maximum(n, 1)), np.inf)


def _best(own: pa.ChunkedArray, ids: pa.ChunkedArray, a: np.ndarray, b: np.ndarray, k: int, same: bool, limit: np.ndarray | None = None) -> pa.Table:
    """The k nearest rows of b for each row of a, ties by id; not itself, if `same`. With limits, none farther, and i, the row of a.

    Products of matrices find all that could be among them, in spite of rounding; these few are measured by their differences.
    """
    ma, mb = ~np.isnan(a), ~np.isnan(b)
    y = np.where(mb, b, 0.0)
    full, squares, top = ma.all() and mb.all(), y * y, np.square(y).max(initial=0.0)
    fa, fb = ma.astype(np.float32), mb.astype(np.float32)
    sums = squares.sum(1) if full else mb.astype(float)
    rank = np.empty(len(b), np.int64)
    names = np.array(ids.to_pylist(), object)
    rank[np.argsort(names, kind="stable")] = np.arange(len(b))
    at = pc.index_in(own, ids.combine_chunks()).to_numpy(zero_copy_only=False) if same else None  # NaN where absent
    found = []
    for start in range(0, len(a), max(1, TILE // max(1, len(b)))):
        part = slice(start, start + max(1, TILE // max(1, len(b))))
        x = np.where(ma[part], a[part], 0.0)
        mean = x @ y.T
        mean *= -2
        if full:
            mean += (x * x).sum(1)[:, None]
            mean += sums
            mean /= max(1, a.shape[1])
        else:
            mean += (x * x) @ sums.T
            mean += ma[part].astype(float) @ squares.T
            shared = fa[part] @ fb.T
            mean /= np.maximum(shared, 1)
            mean[shared == 0] = np.inf
        if same:
            here = at[part].astype(float)
            rows = np.flatnonzero(~np.isnan(here))
            mean[rows, here[rows].astype(np.int64)] = np.inf
        noise = NOISE * (np.square(x).max(1, initial=0.0) + top)
        kth = np.full(len(x), np.inf) if limit is None else limit[part] ** 2 * (1 + SLACK)
        if k < len(b) and np.isinf(kth).any():
            kth = np.minimum(kth, np.partition(mean, k - 1, axis=1)[:, k - 1])
        i, j = np.nonzero((mean <= (kth + noise)[:, None]) & np.isfinite(mean))
        d = np.concatenate([np.zeros(0), *(distances(a[i[n : n + BLOCK] + start], b[j[n : n + BLOCK]]) for n in range(0, len(i), BLOCK))])
        order = np.lexsort((rank[j], d, i))
        i, j, d = i[order], j[order], d[order]
        good = np.arange(len(i)) - np.searchsorted(i, i) < k
        found.append((i[good] + start, j[good], d[good]))
    i, j, d = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    if limit is not None:
        return pa.table({"i": pa.array(i, pa.int64()), "other": ids.take(pa.array(j)), "distance": pa.array(d, pa.float64())})
    return pa.table([own.take(pa.array(i)), ids.take(pa.array(j)), pa.array(d, pa.float64())], schema=KINDS)


class Shells(NamedTuple):
    """Of each shell its cell, number and blocks; the nearest and farthest distance of its samples, what they miss and hold."""

    features: np.ndarray
    pivots: np.ndarray
    cell: np.ndarray
    shell: np.ndarray
    deals: np.ndarray
    near: np.ndarray
    far: np.ndarray
    missing: np.ndarray
    most: np.ndarray


def _residuals(batch: pa.RecordBatch, features: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, present, pivots) of a batch over all features that it or a pivot has; a pivot is 0 where it has no value."""
    names, n = _lists(pa.chunked_array([batch.column("features")]))
    every = np.union1d(features, names)
    x = np.full((batch.num_rows, len(every)), np.nan)
    x[np.repeat(np.arange(batch.num_rows), n), np.searchsorted(every, names)] = _lists(pa.chunked_array([batch.column("vec")]))[0]
    p = np.zeros((len(pivots), len(every)))
    p[:, np.searchsorted(every, features)] = pivots
    present = ~np.isnan(x)
    return np.where(present, x, 0.0), present, p


def _squares(x: np.ndarray, present: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Sums of squared differences between rows and pivots over the rows' own features."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ p.T + present @ (p * p).T, 0)


def _largest(x: np.ndarray, present: np.ndarray, p: np.ndarray, count: int) -> np.ndarray:
    """For each row the sum of the `count` largest squared differences from one pivot (a row each, or one for all)."""
    r = np.where(present, (x - p) ** 2, 0.0)
    if count <= 0:
        return np.zeros(len(x))
    return np.partition(r, -count, axis=1)[:, -count:].sum(1) if count < r.shape[1] else r.sum(1)


def _assign(features: np.ndarray, pivots: np.ndarray, missing: int):
    """Adds each sample's cell, its distance from the pivot, and the least that this is over any features it could share."""

    def run(batches):
        for batch in batches:
            x, present, p = _residuals(batch, features, pivots)
            square = _squares(x, present, p)
            cell = square.argmin(1) if len(p) else np.zeros(len(x), np.int64)
            own = square[np.arange(len(x)), cell] if len(p) else (x * x).sum(1)
            less = np.maximum(own - _largest(x, present, p[cell] if len(p) else 0.0, missing), 0)
            new = [pa.array(cell.astype(np.int32)), pa.array(np.sqrt(own)), pa.array(np.sqrt(less))]
            yield pa.record_batch([*batch.columns, *new], names=[*batch.schema.names, "cell", "far", "near"])

    return run


def _visits(shells: Shells, count: bool = False):
    """The blocks that could hold a nearer sample than the kth found so far, each with the asking sample; or only their number."""
    columns = ["sample_id", "features", "vec"]

    def run(batches):
        of_cell = [np.flatnonzero(shells.cell == c) for c in range(len(shells.pivots))]
        for batch in batches:
            if not batch.num_rows:
                continue
            x, present, p = _residuals(batch, shells.features, shells.pivots)
            outer = np.sqrt(_squares(x, present, p))
            held, limit = present.sum(1), batch.column("limit").to_numpy(zero_copy_only=False)
            rows, found = [], []
            for c, own in enumerate(of_cell):
                if not len(own):
                    continue
                missing = int(shells.missing[own].max())
                inner = np.sqrt(np.maximum(outer[:, c] ** 2 - _largest(x, present, p[c], missing), 0)) if 2 * missing < x.shape[1] else np.zeros(len(x))
                shared = np.minimum(held[:, None], shells.most[own])
                bound = np.maximum(np.maximum(inner[:, None] - shells.far[own], shells.near[own] - outer[:, c][:, None]), 0) / np.sqrt(np.maximum(shared, 1))
                i, j = np.nonzero(bound * (1 - SLACK) - SLACK <= limit[:, None])
                rows.append(i)
                found.append(own[j])
            i, s = np.concatenate(rows), np.concatenate(found)
            n = shells.deals[s]
            i, s, deal = np.repeat(i, n), np.repeat(s, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            home = [batch.column(name).to_numpy(zero_copy_only=False)[i] for name in ("cell", "shell", "deal")]
            new = ~((shells.cell[s] == home[0]) & (shells.shell[s] == home[1]) & (deal == home[2]))
            if count:
                yield pa.record_batch([pa.array([int(new.sum())])], names=["n"])
                continue
            i, s, deal = i[new], s[new], deal[new]
            for at in range(0, len(i), BLOCK):
                part = slice(at, at + BLOCK)
                taken = [batch.column(name).take(pa.array(i[part])) for name in columns]
                yield pa.record_batch([*taken, *(pa.array(v[part].astype(np.int32)) for v in (shells.cell[s], shells.shell[s], deal))], names=[*columns, "cell", "shell", "deal"])

    return run


def _search(asked: DataFrame, held: DataFrame, k: int, same: bool, key: list[str]) -> DataFrame:
    """The k best of each block for the samples that are sent to it. Many of these are dealt, and the block goes to each deal."""
    chunks = materialize(asked.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("chunks")))
    columns = lambda: [F.col(c).alias(c) for c in ("sample_id", "features", "vec", *key)]
    left = asked.join(chunks, key).select(*columns(), F.pmod(F.xxhash64("sample_id", F.lit(7)), F.col("chunks")).cast("int").alias("chunk"))
    right = held.join(chunks, key).select(*columns(), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return KINDS.empty_table()
        return _best(x["sample_id"], y["sample_id"], *_dense(x, y), k, same)

    return left.groupBy(*key, "chunk").cogroup(right.groupBy(*key, "chunk")).applyInArrow(best, FOUND)


class Chunk(NamedTuple):
    """Samples over their own features, ascending by their hashes; NaN where there is no value."""

    ids: pa.Array
    names: np.ndarray
    x: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Chunk:
        n, features, values = row["n"], row["features"], row["vec"]
        names = np.unique(features)
        x = np.full((len(n), len(names)), np.nan)
        features = features if len(features) == len(values) else np.tile(features, len(n))
        x[np.repeat(np.arange(len(n)), n), np.searchsorted(names, features)] = values
        return cls(row["ids"], names, x)

    @classmethod
    def joined(cls, chunks: list[Chunk]) -> Chunk:
        names = np.unique(np.concatenate([c.names for c in chunks]))
        return cls(pa.concat_arrays([c.ids for c in chunks]), names, np.concatenate([c.over(names) for c in chunks]))

    def over(self, names: np.ndarray) -> np.ndarray:
        if np.array_equal(names, self.names):
            return self.x
        x = np.full((len(self.x), len(names)), np.nan)
        x[:, np.searchsorted(names, self.names)] = self.x
        return x


class Nearest:
    """The k nearest of each sample of a chunk among all those that it meets, chunk by chunk; ties by id.

    A sample's kth distance so far bounds what can still be among its nearest, so that of a chunk's products hardly any is looked
    at again. Where no value is missing, products are of single precision and centred: whatever their rounding could hide is
    measured by its differences. Where that is too much, and where values are missing, products are of double precision.
    """

    def __init__(self, own: Chunk, k: int):
        self.own, self.k, self.held, self.held_rows = own, k, [], 0
        self.full, self.wide = not np.isnan(own.x).any(), False
        n = len(own.x)
        self.i, self.d, self.other = np.zeros(0, np.int64), np.zeros(0), pa.array([], pa.string())
        self.limit = np.full(n, np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.pending = 0
        if self.full:
            self.centre = own.x.mean(0) if n else np.zeros(own.x.shape[1])
            x = own.x - self.centre
            self.square = (x * x).sum(1)
            self.scale = math.sqrt(self.square.max(initial=0.0)) or 1.0
            self.sides = {np.float64: np.hstack([x / self.scale, np.ones((n, 1))])}
            self.sides[np.float32] = self.sides[np.float64].astype(np.float32)

    def meet(self, chunk: Chunk, same: bool = False) -> None:
        """Take in the samples of a chunk; `same`: some of them are the own ones, none of which is its own neighbour."""
        if self.full and np.array_equal(chunk.names, self.own.names) and not np.isnan(chunk.x).any():
            self._products(chunk, same)
        elif same:
            self._missing(chunk, same)
        else:
            self.held.append(chunk)
            self.held_rows += len(chunk.x)
            if self.held_rows * len(chunk.names) >= ROOM or self.held_rows >= WIDEST:
                self._missing(self._release(), same)

    def _release(self) -> Chunk:
        chunk, self.held, self.held_rows = Chunk.joined(self.held), [], 0
        return chunk

    def _missing(self, chunk: Chunk, same: bool) -> None:
        names = np.union1d(self.own.names, chunk.names)
        t = _best(pa.chunked_array([self.own.ids]), pa.chunked_array([chunk.ids]), self.own.over(names), chunk.over(names), self.k, same, self.limit)
        self._add(t["i"].to_numpy(), t["distance"].to_numpy(), t["other"].combine_chunks())

    def _products(self, chunk: Chunk, same: bool) -> None:
        n, width = len(chunk.x), chunk.x.shape[1]
        y = (chunk.x - self.centre) / self.scale
        half = (y * y).sum(1) / 2
        top = math.sqrt(2 * half.max(initial=0.0))
        kind = np.float64 if self.wide or not top < 1e12 else np.float32
        names = np.array(chunk.ids.to_pylist(), object)
        rank = np.empty(n, np.int64)
        rank[np.argsort(names, kind="stable")] = np.arange(n)
        at = pc.index_in(self.own.ids, chunk.ids).fill_null(-1).to_numpy(zero_copy_only=False) if same else np.full(len(self.own.x), -1)
        rows = max(1, TILE // 2 // max(1, n))
        square = self.square / self.scale**2
        for start in range(0, len(self.own.x), rows):
            part = slice(start, start + rows)
            for kind in (kind, np.float64):
                error = (width + 8) * np.finfo(kind).eps * (np.sqrt(square[part]) * top + top * top / 2 + square[part]) + 1e-30
                s = self.sides[kind][part] @ np.hstack([y, -half[:, None]]).astype(kind).T
                own = np.flatnonzero(at[part] >= 0)
                s[own, at[part][own]] = -np.inf
                limit = self.limit[part]
                least = (square[part] - limit**2 * max(1, width) / self.scale**2 * (1 + SLACK)) / 2 - error
                if not np.isfinite(limit).all() and n > self.k:
                    least = np.maximum(least, np.partition(s, n - self.k, axis=1)[:, n - self.k] - 2 * error)
                hit = np.flatnonzero(s >= np.maximum(least, -np.finfo(kind).max).astype(kind)[:, None])
                if kind is np.float64 or len(hit) <= 8 * self.k * len(s) + BLOCK:
                    break
                self.wide = True  # single precision tells too few apart
            if not len(hit):
                continue
            i, j = np.divmod(hit, n)
            d = np.concatenate([distances(self.own.x[i[m : m + BLOCK] + start], chunk.x[j[m : m + BLOCK]]) for m in range(0, len(i), BLOCK)])
            good = (d <= limit[i]) & np.isfinite(d)
            i, j, d = i[good], j[good], d[good]
            order = np.lexsort((rank[j], d, i))
            i, j, d = i[order], j[order], d[order]
            good = np.arange(len(i)) - np.searchsorted(i, i) < self.k
            self._add(i[good] + start, d[good], chunk.ids.take(pa.array(j[good])), last=False)
        self._merge(self.k * len(self.own.x))

    def _add(self, i: np.ndarray, d: np.ndarray, other: pa.Array, last: bool = True) -> None:
        self.found.append((i, d, other))
        self.pending += len(i)
        if last:
            self._merge(0)

    def _merge(self, least: int) -> None:
        """Keep the k nearest of all found, once there are `least` new ones, and lower the limits."""
        if not self.found or (self.pending < least and np.isfinite(self.limit).all()):
            return
        i, d = (np.concatenate([own, *(f[c] for f in self.found)]) for c, own in ((0, self.i), (1, self.d)))
        other = pa.concat_arrays([self.other, *(f[2] for f in self.found)])
        order = np.lexsort((d, i))
        if ((np.diff(i[order]) == 0) & (np.diff(d[order]) == 0)).any():
            order = np.lexsort((pc.rank(other, tiebreaker="dense").to_numpy(), d, i))
        i, d = i[order], d[order]
        good = np.arange(len(i)) - np.searchsorted(i, i) < self.k
        self.i, self.d, self.other = i[good], d[good], other.take(pa.array(order[good]))
        count = np.bincount(self.i, minlength=len(self.limit))
        last = np.cumsum(count)[count >= self.k] - 1
        self.limit[count >= self.k] = self.d[last]
        self.found, self.pending = [], 0

    def result(self) -> pa.RecordBatch:
        if self.held:
            self._missing(self._release(), False)
        self._merge(0)
        return pa.record_batch([self.own.ids.take(pa.array(self.i)), self.other, pa.array(self.d, pa.float64())], schema=KINDS)


def _stream(k: int, same: bool):
    """Rows are a chunk beside each of those that it meets, chunk after chunk; `same`: also beside itself."""

    def run(batches):
        own, state = None, None
        for x, y in blocks.sides(batches):
            if x is not own:
                if state is not None:
                    yield state.result()
                own, state = x, Nearest(Chunk.of(x), k)
            state.meet(Chunk.of(y), same and x["chunk"] == y["chunk"])
        if state is not None:
            yield state.result()

    return run


def _grid(asked: DataFrame, held: DataFrame, k: int, same: bool, sides: int, long: float, sizes: tuple[int, int]) -> DataFrame:
    """The k nearest of `held` for all samples, of each file of chunks of `held`: each chunk of `asked` meets all of them.

    A task reads two files; it holds a chunk, its results and those that it meets. What travels are k nearest for each file.
    """
    chunks = blocks.packed(held, sizes[1], long, sides if same else 1)
    own = chunks if same else blocks.packed(asked, sizes[0], long, sides)
    return blocks.pairs_of(own, chunks).mapInArrow(_stream(k, same), FOUND)


def nearest(rows: DataFrame, k: int, others: DataFrame | None = None, *, block: int = BLOCK, report: dict | None = None) -> DataFrame:
    """(sample_id, other, distance, place): the k nearest of `others` (or of rows, less itself) for each row; ties by id.

    rows and others are (sample_id, names, vec). The distance is the root mean square of the differences over shared features;
    samples that share none aren't neighbours. `report` takes the number of pairs compared, and that of all pairs.
    """
    same = others is None
    slim = lambda df: df.select(F.col("sample_id").alias("sample_id"), F.transform("names", lambda x: F.xxhash64(x)).alias("features"), F.col("vec").alias("vec"))
    held = once(slim(rows if same else others))
    asked = held if same else once(slim(rows))
    place = F.row_number().over(Window.partitionBy("sample_id").orderBy("distance", "other"))
    ranked = lambda found: found.withColumn("place", place).where(F.col("place") <= k)
    n = held.count()
    m = n if same else asked.count()
    if report is not None:
        report["all"] = n * m
    if n <= block:
        if report is not None:
            report["compared"] = report["all"]
        one = F.lit(0).alias("block")
        return ranked(_search(asked.withColumn("block", one), held.withColumn("block", one), k, same, ["block"]))

    size = F.size("features")
    width = held.select(F.explode("features").alias("f")).distinct().count()
    long, least = held.agg(F.avg(size), F.min(size)).first()
    most = max(block, min(WIDEST, int(ROOM // max(1.0, long or 0.0))))
    sides = max(1, -(-m // min(max(block, -(-m // SIDE)), most)))

    def whole() -> DataFrame:
        if report is not None:
            report["compared"], report["sent"] = report["all"], n * sides if same else m + n * sides
        return ranked(_grid(asked, held, k, same, sides, long or 1.0, (m, n)))

    # What can be missing on the side that asks, where it meets a sample that is held.
    gap = max(0, width - ((least if same else asked.agg(F.min(size)).first()[0]) or 0))
    gap = width if 2 * gap >= width else gap
    if 2 * (long or 0) <= width:  # no bound excludes anything
        return whole()
    first = held.orderBy(F.xxhash64("sample_id", F.lit(3)), "sample_id").limit(max(1, min(PIVOTS, 2 * math.isqrt(n // block) + 2))).collect()
    names = np.unique(np.concatenate([r["features"] for r in first])) if first else np.zeros(0, np.int64)
    first = first[: max(1, PIVOT_CELLS // max(1, len(names)))]
    pivots = np.full((len(first), len(names)), np.nan)
    for i, r in enumerate(first):
        pivots[i, np.searchsorted(names, r["features"])] = r["vec"]
    count = (~np.isnan(pivots)).sum(0)
    pivots = np.where(np.isnan(pivots), np.nansum(pivots, 0) / np.maximum(count, 1), pivots)
    kinds = lambda df: StructType([*df.schema.fields, StructField("cell", IntegerType()), StructField("far", DoubleType()), StructField("near", DoubleType())])
    held = materialize(held.mapInArrow(_assign(names, pivots, gap), kinds(held)))
    steps = [(i + 1) / SHELLS for i in range(SHELLS - 1)]
    cells = held.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("far", steps).alias("steps")).collect()
    table = []
    for r in cells:
        shells = min(SHELLS, -(-r["n"] // block))
        table.append((r["cell"], sorted({r["steps"][SHELLS * i // shells - 1] for i in range(1, shells)})))
    bounds = F.broadcast(held.sparkSession.createDataFrame(table, "cell int, steps array<double>"))  # a row for each pivot
    shelled = lambda df: df.join(bounds, "cell").withColumn("shell", F.size(F.filter("steps", lambda x: x < F.col("far")))).drop("steps")
    held = shelled(held)
    sums = held.groupBy("cell", "shell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("deals"), F.min("near").alias("near"), F.max("far").alias("far"), F.max(F.lit(width) - size).alias("missing"), F.max(size).alias("most"))
    sums = materialize(sums)  # at most SHELLS rows for each pivot
    deals = F.broadcast(sums.select("cell", "shell", "deals"))
    dealt = lambda df: df.join(deals, ["cell", "shell"], "left").withColumn("deal", F.pmod(F.xxhash64("sample_id"), F.coalesce("deals", F.lit(1))).cast("int")).drop("deals", "near", "far")
    found = sums.collect()
    column = lambda name: np.array([r[name] for r in found])
    shells = Shells(names, pivots, *(column(c) for c in ("cell", "shell", "deals", "near", "far", "missing", "most")))

    held = dealt(held)
    if same:
        home = held
    else:
        home = dealt(shelled(asked.mapInArrow(_assign(names, pivots, 0), kinds(asked))))
    key = ["cell", "shell", "deal"]
    seeds = materialize(_search(home, held, k, same, key))
    limit = seeds.groupBy("sample_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("limit"))
    asking = home.join(limit, "sample_id", "left").select("sample_id", "features", "vec", *key, F.coalesce("limit", F.lit(float("inf"))).alias("limit"))
    kind = StructType([StructField("sample_id", StringType()), StructField("features", ArrayType(LongType())), StructField("vec", ArrayType(DoubleType())), *(StructField(c, IntegerType()) for c in key)])
    count = asking.mapInArrow(_visits(shells, True), "n long").agg(F.sum("n")).first()[0] or 0
    if count > n * min(sides, SIDE):  # the samples would travel too often
        return whole()
    visits = materialize(asking.mapInArrow(_visits(shells), kind))
    if report is not None:
        report["sent"] = count
        sizes = materialize(held.groupBy(*key).agg(F.count(F.lit(1)).alias("n")))
        pairs = lambda df: df.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).join(sizes, key).agg(F.sum(F.col("m") * F.col("n"))).first()[0] or 0
        report["compared"] = pairs(home) + pairs(visits)
    return ranked(seeds.unionByName(_search(visits, held, k, same, key)))


def mutual_neighbors(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(a, b): samples of two (sample_id, names, vec) that are among each other's k nearest."""
    there = nearest(left, k, right).select(F.col("sample_id").alias("a"), F.col("other").alias("b"))
    back = nearest(right, k, left).select(F.col("other").alias("a"), F.col("sample_id").alias("b"))
    return there.join(back, ["a", "b"])


def mutual_between(rows: DataFrame, k: int, sizes: dict[str, int]) -> DataFrame:
    """(a, b): samples of (sample_id, names, vec, batch) that are among each other's k nearest in the other's batch; both ways.

    sizes: the samples of each batch. Pairs of batches of BLOCK samples at most are searched at once, larger ones pair by pair.
    """
    small = sorted(b for b, n in sizes.items() if n <= BLOCK)
    slim = rows.where(F.col("batch").isin(small)).select("sample_id", F.transform("names", lambda x: F.xxhash64(x)).alias("features"), "vec", "batch")
    others = F.explode(F.array_except(F.array(*map(F.lit, small)).cast("array<string>"), F.array("batch")))
    asked, held = slim.select("*", others.alias("there")).withColumnRenamed("batch", "here"), slim.select("*", others.alias("here")).withColumnRenamed("batch", "there")
    near = materialize(_search(asked, held, k, False, ["here", "there"]).select(F.col("sample_id").alias("a"), F.col("other").alias("b")))
    found = near.join(near.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"])
    part = lambda name: rows.where(F.col("batch") == name).select("sample_id", "names", "vec")
    for i, x in enumerate(sorted(sizes)):
        for y in sorted(sizes)[i + 1 :]:
            if max(sizes[x], sizes[y]) > BLOCK:
                pairs = materialize(mutual_neighbors(part(x), part(y), k))
                found = found.unionByName(pairs).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return found
