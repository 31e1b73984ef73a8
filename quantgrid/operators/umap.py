"""UMAP: a fuzzy graph of nearest neighbours, laid out by pulls along its edges and pushes from sampled points.

The layout goes in rounds. In each, points are dealt anew by a hash to cells of bounded size. A cell gets its points, their edges
and the coordinates of the edges' other ends, runs several epochs on them, and gives its points' new coordinates: others' points
stand still for that round. As cells are random samples of all points, those to push from are drawn inside the cell. A point of
very many edges lies in several cells, with a part of its edges in each, and takes the mean of what these find.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..storage import materialize, once
from .matrix import row_arrays
from .neighbors import nearest
from .reduce import pca

CELL_POINTS = 4096
CELL_EDGES = 1 << 18
MOST_EDGES = 1024  # of a point in one cell
PUSHES = 5  # points that push for each pull
FARTHEST = 4.0  # of one pull or push, before the learning rate
METRICS = ("euclidean", "cosine", "correlation")


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + a x^2b) comes nearest to 1 up to min_dist and exp((min_dist - x) / spread) beyond, by damped least squares."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(x < min_dist, 1.0, np.exp((min_dist - x) / spread))
    miss = lambda p: (1 / (1 + (z := np.exp(p[0]) * x ** (2 * np.exp(p[1])))) - y, z)
    at, damp = np.zeros(2), 1e-3
    r, z = miss(at)
    for _ in range(500):
        slope = -(z / (1 + z) ** 2)[:, None] * np.column_stack([np.ones_like(x), 2 * np.exp(at[1]) * np.log(x)])
        gram = slope.T @ slope
        step = np.linalg.solve(gram + damp * np.diag(np.diag(gram)), -slope.T @ r)
        new, there = miss(at + step)
        if new @ new <= r @ r:
            at, r, z, damp = at + step, new, there, damp / 3
            if np.abs(step).max() < 1e-9:
                break
        else:
            damp *= 4
    return float(np.exp(at[0])), float(np.exp(at[1]))


def calibrated(d: np.ndarray, goal: float, steps: int = 64) -> np.ndarray:
    """Memberships of neighbours by their distances (a row each, infinite where there is none).

    1 up to the nearest positive distance, then falling exponentially, at a rate by which a row's memberships add up to `goal`; the
    rate's length is a thousandth of the mean distance at least.
    """
    held = np.isfinite(d)
    nearest = np.min(np.where(held & (d > 0), d, np.inf), axis=1, initial=np.inf)
    beyond = np.maximum(d - np.where(np.isfinite(nearest), nearest, 0.0)[:, None], 0.0)
    low, high, sigma = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    fall = lambda s: np.where(held, np.exp(-beyond / s[:, None]), 0.0)
    for _ in range(steps):
        over = fall(sigma).sum(1) > goal
        high, low = np.where(over, sigma, high), np.where(over, low, sigma)
        sigma = np.where(np.isfinite(high), (low + high) / 2, 2 * sigma)
        sigma = np.clip(sigma, 1e-150, 1e150)
    mean = np.where(held, d, 0.0).sum(1) / np.maximum(held.sum(1) + 1, 1)
    return fall(np.maximum(sigma, 1e-3 * mean + 1e-300))


def directed(rows: DataFrame, metric: str) -> DataFrame:
    """rows whose Euclidean distances order neighbours as the metric does."""
    if metric == "euclidean":
        return rows
    mean = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v) / F.size("vec") if metric == "correlation" else F.lit(0.0)
    rows = rows.withColumn("mean", mean).withColumn("vec", F.transform("vec", lambda v: v - F.col("mean")))
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v))
    return rows.withColumn("length", length).select("sample_id", "names", F.transform("vec", lambda v: F.when(F.col("length") > 0, v / F.col("length")).otherwise(0.0)).alias("vec"))


def fuzzy_graph(rows: DataFrame, n_neighbors: int = 15, *, metric: str = "euclidean") -> DataFrame:
    """(a, b, w), both ways listed: memberships of the nearest others, a sample itself counting among the n_neighbors, by fuzzy union."""
    if metric not in METRICS:
        raise ValidationError(f"metric is one of {METRICS}")
    rows = directed(rows, metric)
    near = nearest(rows, n_neighbors - 1)
    if metric != "euclidean":  # half the squared distance of vectors of length 1 is 1 less their cosine
        width = rows.agg(F.max(F.size("vec"))).first()[0] or 0
        near = near.withColumn("distance", F.col("distance") ** 2 * width / 2)
    lists = near.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("distance", "other"))).alias("x")).select("sample_id", "x.other", "x.distance")
    goal = float(np.log2(n_neighbors))

    def weigh(batches):
        for batch in batches:
            n = np.diff(batch.column("distance").offsets.to_numpy())
            d = np.full((batch.num_rows, int(n.max(initial=0))), np.inf)
            d[np.arange(d.shape[1]) < n[:, None]] = batch.column("distance").flatten().to_numpy()
            w = calibrated(d, goal)[np.arange(d.shape[1]) < n[:, None]]
            yield pa.record_batch([batch.column("sample_id").take(pa.array(np.repeat(np.arange(len(n)), n))), batch.column("other").flatten(), pa.array(w)], names=["a", "b", "w"])

    one_way = lists.mapInArrow(weigh, "a string, b string, w double").where("w > 0")
    pair = one_way.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("w").alias("w"), F.min("w").alias("v"), F.count(F.lit(1)).alias("n"))
    union = pair.select("a", "b", F.when(F.col("n") == 2, F.col("w") + F.col("v") - F.col("w") * F.col("v")).otherwise(F.col("w")).alias("w"))
    return union.select(F.explode(F.array(F.struct("a", "b", "w"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "w"))).alias("e")).select("e.*")


def waves(head: np.ndarray) -> np.ndarray:
    """For each edge how many edges of the same head, by which the edges are sorted, come before it."""
    first = np.flatnonzero(np.r_[True, head[1:] != head[:-1]]) if len(head) else np.zeros(0, int)
    return np.arange(len(head)) - np.repeat(first, np.diff(np.r_[first, len(head)]))


def epoch(y: np.ndarray, head: np.ndarray, tail: np.ndarray, pushers: np.ndarray, rate: float, a: float, b: float) -> None:
    """Move the points `head`, sorted, each along its edges one after the other: a pull by the tail, pushes by the edge's pushers.

    An edge pulls twice, since a point is head of it one way and tail the other way.
    """
    place = waves(head)
    order = np.argsort(place, kind="stable")
    for at in np.split(order, np.cumsum(np.bincount(place))[:-1]) if len(head) else ():
        h = head[at]
        gap = y[h] - y[tail[at]]
        s = (gap * gap).sum(1)
        power = np.where(s > 0, s, 1.0) ** b
        pull = np.where(s > 0, -2 * a * b * power / np.where(s > 0, s, 1.0) / (1 + a * power), 0.0)
        y[h] += 2 * rate * np.clip(pull[:, None] * gap, -FARTHEST, FARTHEST)
        gap = y[h][:, None] - y[pushers[at]]
        s = (gap * gap).sum(2)
        push = np.where(s > 0, 2 * b / ((0.001 + s) * (1 + a * s**b)), 0.0)
        y[h] += rate * np.clip(push[:, :, None] * gap, -FARTHEST, FARTHEST).sum(1)


def _chance(*of: Column | int | str) -> Column:
    """A number in [0, 1) by a hash."""
    return F.pmod(F.xxhash64(*(F.lit(x) if isinstance(x, int) else x for x in of)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def start_points(cells: DataFrame, rows: DataFrame, n: int, init: str, seed: int) -> DataFrame:
    """(sample_id, vec): principal components, the largest number 10, and a little noise that parts equal samples; or noise alone."""
    noise = lambda i: _chance("sample_id", seed, i) - 0.5
    if init == "random":
        return rows.select("sample_id", F.array(*(20 * noise(i) for i in range(n))).alias("vec"))
    scores = once(pca(cells, n, seed=seed)["scores"])
    top = scores.agg(F.max(F.array_max(F.transform("vec", lambda v: F.abs(v))))).first()[0] or 1.0
    return scores.select("sample_id", F.array(*(F.coalesce(F.get("vec", F.lit(i)), F.lit(0.0)) * (10 / top) + 1e-3 * noise(i) for i in range(n))).alias("vec"))


def layout(edges: DataFrame, points: DataFrame, *, min_dist: float = 0.1, n_epochs: int | None = None, seed: int = 42, sweep: int = 20, block: int = CELL_POINTS, most: int = MOST_EDGES) -> DataFrame:
    """(sample_id, vec): points moved for n_epochs; an edge takes part in a share of them that is its weight by the largest.

    sweep: epochs of a round. All in one round where one cell holds all points. 500 epochs for up to 10,000 points, else 200.
    """
    a, b = curve(min_dist)
    edges = once(edges)
    degree = edges.groupBy(F.col("a").alias("sample_id")).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("copies"))
    width = len(points.first()["vec"])
    points = materialize(points.join(degree, "sample_id", "left").select("sample_id", "vec", F.coalesce("copies", F.lit(1)).alias("copies")))
    top, n_edges = edges.agg(F.max("w"), F.count(F.lit(1))).first()
    share = edges.select("a", "b", (F.col("w") / (top or 1.0)).alias("share"), _chance("a", "b", seed).alias("phase"))
    edges = materialize(share.join(degree.withColumnRenamed("sample_id", "a"), "a"))
    n, copies = points.agg(F.count(F.lit(1)), F.sum("copies")).first()
    epochs = n_epochs if n_epochs is not None else 500 if n <= 10_000 else 200
    cells = max(1, -(-copies // block), -(-n_edges // (block * (CELL_EDGES // CELL_POINTS))))
    sweep = max(1, epochs) if cells == 1 else sweep
    kind = pa.schema([("sample_id", pa.string()), ("vec", pa.list_(pa.float64())), ("copies", pa.int32())])

    for begin in range(0, epochs, sweep):
        end = min(begin + sweep, epochs)
        cell = lambda name, turn=begin: F.pmod(F.xxhash64(name, "copy", F.lit(turn), F.lit(seed)), F.lit(cells)).cast("int").alias("cell")
        there = points.select(F.col("sample_id").alias("b"), F.col("vec").alias("there"))
        out = edges.join(there, "b").withColumn("copy", F.pmod(F.xxhash64("b", F.lit(begin)), F.col("copies")).cast("int")).select(cell("a"), "a", "copy", "b", "share", "phase", "there")
        own = points.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select(cell("sample_id"), "sample_id", "copy", "vec", "copies")

        def run(key, out: pa.Table, own: pa.Table) -> pa.Table:
            if not own.num_rows:
                return kind.empty_table()
            own, out = own.sort_by([("sample_id", "ascending"), ("copy", "ascending")]), out.sort_by([("a", "ascending"), ("copy", "ascending"), ("b", "ascending")])
            flat = lambda t, name: t[name].combine_chunks().flatten().to_numpy().reshape(-1, width)
            names = list(zip(own["sample_id"].to_pylist(), own["copy"].to_pylist()))
            place = {k: i for i, k in enumerate(names)}
            whole = {v: i for (v, c), i in place.items() if c == 0}
            head = np.array([place[k] for k in zip(out["a"].to_pylist(), out["copy"].to_pylist())], int)
            # The other end is a point of this cell, which moves, or one that stands still behind them.
            tail = np.array([whole.get(v, len(names) + i) for i, v in enumerate(out["b"].to_pylist())], int)
            y = np.concatenate([flat(own, "vec"), flat(out, "there") if out.num_rows else np.zeros((0, width))])
            share, phase = out["share"].to_numpy(), out["phase"].to_numpy()
            rng = np.random.default_rng([seed, begin, key[0].as_py()])
            for e in range(begin, end):
                on = np.flatnonzero(np.floor((e + 1) * share + phase) > np.floor(e * share + phase))
                epoch(y, head[on], tail[on], rng.integers(0, len(names), (len(on), PUSHES)), 1 - e / epochs, a, b)
            return pa.table([own["sample_id"], pa.array(list(y[: len(names)]), pa.list_(pa.float64())), own["copies"].cast(pa.int32())], schema=kind)

        moved = out.groupBy("cell").cogroup(own.groupBy("cell")).applyInArrow(run, "sample_id string, vec array<double>, copies int")
        mean = F.array(*(F.avg(F.get("vec", F.lit(i))) for i in range(width)))
        points = materialize(moved.groupBy("sample_id").agg(mean.alias("vec"), F.first("copies").alias("copies")))
    return points.select("sample_id", "vec")


def umap(cells: DataFrame, n_components: int = 2, *, n_neighbors: int = 15, min_dist: float = 0.1, metric: str = "euclidean", init: str = "pca", n_epochs: int | None = None, seed: int = 42, **options) -> DataFrame:
    """(sample_id, vec): samples of a complete layer in a few dimensions. A seed gives one result, as far as sums in another order do.

    init is pca or random. `options` are those of `layout`.
    """
    if n_components < 1 or n_neighbors < 2 or not 0 <= min_dist <= 1:
        raise ValidationError("n_components must be 1 or more, n_neighbors 2 or more, min_dist between 0 and 1")
    if init not in ("pca", "random"):
        raise ValidationError("init is pca or random")
    cells = once(cells)
    rows = materialize(row_arrays(cells))
    n, least = rows.agg(F.count(F.lit(1)), F.min(F.size("vec"))).first()
    if n <= n_neighbors:
        raise ValidationError(f"{n_neighbors} neighbours need more than {n} samples")
    if least < cells.select("feature_id").distinct().count() or cells.where("value is null").limit(1).count():
        raise ValidationError("UMAP needs cells without missing values")
    edges = fuzzy_graph(rows, n_neighbors, metric=metric)
    return layout(materialize(edges), start_points(cells, rows, n_components, init, seed), min_dist=min_dist, n_epochs=n_epochs, seed=seed, **options)
