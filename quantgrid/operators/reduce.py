"""Reduction and clustering of samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import MissingDependencyError, ValidationError
from ..storage import materialize, once
from .matrix import MAX_FEATURES, dense, feature_list, gram_sums, row_arrays, summed
from .neighbors import nearest


WIDEST = 1 << 24  # numbers of features by columns that the driver and each task hold for wide layers
PANEL = 1 << 21  # numbers of a block of samples


def panels(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    """The samples of a batch of complete rows as matrices of bounded size."""
    column, step = batch.column("vec"), max(1, PANEL // max(1, width))
    for i in range(0, batch.num_rows, step):
        part = column.slice(i, step)
        yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), width)


def triangle(blocks: Iterator[np.ndarray], width: int) -> np.ndarray:
    """R of the QR factorization of blocks one below the other: each is stacked below the R so far."""
    r = np.zeros((0, width))
    for y in blocks:
        r = np.linalg.qr(np.vstack([r, y]), mode="r")
    return r


def tall_r(rows: DataFrame, block: Callable[[np.ndarray], np.ndarray], features: int, width: int, fan: int = 256) -> np.ndarray:
    """R of the rows of block(samples): one for each partition, then for `fan` groups of partitions, then for all."""
    kind = "at int, r binary"

    def leaf(batches):
        r = triangle((block(x) for batch in batches for x in panels(batch, features)), width)
        yield pa.record_batch([pa.array([TaskContext.get().partitionId() % fan], pa.int32()), pa.array([r.tobytes()], pa.binary())], names=["at", "r"])

    def join(group: pa.Table) -> pa.Table:
        r = triangle((np.frombuffer(x).reshape(-1, width) for x in group["r"].to_pylist()), width)
        return pa.table([group["at"][:1], pa.array([r.tobytes()], pa.binary())], names=["at", "r"])

    found = rows.mapInArrow(leaf, kind).groupBy("at").applyInArrow(join, kind).collect()
    return triangle((np.frombuffer(x["r"]).reshape(-1, width) for x in found), width)


def randomized_axes(rows: DataFrame, means: np.ndarray, sd: np.ndarray, k: int, oversample: int, iterations: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, axes): the leading k of (samples - means) / sd, by subspace iteration from a seeded start.

    A round projects the samples on the axes so far, factorizes that tall matrix by TSQR, and adds up its products with the
    samples. What is held and sent has the size of features times k + oversample, never features times features.
    """
    m = len(means)
    width = min(k + oversample, m)
    if m * width > WIDEST:
        raise ValidationError(f"more than {WIDEST} numbers of features by components")
    axes = np.linalg.qr(np.random.default_rng(seed).normal(size=(m, width)))[0]
    for turn in range(iterations + 1):
        shared = rows.sparkSession.sparkContext.broadcast(axes)
        project = lambda x, a=shared: ((x - means) / sd) @ a.value
        r = tall_r(rows, project, m, width)
        if turn == iterations:
            _, s, w = np.linalg.svd(r, full_matrices=False)
            return s[:k], axes @ w[:k].T

        def products(batch: pa.RecordBatch, a=shared) -> np.ndarray:
            out = np.zeros((m, width))
            for x in panels(batch, m):
                z = (x - means) / sd
                out += z.T @ (z @ a.value)
            return out.ravel()

        # Columns by the singular directions of the projection, so that small ones aren't drowned before they are made orthonormal.
        _, s, w = np.linalg.svd(r, full_matrices=False)
        z = summed(rows, products, m * width).reshape(m, width) @ (w.T / np.maximum(s, 1e-300 + 1e-12 * s.max(initial=0.0)))
        axes = np.linalg.qr(np.pad(z, ((0, 0), (0, width - z.shape[1]))) if z.shape[1] < width else z)[0]
    raise AssertionError


def wide_pca(cells: DataFrame, n_components: int, center: bool, scale: bool, oversample: int, iterations: int, seed: int) -> dict[str, DataFrame]:
    """As pca, for any number of features."""
    rows = materialize(row_arrays(cells))
    per = cells.where("value is not null").groupBy("feature_id").agg(F.avg("value").alias("m"), F.avg(F.col("value") ** 2).alias("q"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("v")).orderBy("feature_id").limit(WIDEST + 1).collect()
    if rows.where(F.size("vec") < len(per)).limit(1).count():
        raise ValidationError("PCA needs cells without missing values")
    n, m = rows.count(), len(per)
    means = np.array([r["m"] for r in per]) if center else np.zeros(m)
    square = np.array([r["v"] if center else r["q"] * n / max(n - 1, 1) for r in per])  # of a column, by n - 1
    sd = np.sqrt(square) if scale else np.ones(m)
    sd[sd == 0] = 1
    total = max(float((square / sd**2).sum()), 1e-300)
    k = min(n_components, m, n)
    s, axes = randomized_axes(rows, means, sd, k, oversample, iterations, seed)
    k = len(s)
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(k)])
    shared, spark = cells.sparkSession.sparkContext.broadcast(axes), cells.sparkSession

    def project(batches):
        for batch in batches:
            scores = np.concatenate([((x - means) / sd) @ shared.value for x in panels(batch, m)]) if batch.num_rows else np.zeros((0, k))
            yield pa.RecordBatch.from_arrays([batch["sample_id"], pa.array(list(scores), pa.list_(pa.float64()))], ["sample_id", "vec"])

    value = s**2 / max(n - 1, 1)
    return {
        "scores": rows.mapInArrow(project, "sample_id string, vec array<double>"),
        "loadings": spark.createDataFrame([(r["feature_id"], [float(x) for x in v]) for r, v in zip(per, axes)], "feature_id string, vec array<double>"),
        "variance": spark.createDataFrame([(f"PC{i + 1}", float(v), float(v / total)) for i, v in enumerate(value)], "component string, eigenvalue double, ratio double"),
    }


def pca(cells: DataFrame, n_components: int = 50, *, center: bool = True, scale: bool = False, svd_solver: str = "auto", oversample: int = 10, iterations: int = 5, seed: int = 42) -> dict[str, DataFrame]:
    """scores (sample_id, vec), loadings (feature_id, vec) and variance (component, eigenvalue, ratio).

    svd_solver full: from the Gram matrix of the features, which Spark adds up over the samples, for MAX_FEATURES at most;
    randomized: by subspace iteration, for any number of features; auto: the first that fits. Needs complete cells. Of each
    component the loading of the largest size is positive.
    """
    if svd_solver not in ("auto", "full", "randomized"):
        raise ValidationError("svd_solver is auto, full or randomized")
    cells = once(cells)
    if svd_solver == "randomized" or (svd_solver == "auto" and cells.select("feature_id").distinct().limit(MAX_FEATURES + 1).count() > MAX_FEATURES):
        return wide_pca(cells, n_components, center, scale, oversample, iterations, seed)
    rows = row_arrays(cells)
    features = feature_list(rows)
    if rows.where(F.size("vec") < len(features)).limit(1).count():
        raise ValidationError("PCA needs cells without missing values")
    n, sums, _ = gram_sums(rows, means_only=True, width=features)
    means = sums / n if center else np.zeros(len(features))
    gram = gram_sums(rows, means=means, width=features)[1]
    sd = np.sqrt(np.maximum(np.diag(gram) / max(n - 1, 1), 0)) if scale else np.ones(len(features))
    sd[sd == 0] = 1
    value, vector = np.linalg.eigh(gram / np.outer(sd, sd) / max(n - 1, 1))
    k = min(n_components, len(features), n)
    value, vector = value[::-1], vector[:, ::-1][:, :k]
    vector = vector * np.sign(vector[np.abs(vector).argmax(0), np.arange(k)])
    total = max(value.sum(), 1e-300)
    spark = cells.sparkSession

    def project(batches):
        for batch in batches:
            scores = ((dense(batch, features) - means) / sd) @ vector
            yield pa.RecordBatch.from_arrays([batch["sample_id"], pa.array(list(scores), pa.list_(pa.float64()))], ["sample_id", "vec"])

    return {
        "scores": rows.mapInArrow(project, "sample_id string, vec array<double>"),
        "loadings": spark.createDataFrame([(f, [float(x) for x in v]) for f, v in zip(features, vector)], "feature_id string, vec array<double>"),
        "variance": spark.createDataFrame([(f"PC{i + 1}", float(v), float(v / total)) for i, v in enumerate(value[:k])], "component string, eigenvalue double, ratio double"),
    }


def kmeans(points: DataFrame, k: int = 5, *, seed: int = 42) -> DataFrame:
    """(sample_id, label) of (sample_id, vec)."""
    x = points.select("sample_id", array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed).fit(x)
    return model.transform(x).select("sample_id", F.col("prediction").cast("string").alias("label"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Of (node, label) on symmetric edges (a, b, w): the share of weight inside labels less what degrees alone would give."""
    of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
    x = edges.join(of("a"), "a").join(of("b"), "b")
    total, inside = x.agg(F.sum("w"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("w")))).first()
    square = x.groupBy("la").agg(F.sum("w").alias("k")).agg(F.sum(F.col("k") ** 2)).first()[0]
    return (inside or 0.0) / total - resolution * square / total**2 if total else 0.0


def connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, part): the least node of each connected part of edges (a, b), both ways listed. Labels jump, so parts of n take log n rounds or so."""
    labels = materialize(nodes.select("node", F.col("node").alias("part")))
    while True:
        near = edges.select(F.col("a").alias("node"), "b").join(labels.select(F.col("node").alias("b"), "part"), "b").groupBy("node").agg(F.min("part").alias("near"))
        least = labels.join(near, "node", "left").select("node", F.col("part").alias("old"), F.least("part", F.coalesce("near", "part")).alias("part"))
        up = labels.select(F.col("node").alias("part"), F.col("part").alias("above"))
        new = materialize(least.join(up, "part", "left").select("node", "old", F.least("part", F.coalesce("above", "part")).alias("part")))
        labels = new.select("node", "part")
        if not new.where("old <> part").limit(1).count():
            return labels


def inside(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges whose ends have the same label."""
    of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
    return edges.join(of("a"), "a").join(of("b"), "b").where("la = lb").select("a", "b", "w")


def moved_labels(edges: DataFrame, resolution: float, rounds: int, start: DataFrame | None = None, degrees: DataFrame | None = None) -> DataFrame:
    """(node, label): nodes move to the neighbouring label of the largest gain in modularity, half of them in each round.

    Nodes decide by the labels of the round before, so a round can lose; the labels of the best round stay, at worst those of
    `start` (else each node its own). Ties go by a hash. `degrees` (node, k) are those of a larger graph, of which edges are a part.
    """
    own = edges.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))
    degree = materialize(own if degrees is None else degrees)
    total = degree.agg(F.sum("k")).first()[0] or 1.0
    labels = best = materialize(degree.select("node", F.col("node").alias("label"))) if start is None else start

    def value_of(labels: DataFrame) -> float:
        held = inside(edges, labels).agg(F.sum("w")).first()[0] or 0.0
        square = labels.join(degree, "node").groupBy("label").agg(F.sum("k").alias("k")).agg(F.sum(F.col("k") ** 2)).first()[0] or 0.0
        return held / total - resolution * square / total**2

    top = value_of(labels)
    for turn in range(rounds):
        sums = labels.join(degree, "node").groupBy("label").agg(F.sum("k").alias("total"))
        near = edges.where("a <> b").join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node"), "label").agg(F.sum("w").alias("inside"))
        stay = labels.select("node", "label", F.lit(0.0).alias("inside"))
        now = labels.withColumnRenamed("label", "own")
        votes = near.unionByName(stay).groupBy("node", "label").agg(F.sum("inside").alias("inside")).join(now, "node").join(degree, "node").join(sums, "label")
        others = F.col("total") - F.when(F.col("label") == F.col("own"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("inside") - resolution * F.col("k") * others / total, 9)
        chosen = votes.groupBy("node").agg(F.max_by("label", F.struct(gain, (F.col("label") == F.col("own")).cast("int"), F.xxhash64("label"))).alias("new"), F.first("own").alias("own"))
        turns = F.pmod(F.xxhash64("node", F.lit(turn // 2)), F.lit(2)) == turn % 2
        moves = materialize(chosen.select("node", F.when(turns, F.col("new")).otherwise(F.col("own")).alias("label"), (turns & (F.col("new") != F.col("own"))).alias("moved")))
        labels = moves.select("node", "label")
        value = value_of(labels)
        if value > top + 1e-9:
            best, top = labels, value
        elif turn % 2 and not moves.where("moved").limit(1).count():
            break
    return best


def split(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """labels, with a label of its own for each connected part of a community; modularity doesn't fall by this."""
    return connected(inside(edges, labels), labels.select("node")).withColumnRenamed("part", "label")


def refined(edges: DataFrame, labels: DataFrame, resolution: float, rounds: int) -> DataFrame:
    """(node, label): communities found anew inside the given ones, from single nodes, each of them connected."""
    degrees = edges.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))
    within = materialize(inside(edges, labels))
    return split(within, moved_labels(within, resolution, max(2, rounds // 2), degrees=degrees))


def leiden(edges: DataFrame, *, resolution: float = 1.0, rounds: int = 8, levels: int = 10, report: list | None = None) -> DataFrame:
    """(node, label): communities of large modularity of symmetric edges (a, b, w), each of them connected.

    Level by level: nodes move between communities; communities are cut into connected parts and refined; the refined parts
    become the nodes of a smaller graph, which start in the communities that they are parts of. Ends where nothing merges.
    `report` takes the modularity after each level, which doesn't fall.
    """
    edges = materialize(edges.select("a", "b", "w"))
    where = materialize(edges.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("at")))  # node of the present graph
    labels, nodes = None, where.count()
    for _ in range(levels):
        labels = materialize(split(edges, moved_labels(edges, resolution, rounds, labels)))
        if report is not None:
            report.append(modularity(edges, labels, resolution))
        parts = materialize(refined(edges, labels, resolution, rounds))
        merged = parts.select("label").distinct().count()
        if merged == nodes:
            break
        nodes = merged
        part = parts.select("node", F.col("label").alias("part"))
        where = materialize(where.join(part.withColumnRenamed("node", "at"), "at").select("node", F.col("part").alias("at")))
        labels = materialize(part.join(labels, "node").groupBy(F.col("part").alias("node")).agg(F.min("label").alias("label")))
        of = lambda side: part.select(F.col("node").alias(side), F.col("part").alias(f"l{side}"))  # noqa: B023, E731
        edges = materialize(edges.join(of("a"), "a").join(of("b"), "b").groupBy(F.col("la").alias("a"), F.col("lb").alias("b")).agg(F.sum("w").alias("w")))
    if labels is None:
        return where.select("node", F.col("at").alias("label"))
    return where.join(labels.select(F.col("node").alias("at"), "label"), "at").select("node", "label")


def graph_communities(rows: DataFrame, k: int = 15, *, resolution: float = 1.0, rounds: int = 8, levels: int = 10) -> DataFrame:
    """(sample_id, label): Leiden communities in the graph of the k nearest and each sample itself; larger resolutions give smaller ones."""
    near = nearest(rows, k).select(F.col("sample_id").alias("a"), F.col("other").alias("b"))
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    own = rows.select(F.col("sample_id").alias("a"), F.col("sample_id").alias("b"))
    edges = both.unionByName(own).groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("w"))
    return leiden(edges, resolution=resolution, rounds=rounds, levels=levels).withColumnRenamed("node", "sample_id")


def tsne(*_, **__) -> DataFrame:
    raise MissingDependencyError("t-SNE needs a package that isn't part of this one")
