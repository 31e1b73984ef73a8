"""Harmony: batches mixed in a low-dimensional space by soft clustering with a diversity penalty and ridge corrections.

Samples stay distributed. A round broadcasts the centres (clusters by dimensions) and the batch counts of clusters, and adds up
over samples what the next centres, counts and corrections need: arrays of clusters by batches by dimensions.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..model import CELL
from ..storage import materialize, once
from .matrix import feature_list, row_arrays, summed


class Clusters(NamedTuple):
    """Centres of length 1, and for each cluster and batch the weight that is there and that chance alone would put there."""

    centres: np.ndarray
    seen: np.ndarray
    expected: np.ndarray


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def cosine_distances(z: np.ndarray, c: Clusters) -> np.ndarray:
    return 2 * (1 - unit(z) @ c.centres.T)


def memberships(z: np.ndarray, batch: np.ndarray, c: Clusters, theta: float, sigma: float, far: np.ndarray | None = None) -> np.ndarray:
    """Soft clusters of samples by cosine distance; clusters in which a sample's batch is too common already count less."""
    far = cosine_distances(z, c) if far is None else far
    less = ((c.expected + 1) / (c.seen + 1)) ** theta
    r = np.exp(-(far - far.min(1, keepdims=True)) / sigma) * less[:, batch].T
    return r / r.sum(1, keepdims=True)


def corrections(sums: np.ndarray, weight: np.ndarray, lamb: float) -> np.ndarray:
    """(clusters, batches, dimensions): ridge regression of a cluster's samples on an intercept and the batches, without the intercept.

    sums (clusters, batches, dimensions) are weighted sums of the samples, weight (clusters, batches) those of the memberships.
    """
    k, b, d = sums.shape
    out = np.zeros((k, b, d))
    for i in range(k):
        gram = np.zeros((b + 1, b + 1))
        gram[0, 0], gram[0, 1:], gram[1:, 0] = weight[i].sum(), weight[i], weight[i]
        gram[1:, 1:] = np.diag(weight[i] + lamb)
        right = np.vstack([sums[i].sum(0), sums[i]])
        out[i] = np.linalg.lstsq(gram, right, rcond=None)[0][1:]
    return out


def _rows(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def harmonize(points: DataFrame, *, theta: float = 2.0, lamb: float = 1.0, sigma: float = 0.1, nclust: int | None = None, max_iter_harmony: int = 10, max_iter_cluster: int = 20, epsilon_cluster: float = 1e-5, epsilon_harmony: float = 1e-4, seed: int = 42, report: list | None = None) -> DataFrame:
    """(sample_id, batch, vec) with corrected vectors of one length.

    Each outer round clusters the corrected vectors, then corrects the original ones by the memberships found. A cluster round
    uses the counts of the round before for all samples. It ends when the objective (distances, entropy and diversity)
    settles, or at the given number of rounds; `report` takes the objective after each outer round.
    """
    if sigma <= 0 or theta < 0 or lamb < 0 or (nclust is not None and nclust < 1):
        raise ValidationError("sigma and nclust must be positive, theta and lamb not negative")
    names = sorted(r[0] for r in points.select("batch").distinct().collect())
    place = {v: i for i, v in enumerate(names)}
    code = F.element_at(F.create_map(*(F.lit(x) for v in names for x in (v, place[v]))), F.col("batch"))
    rows = materialize(points.select("sample_id", "batch", code.cast("int").alias("code"), "vec", F.col("vec").alias("now")))
    counts = {r["code"]: r["n"] for r in rows.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = np.array([counts[i] for i in range(len(names))], float)
    n, share = int(share.sum()), share / share.sum()
    k = min(nclust or max(1, min(round(n / 30), 100)), n)
    d, b, spark = len(rows.first()["vec"]), len(names), points.sparkSession

    def added(c: Clusters, column: str) -> tuple[np.ndarray, np.ndarray, float]:
        """Sums of `column` (of unit length, if it is `now`) and of memberships by cluster and batch, and the objective's sample part."""
        shared = spark.sparkContext.broadcast(c)

        def task(batch: pa.RecordBatch) -> np.ndarray:
            now, code = _rows(batch, "now"), batch.column("code").to_numpy()
            far = cosine_distances(now, shared.value)
            r = memberships(now, code, shared.value, theta, sigma, far)
            z = unit(now) if column == "now" else _rows(batch, column)
            sums, weight = np.zeros((k, b, d)), np.zeros((k, b))
            for i in np.unique(code):
                mine = code == i
                sums[:, i], weight[:, i] = r[mine].T @ z[mine], r[mine].sum(0)
            # Only the clusters' rounds ask for the cost.
            cost = (r * far).sum() + sigma * (r * np.log(np.maximum(r, 1e-300))).sum() if column == "now" else 0.0
            return np.concatenate([sums.ravel(), weight.ravel(), [cost]])

        flat = summed(rows.select("code", "vec", "now"), task, k * b * d + k * b + 1)
        return flat[: k * b * d].reshape(k, b, d), flat[k * b * d : -1].reshape(k, b), float(flat[-1])

    centre = KMeans(k=k, seed=seed, maxIter=20).fit(rows.select(array_to_vector(F.transform("now", lambda x: x / F.sqrt(F.aggregate("now", F.lit(1e-300), lambda s, v: s + v * v)))).alias("features"))).clusterCenters()
    centre = np.vstack([centre, np.zeros((k - len(centre), d))]) if len(centre) < k else np.array(centre)
    flat = np.ones((k, b))
    c = Clusters(unit(centre), flat, flat)
    history: list[float] = []
    for _ in range(max_iter_harmony):
        last = None
        for _ in range(max_iter_cluster):
            sums, weight, cost = added(c, "now")
            expected = weight.sum(1, keepdims=True) * share
            cost += sigma * theta * float((weight * np.log((weight + 1) / (expected + 1))).sum())
            c = Clusters(unit(sums.sum(1)), weight, expected)
            if last is not None and abs(last - cost) <= epsilon_cluster * abs(last):
                break
            last = cost
        sums, weight, _ = added(c, "vec")
        shift = spark.sparkContext.broadcast((c, corrections(sums, weight, lamb)))

        def correct(batches, shift=shift):
            for batch in batches:
                c, w = shift.value
                code, z = batch.column("code").to_numpy(), _rows(batch, "vec")
                new = z - np.einsum("ik,ikd->id", memberships(_rows(batch, "now"), code, c, theta, sigma), w[:, code].transpose(1, 0, 2)) if batch.num_rows else z
                yield pa.record_batch([*batch.columns[:-1], pa.array(list(new), pa.list_(pa.float64()))], names=batch.schema.names)

        rows = materialize(rows.mapInArrow(correct, rows.schema))
        history.append(cost)
        if len(history) > 1 and history[-2] - history[-1] <= epsilon_harmony * abs(history[-2]):
            break
    if report is not None:
        report += history
    return rows.select("sample_id", "batch", F.col("now").alias("vec"))


def integrate_harmony(cells: DataFrame, obs: DataFrame, *, batch: str = "batch", **options) -> DataFrame:
    """Corrected cells of a layer of few features, such as principal components; needs complete cells and two batches."""
    cells = once(cells)
    rows = materialize(row_arrays(cells))
    features = feature_list(rows)
    if rows.where(F.size("vec") < len(features)).limit(1).count() or cells.where("value is null").limit(1).count():
        raise ValidationError("Harmony needs cells without missing values")
    of = obs.select("sample_id", F.col(batch).cast("string").alias("batch"))
    if of.select("batch").distinct().limit(2).count() < 2:
        raise ValidationError("integration needs two batches or more")
    fixed = harmonize(rows.select("sample_id", "vec").join(of, "sample_id"), **options)
    long = fixed.select("sample_id", F.posexplode("vec").alias("at", "new"))
    names = rows.limit(1).select(F.posexplode("names").alias("at", "feature_id"))
    found = long.join(names, "at").select("sample_id", "feature_id", "new")
    return cells.join(found, ["sample_id", "feature_id"], "left").withColumn("value", F.coalesce("new", "value")).select(*CELL)
