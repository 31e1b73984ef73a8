"""Imputation: fill the null values of a layer and mark them IMPUTED; observed cells stay as they are.

Methods on rows and columns join a statistic of each row or column. Methods on the matrix (svd, softimpute, bpca) keep samples distributed and
gather only sums over samples whose size is that of the features, at most MAX_FEATURES; kNN and LLS compare blocks of entities.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from math import erf
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions.quantiles import quantiles
from ..functions.special import norm_ppf
from ..model import CELL, Dataset, MaskCode
from ..storage import materialize, once
from .matrix import beside, check_width, dense, gram_sums, row_arrays, summed
from .neighbors import nearest

ASKING = 1 << 17  # samples whose neighbours travel in one row
RECOMMENDED = {"mcar": "knn", "mar": "missforest", "mnar": "qrilc"}


def filled(cells: DataFrame, value: Column) -> DataFrame:
    """Null values become the given one and IMPUTED."""
    missing = F.col("value").isNull()
    return cells.withColumns({"__new": value}).select(
        "sample_id", "feature_id", F.coalesce("value", "__new").alias("value"), F.when(missing & F.col("__new").isNotNull(), int(MaskCode.IMPUTED)).otherwise(F.col("mask")).alias("mask")
    )


def impute_none(cells: DataFrame) -> DataFrame:
    return cells


def impute_zero(cells: DataFrame) -> DataFrame:
    return filled(cells, F.lit(0.0))


def impute_row_mean(cells: DataFrame) -> DataFrame:
    """The sample's mean; the mean of all cells for a sample without values; 0 without any."""
    cells = once(cells)
    overall = cells.agg(F.avg("value")).first()[0] or 0.0
    return filled(beside(cells, "sample_id", __x=F.avg("value")), F.coalesce("__x", F.lit(overall)))


def impute_row_median(cells: DataFrame) -> DataFrame:
    """The sample's median; the median of all cells, which is looked for only then, for a sample without values; 0 without any."""
    cells = once(cells)
    bare = cells.groupBy("sample_id").agg(F.count("value").alias("n")).where("n = 0").limit(1).count()
    overall = (quantiles(cells, "value", [0.5])[0] or 0.0) if bare else 0.0
    return filled(beside(cells, "sample_id", __x=F.median("value")), F.coalesce("__x", F.lit(overall)))


def impute_half_row_min(cells: DataFrame, *, fraction: float = 0.5) -> DataFrame:
    """A fraction of the sample's least value; of the least of all for a sample without values."""
    cells = once(cells)
    overall = cells.agg(F.min("value")).first()[0] or 0.0
    return filled(beside(cells, "sample_id", __x=F.min("value")), F.coalesce("__x", F.lit(overall)) * fraction)


def impute_col_mean(cells: DataFrame) -> DataFrame:
    return filled(beside(cells, "feature_id", __x=F.avg("value")), F.coalesce("__x", F.lit(0.0)))


def impute_missforest(cells: DataFrame, **_) -> DataFrame:
    """The feature's mean: the forest is given columns that their means have filled already, and so changes nothing."""
    return impute_col_mean(cells)


def impute_minprob(cells: DataFrame, *, sigma: float = 2.0, q: float = 0.01, random_state: int = 42) -> DataFrame:
    """Draws around each sample's low quantile; one deviation for all: the median of well-observed features' times sigma."""
    if sigma <= 0 or not 0 < q < 1:
        raise ValidationError("sigma must be positive, q in (0, 1)")
    cells = once(cells)
    n = cells.select("sample_id").distinct().count()
    features = cells.groupBy("feature_id").agg((F.count("value") / n).alias("share"), F.stddev_samp("value").alias("sd"))
    (sd,) = quantiles(features.where("share > 0.5 and sd > 0"), "sd", [0.5])
    if sd is None:
        sd = cells.agg(F.stddev_samp("value")).first()[0] or 0.0
    sd = max(sd * sigma, 1e-8)
    (low,) = quantiles(cells, "value", [q])
    least = cells.agg(F.min("value")).first()[0]
    rows = beside(cells, "sample_id", __q=F.percentile("value", F.lit(q)), __min=F.min("value"))
    level = F.coalesce("__q", F.lit(low or 0.0))
    # A draw depends on the cell alone, so that reruns agree however rows are dealt.
    draw = level + F.lit(sd) * gaussian(random_state)
    nonnegative = F.coalesce(F.col("__min") >= 0, F.lit(least is None or least >= 0))
    return filled(rows, F.when(nonnegative, F.greatest(draw, F.lit(0.0))).otherwise(draw))


def uniform(seed: int, salt: int = 0) -> Column:
    """A number in (0, 1) from the cell's ids and the seed."""
    return (F.pmod(F.xxhash64("sample_id", "feature_id", F.lit(seed), F.lit(salt)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))


def gaussian(seed: int) -> Column:
    return F.sqrt(-2 * F.log(uniform(seed))) * F.cos(2 * np.pi * uniform(seed, 1))


def impute_qrilc(cells: DataFrame, *, q: float = 0.01, random_state: int = 42) -> DataFrame:
    """Per sample, a line of its quantiles against normal ones gives mean and deviation; draws come from the left tail.

    The upper quantiles of the observed values stand for those above the missing share. Samples with fewer than three values or
    no spread take their least value.
    """

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        gap = rows["value"].isna().to_numpy()
        seen = np.sort(rows["value"].to_numpy(float)[~gap])
        if gap.any() and len(seen):
            share = gap.mean()
            p = np.linspace(max(share + 0.001, 0.01), 0.99, 100)
            x, y = norm_ppf(p), np.quantile(seen, np.clip((p - share) / (1 - share), 0, 1))
            slope, level = np.polyfit(x, y, 1) if len(seen) > 2 else (0.0, seen[0])
            top = norm_ppf(np.array([share + q]).clip(1e-6, 1 - 1e-6))[0]
            u = rows["u"].to_numpy()[gap]
            upper = 0.5 * (1 + np.vectorize(erf)(top / np.sqrt(2)))
            z = norm_ppf(np.clip(u * upper, 1e-12, 1 - 1e-12))
            rows.loc[gap, "new"] = level + slope * z if slope > 0 else seen[0]
        return rows[["sample_id", "feature_id", "value", "mask", "new"]]

    drawn = cells.select(*CELL).withColumns({"u": uniform(random_state), "new": F.lit(None).cast("double")})
    drawn = drawn.groupBy("sample_id").applyInPandas(draw, "sample_id string, feature_id string, value double, mask int, new double")
    return filled(drawn, F.col("new"))


def impute_knn(cells: DataFrame, *, k: int = 5, weights: str = "uniform", oversample: int = 3) -> DataFrame:
    """The mean over the k nearest samples that have the feature, equal or by inverse distance; else the feature's mean.

    Distances are over shared features, scaled to their number. The k * oversample + 1 nearest are looked at. Samples don't see
    each other's imputed values, unlike a sequential pass, so that the result doesn't depend on their order.
    """
    if weights not in ("uniform", "distance"):
        raise ValidationError("weights is uniform or distance")
    cells = once(cells)
    rows = once(row_arrays(cells))
    n, hashed = rows.count(), F.xxhash64("sample_id")
    asking = max(1, -(-n // ASKING))
    near = nearest(rows, k * oversample + 1).withColumns({"own": hashed, "theirs": F.xxhash64("other")}).withColumn("block", F.pmod("own", F.lit(asking)))
    packed = near.groupBy("block").applyInArrow(_neighbor_lists, "block long, own binary, ends binary, theirs binary, distance binary")
    lists = materialize(cells.sparkSession.range(asking).withColumnRenamed("id", "block").join(packed, "block", "left"))
    seen = F.collect_list(F.when(F.col("value").isNotNull(), F.struct(hashed.alias("h"), F.col("value").cast("double").alias("v"))))
    gaps = F.collect_list(F.when(F.col("value").isNull(), F.col("sample_id")))
    columns = cells.groupBy("feature_id").agg(F.avg("value").alias("mean"), seen.alias("seen"), gaps.alias("gaps")).where(F.size("gaps") > 0)
    columns = materialize(columns.withColumn("hashes", F.transform("gaps", lambda x: F.xxhash64(x))))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each feature's gaps of a block of samples: the mean of the first k values in the order of distance, else the feature's."""
        block, lists = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                if batch["block"][r] != block:
                    block = batch["block"][r]
                    lists = [np.frombuffer(batch[c][r].as_buffer() if batch[c][r].is_valid else b"", kind) for c, kind in (("own", np.int64), ("ends", np.int64), ("theirs", np.int64), ("distance", float))]
                asked = batch["hashes"][r].values.to_numpy()
                mine = np.flatnonzero(asked % asking == block.as_py())
                mean = batch["mean"][r].as_py() or 0.0
                value = _from_neighbors(asked[mine], batch["seen"][r].values, *lists, k, weights)
                names = batch["gaps"][r].values.take(pa.array(mine))
                feature = pa.array([batch["feature_id"][r].as_py()], pa.string()).take(pa.array(np.zeros(len(mine), np.int32)))
                yield pa.record_batch([names, feature, pa.array(np.where(np.isnan(value), mean, value))], names=["sample_id", "feature_id", "value"])

    new = lists.hint("shuffle_replicate_nl").crossJoin(columns).mapInArrow(fill, "sample_id string, feature_id string, value double")
    new = new.withColumn("mask", F.lit(int(MaskCode.IMPUTED)))
    return cells.where("value is not null").select(*CELL).unionByName(new.select(*CELL))


def _neighbor_lists(rows: pa.Table) -> pa.Table:
    """A block's samples by rising hash in one row, and for each one its neighbours by place."""
    own, place = rows["own"].to_numpy(), rows["place"].to_numpy()
    order = np.lexsort((place, own))
    own, n = np.unique(own, return_counts=True)
    parts = (own, np.cumsum(n), rows["theirs"].to_numpy()[order], rows["distance"].to_numpy()[order])
    names = ("own", "ends", "theirs", "distance")
    return pa.table({"block": rows["block"][:1], **{c: pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for c, p in zip(names, parts)}})


def _from_neighbors(asked: np.ndarray, seen: pa.StructArray, own: np.ndarray, ends: np.ndarray, theirs: np.ndarray, distance: np.ndarray, k: int, weights: str) -> np.ndarray:
    """For each sample that asks, by hash, the mean of its first k neighbours that have a value of one feature; NaN without any."""
    have, value = (seen.field(c).to_numpy() for c in ("h", "v"))
    out = np.full(len(asked), np.nan)
    if not len(own) or not len(have):
        return out
    order = np.argsort(have)
    have, value = have[order], value[order]
    at = np.minimum(np.searchsorted(own, asked), len(own) - 1)
    rows = np.flatnonzero(own[at] == asked)
    last, first = ends[at[rows]], np.append(0, ends)[at[rows]]
    total, weight, found = (np.zeros(len(rows)) for _ in range(3))
    for i in range(int((last - first).max(initial=0))):  # the i-th neighbours of all
        place = np.minimum(first + i, len(theirs) - 1)
        there = np.minimum(np.searchsorted(have, theirs[place]), len(have) - 1)
        use = (have[there] == theirs[place]) & (first + i < last) & (found < k)
        w = np.where(use, 1.0 if weights == "uniform" else 1 / np.maximum(distance[place], 1e-12), 0.0)
        total += w * value[there]
        weight += w
        found += use
    out[rows] = np.where(weight > 0, total / np.maximum(weight, 1e-300), np.nan)
    return out


def impute_lls(cells: DataFrame, *, k: int = 10, max_iter: int = 100, tol: float = 1e-6) -> DataFrame:
    """Local least squares over features, again and again until the filled cells settle.

    A feature with gaps is predicted from the k features nearest to it over shared samples, in which gaps stand as filled so far
    (at first by the sample's mean). With fewer neighbours than observations it is fitted to them, else their values are
    averaged by inverse distance. A round uses the values of the one before for all features, so that the order of features
    doesn't matter. A feature's own column and those of its k neighbours meet in a task.
    """
    cells = once(cells)
    flipped = cells.select(F.col("feature_id").alias("sample_id"), F.col("sample_id").alias("feature_id"), "value", "mask")
    near = nearest(row_arrays(flipped), k).select(F.col("sample_id").alias("target"), F.col("other").alias("feature_id"), "distance")
    need = cells.where("value is null").select(F.col("feature_id").alias("target")).distinct()
    own = need.select("target", F.col("target").alias("feature_id"), F.lit(-1.0).alias("distance"))
    near = materialize(near.join(need, "target", "left_semi").unionByName(own))
    start = beside(cells.select("sample_id", "feature_id", "value"), "sample_id", __x=F.avg("value"))
    now = materialize(start.select("sample_id", "feature_id", "value", F.coalesce("value", "__x", F.lit(0.0)).alias("now")))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        target = rows["target"].iloc[0]
        mine = rows[rows["feature_id"] == target]
        grid = rows[rows["feature_id"] != target].pivot_table(index="sample_id", columns="feature_id", values="now", aggfunc="max").reindex(mine["sample_id"])
        x, y = np.nan_to_num(grid.to_numpy(float)), mine["value"].to_numpy(float)
        gap = np.isnan(y)
        if not x.shape[1]:
            new = np.full(gap.sum(), y[~gap].mean() if (~gap).any() else 0.0)
        elif (~gap).sum() > x.shape[1]:
            a = np.column_stack([np.ones(len(x)), x])
            new = a[gap] @ np.linalg.lstsq(a[~gap], y[~gap], rcond=None)[0]
        else:
            far = rows.drop_duplicates("feature_id").set_index("feature_id")["distance"]
            w = 1 / (far[list(grid.columns)].to_numpy(float) + 1e-10)
            new = x[gap] @ w / w.sum()
        return pd.DataFrame({"sample_id": mine["sample_id"].to_numpy()[gap], "feature_id": target, "new": new})

    for _ in range(max_iter):
        new = near.join(now, "feature_id").groupBy("target").applyInPandas(fit, "sample_id string, feature_id string, new double")
        after = now.join(new, ["sample_id", "feature_id"], "left")
        after = materialize(after.select("sample_id", "feature_id", "value", F.col("now").alias("before"), F.coalesce("value", "new", "now").alias("now")))
        moved, size = after.where("value is null").agg(F.max(F.abs(F.col("now") - F.col("before"))), F.avg(F.abs("now"))).first()
        now = after.drop("before")
        if not moved or moved / (size + 1e-10) < tol:
            break
    out = cells.join(now.select("sample_id", "feature_id", F.col("now").alias("new")), ["sample_id", "feature_id"], "left")
    return filled(out, F.coalesce("new", F.lit(0.0)))


def _refill(cells: DataFrame, step: Callable[[np.ndarray], np.ndarray], rounds: int, tol: float) -> DataFrame:
    """Fill gaps by column means, then by a low-rank view until the filled cells settle.

    Each round adds up the Gram matrix of the filled samples and how far they moved; `step` turns it into the projection that refills the gaps. The
    filled samples are a table of the shared folder that each round writes anew, so a round ships one projection alone.
    """
    cells = once(cells)
    seen = once(row_arrays(cells))
    width = check_width(seen)
    n, sums, counts = gram_sums(seen, means_only=True, width=width)
    means = np.divide(sums, counts, out=np.zeros(len(width)), where=counts > 0)
    schema = "sample_id string, gaps array<boolean>, vec array<double>, moved double, size double"

    def rows_of(ids: pa.Array, gaps: np.ndarray, x: np.ndarray, before: np.ndarray) -> pa.RecordBatch:
        at = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
        change, size = (np.where(gaps, y * y, 0).sum(1) for y in (x - before, before))
        lists = [pa.ListArray.from_arrays(at, pa.array(y.ravel())) for y in (gaps, x)]
        return pa.RecordBatch.from_arrays([ids, *lists, pa.array(change), pa.array(size)], ["sample_id", "gaps", "vec", "moved", "size"])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = dense(batch, width)
            gaps = np.isnan(x)
            x = np.where(gaps, means, x)
            yield rows_of(batch["sample_id"], gaps, x, x)

    def again(projection: np.ndarray) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, gaps = (batch[c].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("vec", "gaps"))
                yield rows_of(batch["sample_id"], gaps, np.where(gaps, (x - means) @ projection + means, x), x)

        return run

    m = len(width)

    def sums_of(batch: pa.RecordBatch) -> np.ndarray:
        x = batch["vec"].flatten().to_numpy().reshape(batch.num_rows, -1) - means
        return np.append((x.T @ x).ravel(), [pc.sum(batch[c]).as_py() or 0.0 for c in ("moved", "size")])

    rows = materialize(seen.mapInArrow(begin, schema)) if m else None
    for turn in range(rounds + 1 if m else 0):
        total = summed(rows.select("vec", "moved", "size"), sums_of, m * m + 2)
        if turn == rounds or turn and total[-2] ** 0.5 <= tol * max(total[-1], 1e-24) ** 0.5:
            break
        rows = materialize(rows.mapInArrow(again(step(total[:-2].reshape(m, m))), schema))
    if not m:
        return filled(cells, F.lit(0.0))
    names = F.array(*map(F.lit, width))
    new = rows.select("sample_id", F.explode(F.arrays_zip(names.alias("f"), F.col("gaps").alias("g"), F.col("vec").alias("x"))).alias("z")).where("z.g").select("sample_id", F.col("z.f").alias("feature_id"), F.col("z.x").alias("new"))
    out = cells.join(new, ["sample_id", "feature_id"], "left")
    return filled(out, F.coalesce("new", F.lit(0.0)))


def impute_iterative_svd(cells: DataFrame, *, n_components: int = 5, max_iter: int = 100, tol: float = 1e-5) -> DataFrame:
    """Gaps from the leading right singular vectors of the filled matrix, again and again."""

    def step(gram: np.ndarray) -> np.ndarray:
        v = np.linalg.eigh(gram)[1][:, ::-1][:, :n_components]
        return v @ v.T

    return _refill(cells, step, max_iter, tol)


def impute_softimpute(cells: DataFrame, *, shrinkage: float | None = None, rank: int | None = None, max_iter: int = 100, tol: float = 1e-4) -> DataFrame:
    """As above, with singular values lowered by a shrinkage (a fiftieth of the largest, if not given)."""

    def step(gram: np.ndarray) -> np.ndarray:
        value, v = np.linalg.eigh(gram)
        s = np.sqrt(np.maximum(value, 0))
        cut = s.max() / 50 if shrinkage is None else shrinkage
        factor = np.where(s > cut, 1 - cut / np.maximum(s, 1e-12), 0)
        if rank is not None:
            factor[: max(len(s) - rank, 0)] = 0
        return (v * factor) @ v.T

    return _refill(cells, step, max_iter, tol)


class Bpca(NamedTuple):
    """Parameters of Bayesian PCA: loadings and their spread, means, noise precision, precisions of the components."""

    w: np.ndarray
    spread: np.ndarray
    mean: np.ndarray
    tau: float
    alpha: np.ndarray


#: The priors of Bayesian PCA.
PRIOR_ALPHA, PRIOR_TAU, PRIOR_MEAN = 1e-10, 1e-10, 1e-3


def bpca_rows(x: np.ndarray, p: Bpca) -> tuple[np.ndarray, np.ndarray, float]:
    """Filled rows, and their part of the sums over rows that the next step needs: data by scores, squares."""
    q = p.w.shape[1]
    precision = np.eye(q) + p.tau * p.w.T @ p.w + p.spread
    gap = np.isnan(x)
    gaps, outer = gap.astype(float), (p.w[:, :, None] * p.w[:, None, :]).reshape(-1, q * q)
    cov = np.linalg.inv(precision - p.tau * (gaps @ outer).reshape(-1, q, q))
    d = np.where(gap, 0.0, x - p.mean)
    score = np.einsum("nij,nj->ni", cov, p.tau * d @ p.w)
    d = np.where(gap, score @ p.w.T, d)
    unsure = (gaps.T @ cov.reshape(-1, q * q)).reshape(-1, q, q)  # of each feature, over the rows that lack it
    cross = d.T @ score + np.einsum("ij,ijk->ik", p.w, unsure)
    square = (d * d).sum() + gaps.sum() / p.tau + np.einsum("ij,ijk,ik->", p.w, unsure, p.w)
    return d + p.mean, cross, float(square)


def bpca_step(cross: np.ndarray, square: float, n: int, p: Bpca) -> Bpca:
    """The parameters after one round of variational EM."""
    d, q = p.w.shape
    cross, square = cross / n, square / n
    inner = np.linalg.inv(np.eye(q) + p.tau * p.w.T @ p.w + p.spread)
    weight = np.linalg.inv(inner + p.tau * cross.T @ p.w @ inner + np.diag(p.alpha) / n)
    w = cross @ weight
    left = square - np.trace(cross.T @ w) + (p.mean @ p.mean * PRIOR_MEAN + 2 * PRIOR_TAU) / n
    tau = float(np.clip((d + 2 * PRIOR_TAU / n) / max(left, 1e-12), 1e-10, 1e10))
    spread = weight * (d / n)
    alpha = (2 * PRIOR_ALPHA + d) / (tau * np.diag(w.T @ w) + np.diag(spread) + 2 * PRIOR_ALPHA)
    return Bpca(w, spread, p.mean, tau, alpha)


def bpca_begin(gram: np.ndarray, mean: np.ndarray, q: int) -> Bpca:
    """From the covariance of the rows with gaps at 0: its first axes, and the rest of it as noise."""
    value, v = np.linalg.eigh(gram)
    value, v = np.maximum(value[::-1], 0), v[:, ::-1]
    w = v[:, :q] * np.sqrt(value[:q])
    tau = float(np.clip(1 / max(value[q:].sum(), 1e-12), 1e-10, 1e10))
    alpha = (2 * PRIOR_ALPHA + len(mean)) / (tau * np.diag(w.T @ w) + 2 * PRIOR_ALPHA)
    return Bpca(w, np.eye(q), mean, tau, alpha)


def impute_bpca(cells: DataFrame, *, n_components: int = 10, max_iter: int = 100, tol: float = 1e-4) -> DataFrame:
    """Bayesian PCA by variational EM: components that the data don't support fade through their precision.

    Samples are
    written once over all features; a round is one pass over them, of which Spark adds up sums of features by components.
    Samples without any value get the features' means; with fewer than two others, all gaps do.
    """
    cells = once(cells)
    rows = once(row_arrays(cells))
    width = check_width(rows)
    n, sums, counts = gram_sums(rows, means_only=True, width=width)
    mean = np.divide(sums, counts, out=np.zeros(len(width)), where=counts > 0)
    m = len(width)
    q = max(1, min(n_components, m - 1, n - 1))
    if n < 2 or m < 2:
        return impute_col_mean(cells)

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = pa.array(np.arange(batch.num_rows + 1) * m, pa.int32())
            yield pa.RecordBatch.from_arrays([batch["sample_id"], pa.ListArray.from_arrays(at, pa.array(dense(batch, width).ravel()))], ["sample_id", "vec"])

    rows = materialize(rows.mapInArrow(wide, "sample_id string, vec array<double>"))
    held = lambda b: b["vec"].flatten().to_numpy().reshape(b.num_rows, m)
    zero = lambda b: (lambda x: np.concatenate([x.sum(0), (x.T @ x).ravel()]))(np.nan_to_num(held(b)))
    both = summed(rows, zero, m + m * m)
    p = bpca_begin((both[m:].reshape(m, m) - np.outer(both[:m], both[:m]) / n) / (n - 1), mean, q)
    last = np.inf
    for turn in range(max_iter):
        task = lambda b, p=p: (lambda r: np.append(r[1].ravel(), r[2]))(bpca_rows(held(b), p))
        total = summed(rows, task, m * q + 1)
        p = bpca_step(total[:-1].reshape(m, q), total[-1], n, p)
        if turn % 10 == 9:
            if abs(math.log10(p.tau) - last) < tol:
                break
            last = math.log10(p.tau)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(width, object)
        for batch in batches:
            x = held(batch)
            i, j = np.nonzero(np.isnan(x))
            new = bpca_rows(x, p)[0][i, j]
            yield pa.RecordBatch.from_arrays([batch["sample_id"].take(pa.array(i)), pa.array(names[j], pa.string()), pa.array(new)], ["sample_id", "feature_id", "new"])

    new = rows.mapInArrow(fill, "sample_id string, feature_id string, new double")
    out = beside(cells.join(new, ["sample_id", "feature_id"], "left"), "feature_id", __x=F.avg("value"))
    return filled(out, F.coalesce("new", "__x", F.lit(0.0)))


def missing_mechanism(cells: DataFrame) -> tuple[str, dict[str, float]]:
    """mcar, mar or mnar, by the rank correlation of features' means and missing rates and the spread of samples' rates."""
    cells = once(cells)
    samples = materialize(cells.groupBy("sample_id").agg(F.count("value").alias("n")))
    features = materialize(cells.groupBy("feature_id").agg(F.avg("value").alias("m"), F.count("value").alias("n")))
    n_samples, n_seen = samples.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_features = features.count()
    rate = 1 - n_seen / max(n_samples * n_features, 1)
    if rate <= 0:
        return "mcar", {"missing_rate": 0.0}
    per_sample = samples.select((1 - F.col("n") / n_features).alias("r"))
    spread = per_sample.agg(F.coalesce(F.stddev_pop("r") / (F.avg("r") + 1e-12), F.lit(0.0))).first()[0]
    features = features.withColumn("r", 1 - F.col("n") / n_samples).where("n >= 5 and r > 0")
    ranked = features.withColumns({"a": F.row_number().over(Window.orderBy("m", "feature_id")), "b": F.row_number().over(Window.orderBy("r", "feature_id"))})
    rho = ranked.agg(F.corr("a", "b")).first()[0]
    stats = {"missing_rate": rate, "spearman": rho, "sample_cv": spread}
    if rho is not None and rho <= -0.45:
        return "mnar", stats
    if spread >= 0.6 and rate >= 0.05:
        return "mar", stats
    if (rho is not None and abs(rho) <= 0.2) or rate <= 0.08:
        return "mcar", stats
    return ("mnar" if rho is not None and rho < -0.2 else "mar"), stats


IMPUTERS: dict[str, Callable[..., DataFrame]] = {
    "none": impute_none, "zero": impute_zero, "row_mean": impute_row_mean, "row_median": impute_row_median, "half_row_min": impute_half_row_min, "knn": impute_knn, "lls": impute_lls,
    "minprob": impute_minprob, "qrilc": impute_qrilc, "bpca": impute_bpca, "missforest": impute_missforest, "iterative_svd": impute_iterative_svd, "softimpute": impute_softimpute,
}


def register_imputer(name: str, method: Callable[..., DataFrame]) -> None:
    if name in IMPUTERS:
        raise ValidationError(f"there is a method {name!r} already")
    IMPUTERS[name] = method


def impute(ds: Dataset, method: str = "knn", *, assay: str = "protein", source_layer: str = "raw", new_layer: str | None = None, **params) -> Dataset:
    """Add an imputed layer; method "auto" takes the one for the missing mechanism that the data suggest."""
    if method == "auto":
        mechanism, stats = missing_mechanism(ds.layer(assay, source_layer))
        method = RECOMMENDED[mechanism]
        ds = ds.log("infer_missing_mechanism", {"mechanism": mechanism, **stats})
    if method not in IMPUTERS:
        raise ValidationError(f"method is one of {sorted(IMPUTERS)}, not {method!r}")
    return ds.apply(assay, source_layer, new_layer or f"imputed_{method}", IMPUTERS[method], **params)
