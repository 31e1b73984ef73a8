"""Batch integration of layers: ComBat, linear-model and mutual-nearest-neighbour corrections."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..model import CELL, Dataset
from ..storage import materialize, once
from .harmony import integrate_harmony
from .matrix import beside, cosine_normalized, row_arrays
from .neighbors import mutual_neighbors, nearest
from .pairs import same_places
from .reduce import pca
from .scanorama import integrate_scanorama


MAX_LEVELS = 1000  # values of a categorical covariate
WEIGHT_BLOCK = 1024  # features of a block in nonparametric ComBat


def check_batches(obs: DataFrame, batch: str, least: int = 2) -> None:
    """At least two batches, each of at least `least` samples."""
    sizes = obs.groupBy(batch).count()
    n, smallest = sizes.agg(F.count(F.lit(1)), F.min("count")).first()
    if n < 2 or smallest < least:
        raise ValidationError("integration needs two batches or more, and two samples or more in each")


def _batched(cells: DataFrame, obs: DataFrame, batch: str) -> DataFrame:
    return cells.select(*CELL).join(obs.select("sample_id", F.col(batch).alias("batch")), "sample_id")


def integrate_none(cells: DataFrame, obs: DataFrame, *, batch: str = "batch") -> DataFrame:
    return cells


def covariate_design(obs: DataFrame, covariates: tuple[str, ...], batch: str) -> DataFrame:
    """(sample_id, batch, x0, x1, ...): numbers as they are, other covariates as indicators of all values but the first.

    Covariates must have no nulls. A categorical one may have at most MAX_LEVELS values.
    """
    if obs.where(" or ".join(f"`{c}` is null" for c in covariates)).limit(1).count():
        raise ValidationError("covariates must have no missing values")
    columns = []
    kinds = dict(obs.dtypes)
    for c in covariates:
        if kinds[c] in ("double", "float", "int", "bigint", "smallint", "tinyint") or kinds[c].startswith("decimal"):
            columns.append(F.col(c).cast("double"))
            continue
        levels = sorted(str(r[0]) for r in obs.select(F.col(c).cast("string")).distinct().limit(MAX_LEVELS + 1).collect())
        if len(levels) > MAX_LEVELS:
            raise ValidationError(f"covariate {c} has more than {MAX_LEVELS} values")
        columns += [(F.col(c).cast("string") == v).cast("double") for v in levels[1:]]
    return obs.select("sample_id", F.col(batch).cast("string").alias("batch"), *(x.alias(f"x{i}") for i, x in enumerate(columns)))


def covariate_effects(cells: DataFrame, obs: DataFrame, covariates: tuple[str, ...], batch: str) -> DataFrame:
    """(sample_id, feature_id, effect): what covariates explain of complete cells beside the batches, by least squares.

    Both sides are centred within batches, after which a feature's coefficients are those of the whole design.
    """
    design = covariate_design(obs, covariates, batch)
    names = [c for c in design.columns if c.startswith("x")]
    centred = design.join(design.groupBy("batch").agg(*(F.avg(c).alias(f"m{c}") for c in names)), "batch").select("sample_id", *(F.col(c).alias(f"raw{c}") for c in names), *((F.col(c) - F.col(f"m{c}")).alias(c) for c in names))
    gram = np.array(centred.agg(*(F.sum(F.col(a) * F.col(b)) for a in names for b in names)).first(), float).reshape(len(names), -1)
    if np.linalg.matrix_rank(gram) < len(names):
        raise ValidationError("batches and covariates are confounded")
    inverse = np.linalg.inv(gram)
    rows = cells.select("sample_id", "feature_id", "value").join(centred, "sample_id")
    sums = rows.groupBy("feature_id").agg(*(F.sum(F.col(c) * F.col("value")).alias(f"s{c}") for c in names))
    beta = [sum(F.col(f"s{c}") * float(w) for c, w in zip(names, line)).alias(f"b{i}") for i, line in enumerate(inverse)]
    effect = sum(F.col(f"b{i}") * F.col(f"raw{c}") for i, c in enumerate(names))
    return rows.join(sums.select("feature_id", *beta), "feature_id").select("sample_id", "feature_id", effect.alias("effect"))


def neighbour_weights(part: DataFrame) -> DataFrame:
    """Nonparametric posteriors: each feature's means of the other features' estimates of its batch, weighted by likelihood.

    Features are dealt into blocks; each pair of blocks of a batch meets in a task, which returns sums scaled by their largest
    likelihood; these are added up by feature.
    """
    blocks = max(1, -(-part.groupBy("batch").count().agg(F.max("count")).first()[0] // WEIGHT_BLOCK))
    place = F.pmod(F.xxhash64("feature_id"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = part.select("batch", "feature_id", "n", "g", "d", place.alias("i"), every.alias("j"))
    right = part.select(*(F.col(c).alias(c) for c in ("batch", "feature_id", "g", "d")), place.alias("j"), every.alias("i"))

    def weigh(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({c: [] for c in ("batch", "feature_id", "top", "w", "wg", "wd")})
        n, g, d = (x[c].to_numpy(float)[:, None] for c in ("n", "g", "d"))
        og, od = (y[c].to_numpy(float)[None] for c in ("g", "d"))
        like = -0.5 * n * np.log(2 * np.pi * od) - ((n - 1) * d + n * (g - og) ** 2) / (2 * od)
        like[x["feature_id"].to_numpy()[:, None] == y["feature_id"].to_numpy()[None]] = -np.inf
        top = like.max(1)
        w = np.exp(like - np.where(np.isfinite(top), top, 0)[:, None])
        return pd.DataFrame({"batch": x["batch"], "feature_id": x["feature_id"], "top": top, "w": w.sum(1), "wg": w @ og[0], "wd": w @ od[0]})

    key = ["batch", "i", "j"]
    sums = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(weigh, "batch string, feature_id string, top double, w double, wg double, wd double").where("w > 0")
    best = sums.groupBy("batch", "feature_id").agg(F.max("top").alias("best"))
    scaled = sums.join(best, ["batch", "feature_id"])
    by = F.exp(F.col("top") - F.col("best"))
    mean = lambda c: (F.sum(F.col(c) * by) / F.sum(F.col("w") * by))
    return scaled.groupBy("batch", "feature_id").agg(mean("wg").alias("g_new"), mean("wd").alias("d_new")).join(part.select("batch", "feature_id", "grand", "sd"), ["batch", "feature_id"])


def integrate_combat(cells: DataFrame, obs: DataFrame, *, batch: str = "batch", covariates: tuple[str, ...] = (), eb_mode: str = "parametric") -> DataFrame:
    """Empirical-Bayes location and scale adjustment; needs complete cells. What covariates explain is kept.

    Each (feature, batch) has two moments; the priors of a batch are moments of these over the features. The posterior of each
    feature is found on its own. Features that don't vary within batches stay as they are. nonparametric weighs the other
    features' estimates, whose number squared it looks at, in blocks.
    """
    check_batches(obs, batch)
    if eb_mode not in ("parametric", "nonparametric"):
        raise ValidationError("eb_mode is parametric or nonparametric")
    if cells.where("value is null").limit(1).count():
        raise ValidationError("ComBat needs cells without missing values")
    rows = _batched(cells, obs, batch)
    if covariates:
        rows = rows.join(covariate_effects(cells, obs, covariates, batch), ["sample_id", "feature_id"]).withColumn("value", F.col("value") - F.col("effect"))
    else:
        rows = rows.withColumn("effect", F.lit(0.0))
    part = rows.groupBy("feature_id", "batch").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    whole = part.groupBy("feature_id").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sqrt(F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("sd"))
    part = part.join(whole, "feature_id").where("sd > 0")
    part = part.withColumns({"g": (F.col("m") - F.col("grand")) / F.col("sd"), "d": F.col("v") / F.col("sd") ** 2 * F.col("n") / (F.col("n") - 1)})
    prior = part.groupBy("batch").agg(F.avg("g").alias("g_bar"), F.var_samp("g").alias("t2"), F.avg("d").alias("d_bar"), F.var_samp("d").alias("d_var"))
    part = part.join(F.broadcast(prior), "batch")

    def posterior(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            n, g, d, g_bar, t2 = (x[c].to_numpy(float) for c in ("n", "g", "d", "g_bar", "t2"))
            d_bar, d_var = x["d_bar"].to_numpy(float), np.maximum(x["d_var"].to_numpy(float), 1e-12)
            a, b = (2 * d_var + d_bar**2) / d_var, (d_bar * d_var + d_bar**3) / d_var
            ss = (n - 1) * d  # around the batch's own mean
            g_new, d_new = g.copy(), d.copy()
            for _ in range(100):
                g_next = (t2 * n * g + d_new * g_bar) / (t2 * n + d_new)
                d_next = (0.5 * (ss + n * (g - g_next) ** 2) + b) / (n / 2 + a - 1)
                change = max(np.abs(g_next - g_new).max(initial=0), np.abs(d_next - d_new).max(initial=0))
                g_new, d_new = g_next, d_next
                if change < 1e-4:
                    break
            yield x.assign(g_new=g_new, d_new=d_new)[["feature_id", "batch", "grand", "sd", "g_new", "d_new"]]

    schema = "feature_id string, batch string, grand double, sd double, g_new double, d_new double"
    part = part.withColumn("batch", F.col("batch").cast("string"))
    found = part.mapInPandas(posterior, schema) if eb_mode == "parametric" else neighbour_weights(materialize(part))
    out = rows.withColumn("batch", F.col("batch").cast("string")).join(found, ["feature_id", "batch"], "left")
    z = (F.col("value") - F.col("grand")) / F.col("sd")
    return out.withColumn("value", F.coalesce((z - F.col("g_new")) / F.sqrt("d_new") * F.col("sd") + F.col("grand"), F.col("value")) + F.col("effect")).select(*CELL)


def pivoted_solve(gram: np.ndarray, right: np.ndarray, tol: float = 1e-9) -> tuple[np.ndarray, int]:
    """(coefficients, rank) of a least-squares problem from its Gram matrix; columns that others give already get 0.

    Columns are taken by the largest length that is left of them (pivoted Cholesky), the first of equals, until nothing is left.
    """
    left, taken = gram.astype(float).copy(), []
    top = max(float(np.diag(left).max(initial=0.0)), 1e-300)
    while len(taken) < len(left):
        d = np.diag(left).copy()
        d[taken] = -1.0
        at = int(np.argmax(d >= d.max() * (1 - 1e-9)))
        if d[at] <= tol * top:
            break
        taken.append(at)
        left -= np.outer(left[:, at], left[at]) / left[at, at]
    out, keep = np.zeros(len(gram)), sorted(taken)
    if keep:
        out[keep] = np.linalg.solve(gram[np.ix_(keep, keep)], right[keep])
    return out, len(keep)


def limma_design(obs: DataFrame, batch: str, covariates: tuple[str, ...]) -> tuple[DataFrame, list[str], int]:
    """(sample_id, batch, design), the batches, and how many columns come before theirs.

    The design is an intercept, the covariates (numbers as they are, other values as indicators without the first), and sum
    contrasts of the batches. Its width is that of the distinct values, which the driver holds.
    """
    columns, kinds = [F.lit(1.0)], dict(obs.dtypes)
    for c in covariates:
        numeric = kinds[c].split("(")[0] in ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")
        if obs.where(F.col(c).isNull() | (F.isnan(F.col(c).cast("double")) if numeric else F.lit(False))).limit(1).count():
            raise ValidationError(f"covariate {c} has missing values")
        if numeric:
            columns.append(F.col(c).cast("double"))
        else:
            levels = sorted(r[0] for r in obs.select(F.col(c).cast("string")).distinct().collect())
            columns += [(F.col(c).cast("string") == v).cast("double") for v in levels[1:]]
    names = sorted(r[0] for r in obs.select(F.col(batch).cast("string")).distinct().collect())
    at = F.col(batch).cast("string")
    contrasts = [F.when(at == names[-1], -1.0).otherwise((at == v).cast("double")) for v in names[:-1]]
    return obs.select("sample_id", at.alias("batch"), F.array(*columns, *contrasts).alias("design")), names, len(columns)


def integrate_limma(cells: DataFrame, obs: DataFrame, *, batch: str = "batch", covariates: tuple[str, ...] = (), reference_batch: str | None = None) -> DataFrame:
    """Subtract each feature's batch effects, as sum contrasts of a linear model on its observed samples; nulls stay.

    Without covariates the model's effects are batch means less their mean. With them, sums of products of the design's columns
    are added up for each feature, and a task solves many features' small systems; what a feature's samples cannot tell apart
    is left to the columns taken first. A design that is confounded as a whole is an error.
    """
    check_batches(obs, batch)
    rows = _batched(cells, obs, batch)
    if not covariates:
        mean = rows.groupBy("feature_id", "batch").agg(F.avg("value").alias("m")).where("m is not null")
        effect = mean.withColumn("effect", F.col("m") - F.avg("m").over(Window.partitionBy("feature_id"))).drop("m")
    else:
        design, names, ahead = limma_design(obs, batch, covariates)
        design = materialize(design)
        width = ahead + len(names) - 1
        pairs = [(i, j) for i in range(width) for j in range(i, width)]
        x = lambda i: F.element_at("design", i + 1)
        sums = lambda: F.array(*(F.sum(x(i) * x(j)) for i, j in pairs)).alias("gram")

        def square(values) -> np.ndarray:
            out = np.zeros((width, width))
            for (i, j), v in zip(pairs, values):
                out[i, j] = out[j, i] = v
            return out

        if pivoted_solve(square(design.agg(sums()).first()[0]), np.zeros(width))[1] < width:
            raise ValidationError("batches and covariates are confounded")
        contrast = np.vstack([np.eye(len(names) - 1), -np.ones(len(names) - 1)])

        def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in frames:
                found = [contrast @ pivoted_solve(square(g), np.asarray(r, float))[0][ahead:] for g, r in zip(part["gram"], part["right"])]
                yield pd.DataFrame({"feature_id": part["feature_id"].repeat(len(names)), "batch": names * len(part), "effect": np.concatenate(found) if found else []})

        met = cells.where("value is not null").select("sample_id", "feature_id", "value").join(design, "sample_id")
        moments = met.groupBy("feature_id").agg(sums(), F.array(*(F.sum(x(i) * F.col("value")) for i in range(width))).alias("right"))
        effect = moments.mapInPandas(solve, "feature_id string, batch string, effect double")
    rows = rows.withColumn("batch", F.col("batch").cast("string"))
    effect = effect.withColumn("batch", F.col("batch").cast("string"))
    out = rows.join(effect, ["feature_id", "batch"], "left")
    value = F.col("value") - F.coalesce("effect", F.lit(0.0))
    if reference_batch is not None:
        base = effect.where(F.col("batch") == reference_batch).select("feature_id", F.col("effect").alias("base"))
        out = out.join(base, "feature_id", "left")
        value = value + F.coalesce("base", F.lit(0.0))
    return out.withColumn("value", value).select(*CELL)


def search_space(left: DataFrame, right: DataFrame, n_pcs: int | None) -> tuple[DataFrame, DataFrame]:
    """The two sides as (sample_id, names, vec), over principal components of both if n_pcs is given."""
    if n_pcs is None:
        return row_arrays(left), row_arrays(right)
    scores = materialize(pca(left.unionByName(right), n_pcs)["scores"])
    names = F.transform(F.sequence(F.lit(1), F.size("vec")), lambda i: F.concat(F.lit("PC"), i.cast("string")))
    rows = scores.select("sample_id", names.alias("names"), "vec")
    return tuple(rows.join(side.select("sample_id").distinct(), "sample_id", "left_semi") for side in (left, right))


def span_of(cells: DataFrame, dims: int) -> DataFrame:
    """(feature_id, vec): the leading axes of some samples, which stand for biology."""
    return pca(cells, dims)["loadings"]


def without_span(shift: DataFrame, span: DataFrame) -> DataFrame:
    """(b, feature_id, shift) less its part along the axes of `span`."""
    long = span.select("feature_id", F.posexplode("vec").alias("axis", "w"))
    along = shift.join(long, "feature_id").groupBy("b", "axis").agg(F.sum(F.col("shift") * F.col("w")).alias("s"))
    part = along.join(long, "axis").groupBy("b", "feature_id").agg(F.sum(F.col("s") * F.col("w")).alias("part"))
    return shift.join(part, ["b", "feature_id"], "left").select("b", "feature_id", (F.col("shift") - F.coalesce("part", F.lit(0.0))).alias("shift"))


def adjusted_variance(smooth: DataFrame, new: DataFrame, merged: DataFrame) -> DataFrame:
    """Shifts lengthened so that a sample's place along its shift, among its own batch, becomes the same place among the merged.

    Places are the shares of samples with a smaller projection on the shift's direction; a factor is never below 1. Every sample
    is projected on every shift of the batch, whose number is that of the batch's samples, in blocks of both.
    """
    along = smooth.withColumnRenamed("shift", "value")
    dot = along.join(new.select("sample_id", "feature_id", F.col("value").alias("own")), ["sample_id", "feature_id"]).groupBy("sample_id").agg(F.sum(F.col("value") * F.col("own")).alias("dot")).where("dot is not null")
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    axes = row_arrays(along).withColumn("length", length).where("length > 0").join(dot, "sample_id")
    axes = materialize(axes.select("sample_id", "names", F.transform("vec", lambda x: x / F.col("length")).alias("vec"), "length", (F.col("dot") / F.col("length")).alias("here")))
    places = same_places(axes, once(row_arrays(new)), once(row_arrays(merged)))
    scale = places.join(axes.select("sample_id", "length", "here"), "sample_id").select("sample_id", F.greatest(F.lit(1.0), (F.col("place") - F.col("here")) / F.col("length")).alias("scale"))
    return smooth.join(scale, "sample_id", "left").select("sample_id", "feature_id", (F.col("shift") * F.coalesce("scale", F.lit(1.0))).alias("shift"))


def integrate_mnn(
    cells: DataFrame, obs: DataFrame, *, batch: str = "batch", k: int = 20, sigma: float = 1.0, order: list[str] | None = None,
    n_pcs: int | None = None, cos_norm_in: bool = True, cos_norm_out: bool = True, svd_dim: int = 0, var_adj: bool = True, use_anchor_correction: bool = True,
) -> DataFrame:
    """Merge batches one by one, the largest first: shift each new sample by differences of mutual neighbours.

    Neighbours are looked for among samples of unit length (cos_norm_in), in n_pcs principal components if given; the values
    that are shifted are of unit length too (cos_norm_out). Differences are smoothed by Gaussian weights, or averaged over
    all pairs without use_anchor_correction, freed of the svd_dim leading axes of the paired samples of both sides, and
    lengthened by var_adj. PCA needs complete cells.
    """
    check_batches(obs, batch)
    if svd_dim < 0 or k < 1 or sigma <= 0:
        raise ValidationError("k and sigma must be positive, svd_dim not negative")
    names = order or [r[0] for r in obs.groupBy(F.col(batch).cast("string").alias("b")).count().orderBy(F.desc("count"), "b").collect()]
    known = {r[0] for r in obs.select(F.col(batch).cast("string")).distinct().collect()}
    if set(names) != known:
        raise ValidationError(f"order must name the batches {sorted(known)}")
    rows = _batched(cells, obs, batch).withColumn("batch", F.col("batch").cast("string"))
    of = obs.select("sample_id", F.col(batch).cast("string").alias("batch"))
    normal = lambda on: cosine_normalized(rows) if on else rows.select(*CELL)
    inside, outside = (materialize(normal(on).join(of, "sample_id")) for on in (cos_norm_in, cos_norm_out))
    part = lambda df, name: df.where(F.col("batch") == name).select(*CELL)
    merged_in, merged = part(inside, names[0]), part(outside, names[0])
    for name in names[1:]:
        new_in, new = part(inside, name), part(outside, name)
        left, right = map(materialize, search_space(merged_in, new_in, n_pcs))
        pairs = materialize(mutual_neighbors(left, right, k))
        if not pairs.limit(1).count():
            merged_in, merged = materialize(merged_in.unionByName(new_in)), materialize(merged.unionByName(new))
            continue
        shifted = []
        for ours, theirs in ((merged_in, new_in), (merged, new)):
            a = ours.select(F.col("sample_id").alias("a"), "feature_id", F.col("value").alias("x"))
            b = theirs.select(F.col("sample_id").alias("b"), "feature_id", F.col("value").alias("y"))
            shift = pairs.join(a, "a").join(b, ["b", "feature_id"]).groupBy("b", "feature_id").agg(F.avg(F.col("x") - F.col("y")).alias("shift"))
            if svd_dim:
                for side, column in ((ours, "a"), (theirs, "b")):
                    some = side.join(pairs.select(F.col(column).alias("sample_id")).distinct(), "sample_id", "left_semi")
                    shift = without_span(shift, span_of(some, svd_dim))
            shift = materialize(shift)
            anchors = right.join(shift.select(F.col("b").alias("sample_id")).distinct(), "sample_id", "left_semi")
            if use_anchor_correction:
                own = anchors.select("sample_id", F.col("sample_id").alias("other"), F.lit(0.0).alias("distance"))
                near = nearest(right, k, anchors).select("sample_id", "other", "distance").unionByName(own).groupBy("sample_id", "other").agg(F.min("distance").alias("distance"))
                weight = F.exp(-F.col("distance") ** 2 / (2 * sigma**2))
                smooth = near.withColumn("w", weight).join(shift.withColumnRenamed("b", "other"), "other").groupBy("sample_id", "feature_id").agg(F.try_divide(F.sum(F.col("w") * F.col("shift")), F.sum("w")).alias("shift"))
            else:
                smooth = theirs.select("sample_id", "feature_id").join(shift.groupBy("feature_id").agg(F.avg("shift").alias("shift")), "feature_id")
            if var_adj:
                smooth = adjusted_variance(materialize(smooth), theirs, ours)
            moved = theirs.join(smooth, ["sample_id", "feature_id"], "left").withColumn("value", F.col("value") + F.coalesce("shift", F.lit(0.0))).select(*CELL)
            shifted.append(materialize(ours.unionByName(moved)))
        merged_in, merged = shifted
    return merged


@dataclass(frozen=True)
class Method:
    apply: Callable[..., DataFrame]
    level: str  # what it corrects: matrix or embedding
    for_de: bool  # whether differential expression may follow


INTEGRATORS = {
    "none": Method(integrate_none, "matrix", True),
    "combat": Method(integrate_combat, "matrix", True),
    "limma": Method(integrate_limma, "matrix", True),
    "mnn": Method(integrate_mnn, "matrix", False),
    "harmony": Method(integrate_harmony, "embedding", False),
    "scanorama": Method(integrate_scanorama, "embedding", False),
}


def register_integrator(name: str, apply: Callable[..., DataFrame], *, level: str = "matrix", for_de: bool = False) -> None:
    """Add a method of one's own, called as apply(cells, obs, batch=...)."""
    if name in INTEGRATORS:
        raise ValidationError(f"there is a method {name!r} already")
    INTEGRATORS[name] = Method(apply, level, for_de)


def integrate(ds: Dataset, method: str = "combat", *, assay: str = "protein", source_layer: str = "imputed", new_layer: str | None = None, batch: str = "batch", **params) -> Dataset:
    if method not in INTEGRATORS:
        raise ValidationError(f"method is one of {sorted(INTEGRATORS)}, not {method!r}")
    return ds.apply(assay, source_layer, new_layer or method, INTEGRATORS[method].apply, obs=ds.obs, batch=batch, **params)
