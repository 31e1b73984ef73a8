"""What a transformed layer keeps of its input: differences between groups, likeness of samples, spread of samples and features.

Labels are (sample_id, label), at most MAX_LABELS of them. A feature's mean over the samples of a label is 0 where none has a
value. No pairs of samples are formed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..operators.matrix import dense, feature_list, row_arrays, summed
from ..storage import once
from .metrics import calinski_harabasz, labelled_neighbors, silhouette

MAX_LABELS = 1000
EPS = 1e-10


def label_names(labels: DataFrame) -> list[str]:
    """All labels, ascending; at most MAX_LABELS."""
    found = labels.where("label is not null").select(F.col("label").cast("string")).distinct().limit(MAX_LABELS + 1).collect()
    if len(found) > MAX_LABELS:
        raise ValidationError(f"more than {MAX_LABELS} labels")
    return sorted(r[0] for r in found)


def label_effects(before: DataFrame, after: DataFrame, labels: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, n, strength, gap, r, spread, length, spread_after, length_after): differences of the feature means of two labels.

    strength and gap are the mean absolute differences before and after, r is the correlation of both over the n features; labels of
    fewer than `least` samples take no part. Each feature's means are brought into one row, whose pairs are summed where it lies.
    """
    sizes = labels.where("label is not null").groupBy(F.col("label").cast("string").alias("label")).count().where(F.col("count") >= least)
    names = label_names(sizes)
    long = before.select("sample_id", "feature_id", F.col("value").alias("x"), F.lit(None).cast("double").alias("y")).unionAll(after.select("sample_id", "feature_id", F.lit(None).cast("double"), "value"))
    mean = long.join(labels.select("sample_id", F.col("label").cast("string").alias("label")), "sample_id").groupBy("feature_id", "label").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    rows = mean.groupBy("feature_id").agg(F.map_from_entries(F.collect_list(F.struct("label", F.struct("x", "y").alias("m")))).alias("m"))
    zero = lambda m: F.struct(F.coalesce(m["x"], F.lit(0.0)).alias("x"), F.coalesce(m["y"], F.lit(0.0)).alias("y"))
    row = rows.select(F.transform(F.array(*map(F.lit, names)).cast("array<string>"), lambda v: F.struct(v.alias("label"), zero(F.try_element_at("m", v)).alias("m"))).alias("row"))
    one = row.select(F.posexplode("row").alias("i", "one"), "row")
    two = one.select("one", F.explode(F.slice("row", F.col("i") + 2, F.size("row"))).alias("two"))
    e, f = (F.col(f"one.m.{c}") - F.col(f"two.m.{c}") for c in "xy")
    pair = two.select(F.col("one.label").alias("a"), F.col("two.label").alias("b"), e.alias("e"), f.alias("f")).groupBy("a", "b")
    length = lambda c: F.sqrt(F.sum(F.col(c) ** 2))
    r = F.try_divide(F.covar_pop("e", "f"), F.stddev_pop("e") * F.stddev_pop("f"))
    return pair.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs("e")).alias("strength"), F.avg(F.abs("f")).alias("gap"), r.alias("r"),
        F.stddev_pop("e").alias("spread"), length("e").alias("length"), F.stddev_pop("f").alias("spread_after"), length("f").alias("length_after"),
    )


def intergroup_preservation(before: DataFrame, after: DataFrame, labels: DataFrame) -> DataFrame:
    """(score): how well differences between groups keep direction (0.6) and size (0.4), on average over pairs of groups.

    Pairs over fewer than ten features, without spread, or of a mean difference under 8 % of the mean feature deviation don't count.
    """
    scale = before.groupBy("feature_id").agg(F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("sd")).agg(F.greatest(F.coalesce(F.avg("sd"), F.lit(0.0)), F.lit(EPS)).alias("scale"))
    pairs = label_effects(before, after, labels, 2).where((F.col("n") >= 10) & (F.col("spread") >= EPS) & (F.col("spread_after") >= EPS) & (F.col("length") >= EPS))
    size = F.exp(-F.abs(F.log(F.greatest(F.col("length_after") / (F.col("length") + EPS), F.lit(EPS)))))
    score = 0.6 * (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r"))) + 1) / 2 + 0.4 * size
    # scale is one row
    return pairs.join(F.broadcast(scale)).where(F.col("strength") >= 0.08 * F.col("scale")).agg(F.coalesce(F.avg(score), F.lit(0.0)).alias("score"))


def reduction(before: str, after: str) -> Column:
    """0.5 for no change, 1 where nothing is left, down to 0 where it doubles; 0 if there was nothing to reduce."""
    share = (F.col(before) - F.col(after)) / F.col(before)
    score = F.when(F.col(before) >= EPS, 0.5 + 0.5 * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), share)))
    return F.coalesce(score, F.lit(0.0)).alias("score")


def technical_variance(before: DataFrame, after: DataFrame, batches: DataFrame) -> DataFrame:
    """(score): the reduction of the mean gap between batches' feature means."""
    return label_effects(before, after, batches).agg(F.avg("strength").alias("x"), F.avg("gap").alias("y")).select(reduction("x", "y"))


def loading_bias_reduction(before: DataFrame, after: DataFrame) -> DataFrame:
    """(score): the reduction of the median absolute deviation of sample medians; samples without values have 0."""

    def spread(cells: DataFrame, name: str) -> DataFrame:
        part = cells.groupBy("sample_id").agg(F.coalesce(F.median("value"), F.lit(0.0)).alias("m"))
        # one row
        return part.join(F.broadcast(part.agg(F.median("m").alias("mid")))).agg(F.median(F.abs(F.col("m") - F.col("mid"))).alias(name))

    return spread(before, "x").join(F.broadcast(spread(after, "y"))).select(reduction("x", "y"))


def intragroup_variation(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(score): exp(-x), x the mean over groups of the median CV of features of positive mean and two values or more."""
    part = cells.where("value is not null").join(labels, "sample_id").groupBy("label", "feature_id").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    cv = part.where((F.col("n") >= 2) & (F.col("m") > EPS)).groupBy("label").agg(F.median(F.col("sd") / F.col("m")).alias("cv"))
    return cv.agg(F.coalesce(F.exp(-F.avg("cv")), F.lit(0.0)).alias("score"))


def even_variation(cells: DataFrame) -> DataFrame:
    """(score): 1 less the CV of the features' CVs, 0 at least: intragroup variation where groups aren't known."""
    part = cells.groupBy("feature_id").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("sd")).where((F.col("n") >= 2) & (F.col("m") > EPS))
    x = part.select((F.col("sd") / F.col("m")).alias("cv")).agg(F.count("cv").alias("n"), F.avg("cv").alias("m"), F.stddev_pop("cv").alias("sd"))
    score = F.when(F.col("n") == 0, 0.0).when(F.col("n") == 1, 1.0).when(F.col("m") < EPS, 0.0).otherwise(1 - F.least(F.lit(1.0), F.col("sd") / F.col("m")))
    return x.select(score.alias("score"))


def signal_preservation(before: DataFrame, after: DataFrame) -> float:
    """(1 + r) / 2 of the correlations of all pairs of samples before and after, gaps as 0; for MAX_FEATURES features at most.

    Sums over pairs of samples of products of correlations are squared norms of products of the two matrices of unit rows,
    features by features, so that the work grows with the samples and not with their pairs.
    """
    wide = lambda cells, name: row_arrays(cells.withColumn("value", F.coalesce("value", F.lit(0.0)))).select("sample_id", F.col("names").alias(f"names_{name}"), F.col("vec").alias(f"vec_{name}"))
    rows = once(wide(before, "x").join(wide(after, "y"), "sample_id"))
    names = feature_list(before.unionByName(after, allowMissingColumns=True).groupBy("feature_id").agg(F.lit(0).alias("x")).select(F.array("feature_id").alias("names")))
    p = len(names)

    def matrix(batch: pa.RecordBatch, side: str) -> tuple[np.ndarray, np.ndarray]:
        """Rows of length 1, less their means; 0 for rows without spread."""
        x = np.nan_to_num(dense(pa.RecordBatch.from_arrays([batch[f"names_{side}"], batch[f"vec_{side}"]], ["names", "vec"]), names))
        x = x - x.mean(1, keepdims=True)
        length = np.linalg.norm(x, axis=1, keepdims=True)
        flat = length[:, 0] ** 2 / max(p, 1) <= EPS
        return np.where(flat[:, None], 0.0, x / np.where(length > 0, length, 1)), flat

    def sums(batch: pa.RecordBatch) -> np.ndarray:
        (z, flat), (w, still) = matrix(batch, "x"), matrix(batch, "y")
        return np.concatenate([[len(z), flat.sum(), still.sum()], z.sum(0), w.sum(0)])

    if not p:
        return 0.0
    first = summed(rows, sums, 3 + 2 * p)
    n, flat, still = first[:3]
    if n < 2:
        return 0.0
    if flat or still:  # correlations of some samples aren't defined
        var = lambda c: c.agg(F.var_pop(F.coalesce("value", F.lit(0.0)))).first()[0] or 0.0
        v, u = var(before), var(after)
        return 0.0 if min(v, u) < EPS else min(u / v, v / u)
    norm = lambda a, b: float((summed(rows, lambda t: (matrix(t, a)[0].T @ matrix(t, b)[0]).ravel(), p * p) ** 2).sum())
    m = n * (n - 1) / 2
    sx, sy = ((float(s @ s) - n) / 2 for s in (first[3 : 3 + p], first[3 + p :]))
    xx, yy, xy = ((norm(a, b) - n) / 2 for a, b in ("xx", "yy", "xy"))
    spread = (xx / m - (sx / m) ** 2) * (yy / m - (sy / m) ** 2)
    if m < 2 or spread <= 1e-24:
        return 0.0
    return float(np.clip((1 + (xy / m - sx * sy / m**2) / np.sqrt(spread)) / 2, 0, 1))


def filled_points(cells: DataFrame) -> DataFrame:
    """(sample_id, vec): features and samples of two values or more, gaps filled by the feature's median."""
    seen = once(cells.where("value is not null").select("sample_id", "feature_id", "value"))
    kept = seen.groupBy("feature_id").agg(F.median("value").alias("mid"), F.count("value").alias("n")).where("n >= 2").select("feature_id", "mid")
    part = once(seen.join(kept, "feature_id"))
    samples = part.groupBy("sample_id").agg(F.collect_list(F.struct("feature_id", "value")).alias("c")).where(F.size("c") >= 2).select("sample_id", F.map_from_entries("c").alias("c"))
    # one row of all kept features, as long as a sample's own
    row = kept.agg(F.array_sort(F.collect_list(F.struct("feature_id", "mid"))).alias("row"))
    return samples.join(row).select("sample_id", F.transform("row", lambda x: F.coalesce(F.try_element_at("c", x["feature_id"]), x["mid"])).alias("vec"))


def separation(points: DataFrame) -> float:
    """0.6 of the silhouette, brought to 0..1, and 0.4 of the variance ratio's score, of (sample_id, label, vec)."""
    s, c = silhouette(points).agg(F.avg("s")).first()[0], calinski_harabasz(points).first()[0]
    return 0.0 if s is None or c is None else float(np.clip(0.6 * (s + 1) / 2 + 0.4 * c, 0, 1))


def label_width(points: DataFrame) -> float:
    """The mean silhouette of (sample_id, label, vec), brought to 0..1."""
    s = silhouette(points).agg(F.avg("s")).first()[0]
    return 0.0 if s is None else float(np.clip((s + 1) / 2, 0, 1))


def label_variety(rows: DataFrame, labels: DataFrame, k: int = 30) -> DataFrame:
    """(score): how many of all labels are among a sample's k nearest, on average."""
    kinds = labels.agg(F.countDistinct("label").alias("kinds"))
    near = labelled_neighbors(rows, labels, k).groupBy("sample_id").agg(F.countDistinct("label").alias("n"))
    return near.join(F.broadcast(kinds)).agg(F.coalesce(F.avg(F.col("n") / F.col("kinds")), F.lit(0.0)).alias("score"))


def variance_agreement(before: DataFrame, after: DataFrame) -> DataFrame:
    """(score): (1 + r) / 2 of the features' variances before and after, of those that vary in both; 0 without spread."""
    var = lambda c, name: c.groupBy("feature_id").agg(F.var_samp("value").alias(name)).where(F.col(name) > 0)
    both = var(before, "x").join(var(after, "y"), "feature_id")
    moments = both.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"), F.covar_pop("x", "y").alias("c"))
    fit = (F.col("n") >= 2) & (F.least("sx", "sy") >= 1e-12)
    return moments.select(F.coalesce(F.when(fit, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 + F.col("c") / (F.col("sx") * F.col("sy"))) / 2))), F.lit(0.0)).alias("score"))
