"""The tables behind plots: each function returns what a plot would draw."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import correlation_pairs
from ..model import Record
from ..operators.masks import is_detected
from ..operators.linkage import leaf_order, linkage
from ..operators.matrix import row_arrays
from ..operators.pairs import all_pairs


def completeness(cells: DataFrame, obs: DataFrame, group: str = "group") -> DataFrame:
    """Valid cells of each sample, by group."""
    n = cells.groupBy("sample_id").agg(F.count_if(F.col("mask") == 0).alias("n_valid"))
    return obs.select("sample_id", F.col(group).alias("group")).join(n, "sample_id", "left").withColumn("n_valid", F.coalesce("n_valid", F.lit(0)))


def matrix_spy(cells: DataFrame) -> DataFrame:
    return cells.select("sample_id", "feature_id", (F.col("mask") > 0).cast("int").alias("missing"))


def missing_rates(grid: DataFrame, axis: str, top: int | None = None) -> DataFrame:
    """Missing rate of each sample or feature of a complete grid; the `top` most missing, if given."""
    out = grid.groupBy(axis).agg(F.avg(F.col("value").isNull().cast("int")).alias("missing_rate"))
    return out.orderBy(F.desc("missing_rate"), axis).limit(top) if top else out


def codes_per_sample(cells: DataFrame) -> DataFrame:
    """How many samples have how many different codes."""
    return cells.groupBy("sample_id").agg(F.countDistinct("mask").alias("n_codes")).groupBy("n_codes").agg(F.count(F.lit(1)).alias("n_samples"))


def sensitivity(cells: DataFrame, obs: DataFrame, group: str = "group") -> DataFrame:
    n = cells.groupBy("sample_id").agg(F.count_if(is_detected()).alias("n_detected"))
    return n.join(obs.select("sample_id", F.col(group).alias("group")), "sample_id").select("sample_id", "group", "n_detected")


def jaccard(cells: DataFrame) -> DataFrame:
    """(a, b, jaccard) of the detected features of each two samples that share one."""
    seen = cells.where(is_detected()).select("sample_id", "feature_id", F.lit(1.0).alias("value"))
    return all_pairs(row_arrays(seen), "jaccard").withColumnRenamed("value", "jaccard")


def mask_mismatch(cells: DataFrame) -> DataFrame:
    """(a, b, rate): share of features with differing codes among those that both samples report."""
    codes = row_arrays(cells.withColumn("value", F.col("mask").cast("double")))
    return all_pairs(codes, "mismatch").withColumnRenamed("value", "rate")


def cv_by_feature(cells: DataFrame) -> DataFrame:
    return cells.where(is_detected()).groupBy("feature_id").agg(F.avg("value").alias("mean"), (F.stddev_pop("value") / F.avg("value")).alias("cv"))


def cv_by_group(cells: DataFrame, obs: DataFrame, group: str = "group") -> DataFrame:
    x = cells.where(is_detected()).join(obs.select("sample_id", F.col(group).alias("group")), "sample_id")
    return x.groupBy("group", "feature_id").agg((F.stddev_pop("value") / F.avg("value")).alias("cv"))


def cv_comparison(cells: DataFrame, obs: DataFrame, batch: str = "batch") -> DataFrame:
    """(within, between, overall, ratio): mean CVs inside batches, of batch means, of all; ratio of between to overall."""
    x = cells.where(is_detected()).join(obs.select("sample_id", F.col(batch).alias("batch")), "sample_id")
    part = x.groupBy("batch", "feature_id").agg((F.stddev_pop("value") / F.avg("value")).alias("cv"), F.avg("value").alias("m"))
    within = part.groupBy("batch").agg(F.avg("cv").alias("c")).agg(F.avg("c").alias("within"))
    between = part.groupBy("feature_id").agg((F.stddev_pop("m") / F.avg("m")).alias("c")).agg(F.avg("c").alias("between"))
    overall = x.groupBy("feature_id").agg((F.stddev_pop("value") / F.avg("value")).alias("c")).agg(F.avg("c").alias("overall"))
    return within.join(F.broadcast(between)).join(F.broadcast(overall)).withColumn("ratio", F.try_divide("between", "overall"))


def dotplot(cells: DataFrame, obs: DataFrame, group: str = "group", *, log1p: bool = False, scale: str | None = None) -> DataFrame:
    """(group, feature_id, mean, share): group means, scaled to 0..1 over groups ("var") or features ("obs") if asked; share > 0."""
    x = cells.join(obs.select("sample_id", F.col(group).alias("group")), "sample_id")
    out = x.groupBy("group", "feature_id").agg(F.avg(F.log1p("value") if log1p else F.col("value")).alias("mean"), F.avg(F.coalesce(F.col("value") > 0, F.lit(False)).cast("int")).alias("share"))
    if scale:
        w = Window.partitionBy("feature_id" if scale == "var" else "group")
        span = F.max("mean").over(w) - F.min("mean").over(w)
        out = out.withColumn("mean", (F.col("mean") - F.min("mean").over(w)) / F.when(span < 1e-8, 1.0).otherwise(span))
    return out


matrixplot = tracksplot = dotplot


def heatmap(cells: DataFrame, obs: DataFrame, group: str = "group") -> DataFrame:
    return cells.join(obs.select("sample_id", F.col(group).alias("group")), "sample_id").select("group", "sample_id", "feature_id", "value").orderBy("group", "sample_id", "feature_id")


def correlation_matrix(cells: DataFrame, item: str = "sample_id", method: str = "pearson") -> DataFrame:
    return correlation_pairs(cells, item, method)


def dendrogram(cells: DataFrame) -> DataFrame:
    """(a, b, distance) of samples over shared features, for a linkage."""
    return all_pairs(row_arrays(cells), "distance").withColumnRenamed("value", "distance")


def imputation_metrics(pairs: DataFrame) -> DataFrame:
    """(method, nrmse, pcc, cosine) of (method, truth, imputed)."""
    rmse = F.sqrt(F.avg((F.col("imputed") - F.col("truth")) ** 2))
    cos = F.sum(F.col("imputed") * F.col("truth")) / F.sqrt(F.sum(F.col("imputed") ** 2) * F.sum(F.col("truth") ** 2))
    return pairs.groupBy("method").agg((rmse / F.stddev_pop("truth")).alias("nrmse"), F.corr("truth", "imputed").alias("pcc"), cos.alias("cosine"))


def imputation_pairs(truth: DataFrame, imputed: DataFrame, held: Column) -> DataFrame:
    """(sample_id, feature_id, truth, imputed) of held-out cells."""
    t = truth.where(held).select("sample_id", "feature_id", F.col("value").alias("truth"))
    return t.join(imputed.select("sample_id", "feature_id", F.col("value").alias("imputed")), ["sample_id", "feature_id"])


def aggregation_summary(links: DataFrame, top: int = 20) -> tuple[DataFrame, DataFrame]:
    """Targets by their number of sources, and the targets with most."""
    n = links.groupBy("target_id").agg(F.count(F.lit(1)).alias("n_sources"))
    return n.groupBy("n_sources").agg(F.count(F.lit(1)).alias("n_targets")), n.orderBy(F.desc("n_sources"), "target_id").limit(top)


def filtering_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    def one(cells: DataFrame, stage: str) -> DataFrame:
        return cells.agg(F.countDistinct("sample_id").alias("n_samples"), F.countDistinct("feature_id").alias("n_features"), F.avg(F.col("value").isNull().cast("int")).alias("missing_rate")).withColumn("stage", F.lit(stage))

    return one(before, "before").unionByName(one(after, "after"))


def preprocessing_summary(layers: dict[str, DataFrame]) -> DataFrame:
    """(layer, sample_id, q25, q50, q75) of each layer."""
    out = None
    for name, cells in layers.items():
        q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        one = cells.groupBy("sample_id").agg(q.alias("q")).select(F.lit(name).alias("layer"), "sample_id", *(F.element_at("q", i + 1).alias(c) for i, c in enumerate(("q25", "q50", "q75"))))
        out = one if out is None else out.unionByName(one)
    return out


def normalization_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """(sample_id, shift, cv_before, cv_after): change of the sample's median, and its CVs."""
    cv = (F.stddev_samp("value") / F.when(F.avg("value") != 0, F.avg("value"))).alias("cv")
    one = lambda c, s: c.groupBy("sample_id").agg(F.median("value").alias(f"m_{s}"), cv.alias(f"cv_{s}"))
    return one(before, "before").join(one(after, "after"), "sample_id").select("sample_id", (F.col("m_after") - F.col("m_before")).alias("shift"), "cv_before", "cv_after")


def embedding(points: DataFrame, colour: DataFrame) -> DataFrame:
    """(sample_id, x, y, colour) of (sample_id, vec) and (sample_id, colour)."""
    return points.select("sample_id", F.get("vec", F.lit(0)).alias("x"), F.get("vec", F.lit(1)).alias("y")).join(colour, "sample_id")


def recent_operations(history: list[Record] | tuple[Record, ...], n: int = 10) -> list[Record]:
    return list(history)[-n:]


def feature_mean_variance(cells: DataFrame) -> DataFrame:
    return cells.groupBy("feature_id").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("variance"))


def report(cells: DataFrame, obs: DataFrame) -> dict[str, DataFrame]:
    """The panels of a one-page report."""
    return {"overview": cells.agg(F.countDistinct("sample_id").alias("n_samples"), F.countDistinct("feature_id").alias("n_features"), F.count("value").alias("n_values")), "qc": sensitivity(cells, obs), "missing": codes_per_sample(cells), "feature": feature_mean_variance(cells), "batch": cv_comparison(cells, obs)}


def missing_pattern(grid: DataFrame, features: int = 50, samples: int = 100) -> DataFrame:
    """(sample_id, feature_id, missing) of a complete grid: its most missing features, in a hashed choice of samples."""
    top = missing_rates(grid, "feature_id", features).select("feature_id")
    some = grid.select("sample_id").distinct().orderBy(F.md5("sample_id")).limit(samples)
    return grid.join(top, "feature_id", "left_semi").join(some, "sample_id", "left_semi").select("sample_id", "feature_id", F.col("value").isNull().cast("int").alias("missing"))


def data_overview(cells: DataFrame, obs: DataFrame, group: str = "group") -> DataFrame:
    """(group, n_samples, n_values, mean, median, detection_rate) of each group of samples."""
    x = cells.join(obs.select("sample_id", F.col(group).alias("group")), "sample_id")
    return x.groupBy("group").agg(F.countDistinct("sample_id").alias("n_samples"), F.count("value").alias("n_values"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.avg(F.coalesce(is_detected(), F.lit(False)).cast("int")).alias("detection_rate"))


def batch_dispersion(cells: DataFrame, obs: DataFrame, batch: str = "batch") -> DataFrame:
    """(score): the deviation of batch means over that of all values, on average over features; less is better mixed."""
    x = cells.where("value is not null").join(obs.select("sample_id", F.col(batch).alias("batch")), "sample_id")
    part = x.groupBy("feature_id", "batch").agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("q"))
    f = part.groupBy("feature_id").agg(F.stddev_pop("m").alias("between"), F.sqrt(F.greatest(F.sum("q") / F.sum("n") - (F.sum("s") / F.sum("n")) ** 2, F.lit(0.0))).alias("sd"))
    return f.where("sd > 0").agg(F.avg(F.col("between") / F.col("sd")).alias("score"))


def integration_summary(layers: dict[str, DataFrame], obs: DataFrame, batch: str = "batch") -> DataFrame:
    """(layer, score): batch_dispersion of each layer, such as those before and after integration."""
    each = [batch_dispersion(cells, obs, batch).select(F.lit(name).alias("layer"), "score") for name, cells in layers.items()]
    return functools.reduce(DataFrame.unionByName, each)


def reduction_summary(variance: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The variance of `pca` with its running sum by falling eigenvalue, and the sizes of clusters (sample_id, label)."""
    run = Window.orderBy(F.desc("eigenvalue"), "component").rowsBetween(Window.unboundedPreceding, 0)  # a row a component
    return variance.withColumn("cumulative", F.sum("ratio").over(run)), labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def saturation(runs: DataFrame, n_features: int, share: float = 0.95) -> DataFrame:
    """(group, place): the first place of a cumulative sensitivity at which that share of all features is reached, if it is."""
    return runs.where(F.col("n_union") >= share * n_features).groupBy("group").agg(F.min("place").alias("place"))


def clustered_heatmap(cells: DataFrame, obs: DataFrame, group: str = "group", method: str = "average") -> tuple[DataFrame, DataFrame]:
    """(group, sample_id, place, feature_id, value) with samples in the order of a dendrogram's leaves, and its merges.

    Samples without a feature in common with any other one, which no distance places, come last.
    """
    merges = linkage(dendrogram(cells), method, unique=True)
    order = leaf_order(merges).select(F.col("name").alias("sample_id"), "place")
    return heatmap(cells, obs, group).join(order, "sample_id", "left").select("group", "sample_id", F.coalesce("place", F.lit(2**31 - 1)).alias("place"), "feature_id", "value"), merges
