"""Quality control: metrics of samples and features, outliers by median absolute deviation, filters, PSM scores."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions.quantiles import quantiles, running_counts, suffix_min
from ..model import MaskCode
from ..storage import once
from .masks import is_detected

MAD_SCALE = 1.4826
#: Patterns of usual contaminants.
CONTAMINANTS = ("^KRT\\d+", "Keratin", "Trypsin", "Albumin", "ALB_", "IG[HKL]", "^HBA[12]", "^HBB", "Hemoglobin", "^CON__", "^REV__")
VALID = (MaskCode.VALID,)


def detection_stats(cells: DataFrame, axis: str, total: int | Column, codes: Iterable[int] = VALID) -> DataFrame:
    """(axis, n_detected, detection_rate, mean_detected) over `total` possible cells."""
    hit = is_detected(codes)
    total = F.lit(total) if isinstance(total, int) else total
    return cells.groupBy(axis).agg(F.count_if(hit).alias("n_detected"), (F.count_if(hit) / total).alias("detection_rate"), F.avg(F.when(hit, F.col("value"))).alias("mean_detected"))


def sample_metrics(cells: DataFrame, codes: Iterable[int] = VALID) -> DataFrame:
    """(sample_id, n_features, total_intensity, log1p_total_intensity)."""
    out = cells.groupBy("sample_id").agg(F.count_if(is_detected(codes)).alias("n_features"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("total_intensity"))
    return out.withColumn("log1p_total_intensity", F.log1p("total_intensity"))


def cv(value: str = "value", min_mean: float = 1e-6) -> Column:
    """Population deviation by mean; null where the mean is nearly 0."""
    mean = F.avg(value)
    return F.when(F.abs(mean) >= min_mean, F.stddev_pop(value) / mean)


def feature_metrics(cells: DataFrame, n_samples: int, codes: Iterable[int] = VALID, min_mean: float = 1e-6) -> DataFrame:
    """(feature_id, missing_rate, detection_rate, mean_expression, cv) over n_samples samples."""
    rate = F.count_if(is_detected(codes)) / F.lit(n_samples)
    return cells.groupBy("feature_id").agg((1 - rate).alias("missing_rate"), rate.alias("detection_rate"), F.avg("value").alias("mean_expression"), cv(min_mean=min_mean).alias("cv"))


def mad_bounds(df: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, med, mad): median and scaled median absolute deviation; over everything without `by`.

    df has a row for a sample or feature; over everything the medians come from counts of value ranges, not one sorted group.
    """
    if by:
        med = df.groupBy(*by).agg(F.median(column).alias("med"))
        far = df.join(med, list(by)).withColumn("far", F.abs(F.col(column) - F.col("med")))
        return far.groupBy(*by).agg(F.first("med").alias("med"), (F.median("far") * MAD_SCALE).alias("mad"))
    (med,) = quantiles(df, column, [0.5])
    (mad,) = quantiles(df.select(F.abs(F.col(column) - F.lit(med).cast("double")).alias("far")), "far", [0.5])
    spark = df.sparkSession
    return spark.createDataFrame([(med, None if mad is None else mad * MAD_SCALE)], "med double, mad double")


def outliers(df: DataFrame, column: str, nmads: float = 3, direction: str = "both") -> DataFrame:
    """Add med, mad and is_outlier. If mad is 0, every value other than the median is out, whatever the direction."""
    df = once(df)
    x, med, mad = F.col(column), F.col("med"), F.col("mad")
    low, high = x < med - nmads * mad, x > med + nmads * mad
    if direction not in ("both", "lower", "upper"):
        raise ValidationError(f"direction is both, lower or upper, not {direction!r}")
    out = {"both": low | high, "lower": low, "upper": high}[direction]
    return df.join(F.broadcast(mad_bounds(df, column))).withColumn("is_outlier", F.coalesce(F.when(mad == 0, x != med).otherwise(out), F.lit(False)))


def low_quality_samples(cells: DataFrame, *, min_features: int = 100, nmads: float = 3, use_mad: bool = True, codes: Iterable[int] = VALID) -> DataFrame:
    """(sample_id, n_features, keep): enough features, and no outlier below."""
    metrics = sample_metrics(cells, codes).select("sample_id", "n_features")
    enough = F.col("n_features") >= min_features
    if not use_mad:
        return metrics.withColumn("keep", enough)
    return outliers(metrics, "n_features", nmads, "lower").select("sample_id", "n_features", (enough & ~F.col("is_outlier")).alias("keep"))


def doublets(cells: DataFrame, *, nmads: float = 3) -> DataFrame:
    """(sample_id, log1p_total_intensity, keep): outliers above in total intensity go."""
    metrics = sample_metrics(cells).select("sample_id", "log1p_total_intensity")
    return outliers(metrics, "log1p_total_intensity", nmads, "upper").select("sample_id", "log1p_total_intensity", (~F.col("is_outlier")).alias("keep"))


def by_missingness(metrics: DataFrame, max_missing_rate: float = 0.5) -> DataFrame:
    return metrics.where(F.col("missing_rate") <= max_missing_rate)


def by_cv(metrics: DataFrame, max_cv: float = 1.0) -> DataFrame:
    return metrics.where(F.col("cv") <= max_cv)


def batch_effects(cells: DataFrame, obs: DataFrame, batch: str = "batch", codes: Iterable[int] = VALID) -> DataFrame:
    """(batch, n_cells, median_features, std_features, median_intensity), by batch."""
    m = sample_metrics(cells, codes).join(obs.select("sample_id", F.col(batch).alias("batch")), "sample_id")
    return m.groupBy("batch").agg(F.count(F.lit(1)).alias("n_cells"), F.median("n_features").alias("median_features"), F.stddev_samp("n_features").alias("std_features"), F.median("total_intensity").alias("median_intensity"))


def sample_cv(cells: DataFrame, threshold: float = 0.65) -> DataFrame:
    """(sample_id, cv, is_high_cv)."""
    out = cells.groupBy("sample_id").agg(cv().alias("cv"))
    return out.withColumn("is_high_cv", F.coalesce(F.col("cv") > threshold, F.lit(False)))


def preflight(cells: DataFrame, *, nmads: float = 3) -> dict[str, DataFrame | float]:
    """Thresholds from the data, then the filters one after the other.

    min_features: the samples' 5% quantile of detected features, at least 10; max_missing_rate and max_cv: the features' 90%
    quantiles. Returns the thresholds, the samples and features kept, and the cells left.
    """
    cells = once(cells)
    metrics = sample_metrics(cells)
    n_features = cells.select("feature_id").distinct().count()
    (q05,) = quantiles(metrics.withColumn("x", F.col("n_features").cast("double")), "x", [0.05])
    least = min(max(10, int(q05 or 0)), max(n_features, 1))
    samples = low_quality_samples(cells, min_features=least, nmads=nmads).where("keep").select("sample_id")
    left = once(cells.join(samples, "sample_id", "left_semi"))
    single = once(doublets(left, nmads=nmads).where("keep").select("sample_id"))
    left = once(left.join(single, "sample_id", "left_semi"))
    features = once(feature_metrics(left, max(single.count(), 1)))
    (missing,) = quantiles(features, "missing_rate", [0.9])
    (top_cv,) = quantiles(features, "cv", [0.9])
    kept = by_cv(by_missingness(features, missing if missing is not None else 1.0), top_cv if top_cv is not None else 1.0).select("feature_id")
    return {"min_features": least, "max_missing_rate": missing, "max_cv": top_cv, "samples": single, "features": kept, "cells": left.join(kept, "feature_id", "left_semi")}


def contaminant(column: Column, patterns: Iterable[str] = CONTAMINANTS) -> Column:
    """Whether a name matches one of the patterns; null names don't."""
    return F.coalesce(column.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def by_qvalue(psms: DataFrame, column: str, threshold: float = 0.01) -> DataFrame:
    return psms.where(F.col(column) < threshold)


def by_purity(psms: DataFrame, column: str, least: float = 0.8) -> DataFrame:
    return psms.where(F.col(column) >= least)


def q_values(psms: DataFrame, column: str = "pep", method: str = "storey", lambda_param: float = 0.5) -> DataFrame:
    """Add q_value. Null scores count as 1 and stay null; scores are clipped to 0..1.

    q is the least of score * share of nulls * n / rank over this score and all larger ones. Ranks are counted by distinct
    scores over ranges, so no task sees all rows.
    """
    if method not in ("storey", "bh") or not 0 <= lambda_param < 1:
        raise ValidationError("method is storey or bh, lambda_param in [0, 1)")
    p = F.least(F.greatest(F.coalesce(F.col(column), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    counts = psms.groupBy(p.alias("__p")).agg(F.count(F.lit(1)).alias("n"))
    n, above = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("__p") > lambda_param, F.col("n"))), F.lit(0))).first()
    share = min(max(above / (n * (1 - lambda_param)), 1 / n), 1.0) if n and method == "storey" else 1.0
    ranked = running_counts(counts, "__p").withColumn("q", F.col("__p") * share * n / F.col("upto"))
    found = suffix_min(ranked.select("__p", "q"), "__p", "q", "__q").select("__p", F.least("__q", F.lit(1.0)).alias("__q"))
    return psms.withColumn("__p", p).join(found, "__p").withColumn("q_value", F.when(F.col(column).isNotNull(), F.col("__q"))).drop("__p", "__q")


def cumulative_sensitivity(cells: DataFrame, obs: DataFrame, group: str = "group", codes: Iterable[int] = VALID, seed: str = "42") -> DataFrame:
    """(group, place, n_samples, n_union): features detected in the first samples of a group in a hashed order."""
    order = Window.partitionBy("group").orderBy(F.md5(F.concat(F.lit(seed), "sample_id")), "sample_id")
    placed = obs.select("sample_id", F.col(group).alias("group")).withColumn("place", F.row_number().over(order))
    first = cells.where(is_detected(codes)).join(placed, "sample_id").groupBy("group", "feature_id").agg(F.min("place").alias("place"))
    new = placed.join(first.groupBy("group", "place").agg(F.count(F.lit(1)).alias("new")), ["group", "place"], "left")
    run = Window.partitionBy("group").orderBy("place")
    return new.select("group", "place", F.sum(F.coalesce("new", F.lit(0))).over(run).alias("n_union"))
