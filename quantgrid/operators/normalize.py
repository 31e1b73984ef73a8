"""Normalization, standardization and log transformation of layers."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions.quantiles import quantiles
from ..model import Dataset
from .matrix import beside

LOGGED = re.compile(r"(^|[_\-])(log|log2|log10|ln)([_\-]|$)")


def norm_none(cells: DataFrame) -> DataFrame:
    return cells


def norm_median(cells: DataFrame, *, add_global_median: bool = False) -> DataFrame:
    """Subtract each sample's median; then add the median of all cells, if asked."""
    add = (quantiles(cells, "value", [0.5])[0] or 0.0) if add_global_median else 0.0
    return beside(cells, "sample_id", __m=F.median("value")).withColumn("value", F.col("value") - F.col("__m") + F.lit(add)).select(*cells.columns)


def norm_mean(cells: DataFrame, *, add_global_mean: bool = False) -> DataFrame:
    add = (cells.agg(F.avg("value")).first()[0] or 0.0) if add_global_mean else 0.0
    return beside(cells, "sample_id", __m=F.avg("value")).withColumn("value", F.col("value") - F.col("__m") + F.lit(add)).select(*cells.columns)


def norm_quantile(cells: DataFrame, *, by: str = "sample_id") -> DataFrame:
    """Quantile normalization of samples (or of features, by="feature_id").

    The reference at place r is the mean of the r-th smallest values of the samples that have so many. A value takes the
    reference at its place; equal values take that at their mean place, between two entries if need be.
    """
    refused = F.raise_error(F.lit("infinite values can't be quantile-normalized")).cast("double")
    x = F.when(F.abs("value") == float("inf"), refused).otherwise(F.col("value"))
    order = Window.partitionBy(by).orderBy("value")
    ties = F.count(F.lit(1)).over(order.rangeBetween(0, 0))
    # One sort: places of their own for the reference, and the mean place of equal values.
    some = cells.where("value is not null").withColumns({"value": x}).withColumns({"place": F.row_number().over(order) - 1, "at": F.rank().over(order) - 1 + (ties - 1) / 2})
    level = some.groupBy("place").agg(F.avg("value").alias("level"))
    near = level.select(F.explode(F.array(F.struct(F.col("place").alias("low"), F.col("level").alias("mine"), F.lit(None).cast("double").alias("next")), F.struct((F.col("place") - 1).alias("low"), F.lit(None).cast("double").alias("mine"), F.col("level").alias("next")))).alias("x"))
    near = near.groupBy("x.low").agg(F.max("x.mine").alias("mine"), F.max("x.next").alias("next"))
    done = some.withColumn("low", F.floor("at").cast("int")).join(near, "low")
    value = F.col("mine") + F.when(F.col("at") > F.col("low"), (F.col("at") - F.col("low")) * (F.col("next") - F.col("mine"))).otherwise(F.lit(0.0))
    return done.withColumn("value", value).select(*cells.columns).unionByName(cells.where("value is null"))


def rank_invariance(cells: DataFrame) -> DataFrame:
    """(feature_id, frequency): how often a feature has its most common rank, among its values."""
    rank = F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("value"), "feature_id"))
    counts = cells.where("value is not null").withColumn("rank", rank).groupBy("feature_id", "rank").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("feature_id").agg((F.max("n") / F.sum("n")).alias("frequency"))


def norm_trqn(cells: DataFrame, *, low_thr: float = 0.5, balance_stat: str = "median", features: DataFrame | None = None) -> DataFrame:
    """Tail-robust quantile normalization.

    All cells are quantile-normalized. Rank-invariant features (or those given) are normalized anew among themselves, less their
    own median or mean, which is then added back.
    """
    if not 0 < low_thr <= 1 or balance_stat not in ("median", "mean"):
        raise ValidationError("low_thr is in (0, 1], balance_stat median or mean")
    plain = norm_quantile(cells)
    chosen = (rank_invariance(plain).where(F.col("frequency") >= low_thr) if features is None else features).select("feature_id").distinct()
    stat = F.median if balance_stat == "median" else F.avg
    subset = beside(cells.join(chosen, "feature_id", "left_semi"), "feature_id", __level=stat("value"))
    level = subset.select("sample_id", "feature_id", "__level")
    balanced = norm_quantile(subset.withColumn("value", F.col("value") - F.col("__level")).drop("__level"))
    balanced = balanced.join(level, ["sample_id", "feature_id"]).withColumn("value", F.col("value") + F.col("__level")).drop("__level")
    return plain.join(chosen, "feature_id", "left_anti").select(*cells.columns).unionByName(balanced.select(*cells.columns))


NORMALIZERS = {"none": norm_none, "median": norm_median, "mean": norm_mean, "quantile": norm_quantile, "trqn": norm_trqn}
LAYER_NAMES = {"none": "no_norm", "median": "median_centered", "mean": "mean_centered", "quantile": "quantile_norm", "trqn": "trqn_norm"}


def normalize(ds: Dataset, method: str, *, assay: str = "protein", source_layer: str = "raw", new_layer: str | None = None, **params) -> Dataset:
    name = method.removeprefix("norm_")
    if name not in NORMALIZERS:
        raise ValidationError(f"method is one of {sorted(NORMALIZERS)}, not {method!r}")
    return ds.apply(assay, source_layer, new_layer or LAYER_NAMES[name], NORMALIZERS[name], **params)


def zscore(cells: DataFrame, *, axis: int = 0, ddof: int = 1) -> DataFrame:
    """(x - mean) / deviation per feature (axis 0) or sample (axis 1); a deviation of 0 counts as 1. Needs complete cells."""
    key = "feature_id" if axis == 0 else "sample_id"
    if cells.where("value is null").limit(1).count():
        raise ValidationError("zscore needs cells without missing values")
    if cells.groupBy(key).count().where(F.col("count") <= ddof).limit(1).count():
        raise ValidationError("too few values for this ddof")
    sd = F.stddev_samp("value") if ddof == 1 else F.stddev_pop("value")
    rows = beside(cells, key, __mean=F.avg("value"), __sd=sd)
    return rows.withColumn("value", (F.col("value") - F.col("__mean")) / F.when(F.col("__sd") == 0, 1.0).otherwise(F.col("__sd"))).select(*cells.columns)


def robust_scale(cells: DataFrame, *, axis: int = 0, center: bool = True, scale: bool = True) -> DataFrame:
    """(x - median) / interquartile range per feature (axis 0) or sample; a range of 0 counts as 1."""
    out = beside(cells, "feature_id" if axis == 0 else "sample_id", __q=F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))
    span = F.element_at("__q", 3) - F.element_at("__q", 1)
    value = F.col("value") - (F.element_at("__q", 2) if center else F.lit(0.0))
    value = value / F.when(span == 0, 1.0).otherwise(span) if scale else value
    return out.withColumn("value", value).select(*cells.columns)


def log_transform(cells: DataFrame, *, base: float = 2.0, offset: float = 1.0) -> DataFrame:
    """log(max(x, 0) + offset); without an offset every value must be positive."""
    if base <= 0 or base == 1 or offset < 0:
        raise ValidationError("base must be positive and not 1, offset not negative")
    if offset == 0 and cells.where("value <= 0").limit(1).count():
        raise ValidationError("values must be positive without an offset")
    return cells.withColumn("value", F.log(F.greatest(F.col("value"), F.when(F.col("value").isNotNull(), 0.0)) + offset) / math.log(base))


def log1p_scaled(cells: DataFrame, *, offset: float = 1.0, scale: float = 1.0) -> DataFrame:
    return cells.withColumn("value", F.log(F.col("value") + offset) / scale)


def looks_logged(cells: DataFrame) -> bool:
    """Whether the values' distribution is that of logs; False for fewer than 50 values."""
    x = F.col("value")
    n, negative, below, above = cells.agg(F.count(x), F.avg((x < 0).cast("int")), F.avg((x <= 100).cast("int")), F.avg((x > 1000).cast("int"))).first()
    if n < 50:
        return False
    q01, q50, q95, q99 = quantiles(cells, "value", [0.01, 0.5, 0.95, 0.99])
    centered = negative > 0.05 and q99 <= 80
    compressed = q99 <= 80 and q95 <= 60 and q99 - q01 <= 40 and below >= 0.99
    return centered or compressed or (q99 <= 40 and q50 <= 20 and above < 0.001)


def log_dataset(ds: Dataset, *, assay: str = "protein", source_layer: str = "raw", new_layer: str = "log", base: float = 2.0, offset: float = 1.0, skip_if_logged: bool = True, by_distribution: bool = False) -> Dataset:
    """Add a log layer. A layer that is logged by its name, its history or, if asked, its values is passed on as it is."""
    made = any(r.action in ("log_transform", "log_transform_skipped") and r.params.get("new_layer") == source_layer and r.params.get("assay") == ds.resolve(assay) for r in ds.history)
    cells = ds.layer(assay, source_layer)
    if skip_if_logged and (LOGGED.search(source_layer.lower()) or made or (by_distribution and looks_logged(cells))):
        return ds.with_layer(assay, new_layer, cells, "log_transform_skipped", source_layer=source_layer)
    return ds.with_layer(assay, new_layer, log_transform(cells, base=base, offset=offset), "log_transform", source_layer=source_layer, base=base, offset=offset)
