"""Masks: predicates on states, marking and combining cells, and summaries of states."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..model import MaskCode

CODES = {c.name.lower(): int(c) for c in MaskCode}


def is_valid() -> Column:
    return F.col("mask") == int(MaskCode.VALID)


def is_missing(*codes: int) -> Column:
    """Cells that aren't valid, or those of given codes."""
    return F.col("mask").isin([int(c) for c in codes]) if codes else F.col("mask") != int(MaskCode.VALID)


def is_detected(codes: Iterable[int] = (MaskCode.VALID,)) -> Column:
    codes = [int(c) for c in codes]
    if not codes:
        raise ValidationError("no mask code counts as detected")
    return F.col("value").isNotNull() & F.col("mask").isin(codes)


def filter_by_mask(cells: DataFrame, keep: Iterable[int] = (MaskCode.VALID,)) -> DataFrame:
    """Cells of other codes lose their value and become FILTERED."""
    kept = F.col("mask").isin([int(c) for c in keep])
    return cells.withColumns({"value": F.when(kept, F.col("value")), "mask": F.when(kept, F.col("mask")).otherwise(int(MaskCode.FILTERED))})


def apply_mask(cells: DataFrame, op: str = "null") -> DataFrame:
    """Values of cells that aren't valid become 0 or null, or are kept."""
    if op not in ("zero", "null", "keep"):
        raise ValidationError(f"op is zero, null or keep, not {op!r}")
    other = {"zero": F.lit(0.0), "null": F.lit(None).cast("double"), "keep": F.col("value")}[op]
    return cells.withColumn("value", F.when(is_valid(), F.col("value")).otherwise(other))


def mark(cells: DataFrame, places: DataFrame, code: int) -> DataFrame:
    """Set the code at the (sample_id, feature_id) of places; places that aren't cells are ignored."""
    marked = places.select("sample_id", "feature_id").distinct().withColumn("__hit", F.lit(True))
    out = cells.join(marked, ["sample_id", "feature_id"], "left")
    return out.withColumn("mask", F.when(F.col("__hit"), F.lit(int(code))).otherwise(F.col("mask"))).drop("__hit")


def combine_masks(masks: list[DataFrame], how: str = "union") -> DataFrame:
    """(sample_id, feature_id, flag): a cell is flagged in any, all or more than half of the layers."""
    need = {"union": 1, "intersection": len(masks), "majority": len(masks) // 2 + 1}
    if how not in need:
        raise ValidationError(f"how is one of {sorted(need)}, not {how!r}")
    flags = [m.select("sample_id", "feature_id", is_missing().cast("int").alias("flag")) for m in masks]
    return reduce(DataFrame.unionByName, flags).groupBy("sample_id", "feature_id").agg((F.sum("flag") >= need[how]).alias("flag"))


def threshold_mask(cells: DataFrame, threshold: float, compare: str = ">") -> DataFrame:
    """Add `hit`; null values never hit."""
    x = F.col("value")
    test = {"<": x < threshold, "<=": x <= threshold, ">": x > threshold, ">=": x >= threshold}[compare]
    return cells.withColumn("hit", F.coalesce(test, F.lit(False)))


def count_above(cells: DataFrame, threshold: float, axis: str = "feature_id") -> DataFrame:
    return cells.groupBy(axis).agg(F.count_if(F.col("value") > threshold).alias("n_above"))


def keep_by_count(cells: DataFrame, threshold: float, least: int, axis: str = "feature_id") -> DataFrame:
    """Cells of the features (or samples) with at least `least` values above a threshold."""
    return cells.join(count_above(cells, threshold, axis).where(F.col("n_above") >= least), axis, "left_semi")


def mask_statistics(cells: DataFrame) -> DataFrame:
    """(mask, n, percent), a row for each code."""
    spark = cells.sparkSession
    codes = spark.range(7).select(F.col("id").cast("int").alias("mask"))
    n = cells.groupBy(F.col("mask").cast("int").alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    out = codes.join(n, "mask", "left").join(F.broadcast(total))
    return out.select("mask", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce(F.try_divide(F.col("n") * 100.0, "total"), F.lit(0.0)).alias("percent"))


def state_metrics(cells: DataFrame, *by: str) -> DataFrame:
    """Counts and rates of each state; direct: valid; supported: valid or matched; uncertainty: filtered, outlier, imputed, uncertain."""
    counts = [F.count_if(F.col("mask") == c).alias(f"n_{n}") for n, c in CODES.items()]
    n = F.col("n_cells")
    out = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("n_cells"), *counts)
    rate = lambda *names: F.coalesce(F.try_divide(sum((F.col(f"n_{x}") for x in names), F.lit(0)), n), F.lit(0.0))
    rates = {f"{x}_rate": rate(x) for x in CODES}
    return out.withColumns(rates | {"direct_rate": rate("valid"), "supported_rate": rate("valid", "mbr"), "uncertainty_burden": rate("filtered", "outlier", "imputed", "uncertain")})


def state_transition(cells: DataFrame, reference: DataFrame) -> DataFrame:
    """One row: the rates of a layer, those of a reference layer (reference_*) and the differences (delta_*)."""
    names = ["direct_rate", "supported_rate", "uncertainty_burden", *(f"{x}_rate" for x in CODES)]
    now = state_metrics(cells).select(*names)
    then = state_metrics(reference).select(*(F.col(x).alias(f"reference_{x}") for x in names))
    return now.join(F.broadcast(then)).withColumns({f"delta_{x}": F.col(x) - F.col(f"reference_{x}") for x in names})
