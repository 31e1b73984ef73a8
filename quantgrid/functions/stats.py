"""Statistics between features, samples and vectors; axis reductions that give 0 where nothing is left."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .special import norm_cdf, student_sf


def axis_stats(cells: DataFrame, axis: str, suffix: str = "") -> DataFrame:
    """(axis, total, mean, variance) over values that are there; 0 where there are none."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return cells.groupBy(axis).agg(zero(F.sum("value")).alias(f"total{suffix}"), zero(F.avg("value")).alias(f"mean{suffix}"), zero(F.var_samp("value")).alias(f"variance{suffix}"))


def scale_by(cells: DataFrame, factors: DataFrame, axis: str) -> DataFrame:
    """Multiply by a factor of each sample or feature: factors is (axis, factor); others stay."""
    return cells.join(factors, axis, "left").withColumn("value", F.col("value") * F.coalesce("factor", F.lit(1.0))).drop("factor")


def average_rank(column: str, by: str) -> Column:
    """Ranks from 1 within groups; equal values share their mean rank."""
    w = Window.partitionBy(by).orderBy(column)
    ties = Window.partitionBy(by, column)
    return F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2


def paired(cells: DataFrame, item: str, by: str) -> DataFrame:
    """(a, b, x, y): values of each pair of items a < b at the same key."""
    left = cells.where("value is not null").select(F.col(item).alias("a"), F.col(by).alias("key"), F.col("value").alias("x"))
    right = left.select(F.col("a").alias("b"), "key", F.col("x").alias("y"))
    return left.join(right, "key").where("a < b")


def correlation_pairs(cells: DataFrame, item: str = "feature_id", method: str = "pearson") -> DataFrame:
    """(a, b, r) of each pair of items over shared keys; 0 where one is constant. Meant for few items, such as proteins."""
    by = "sample_id" if item == "feature_id" else "feature_id"
    if method == "spearman":
        cells = cells.where("value is not null").withColumn("value", average_rank("value", item))
    pairs = paired(cells, item, by).groupBy("a", "b").agg(F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"), F.covar_pop("x", "y").alias("c"))
    r = F.coalesce(F.try_divide("c", F.col("sx") * F.col("sy")), F.lit(0.0))
    return pairs.select("a", "b", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)).alias("r"))


def partial_correlation(cells: DataFrame, a: str, b: str, given: list[str]) -> float:
    """Of two features given others, from the precision matrix of their covariances; a singular one is lifted a little."""
    names = [a, b, *given]
    some = cells.where(F.col("feature_id").isin(names))
    full = paired(some, "feature_id", "sample_id").groupBy("a", "b").agg(F.covar_samp("x", "y").alias("c"))
    var = some.groupBy("feature_id").agg(F.var_samp("value").alias("c"))
    s = np.zeros((len(names), len(names)))
    at = {n: i for i, n in enumerate(names)}
    for r in full.collect():
        s[at[r["a"]], at[r["b"]]] = s[at[r["b"]], at[r["a"]]] = r["c"]
    for r in var.collect():
        s[at[r["feature_id"]], at[r["feature_id"]]] = r["c"]
    try:
        p = np.linalg.inv(s)
    except np.linalg.LinAlgError:
        p = np.linalg.inv(s + 1e-8 * np.eye(len(names)))
    return float(-p[0, 1] / np.sqrt(p[0, 0] * p[1, 1]))


def cosine(a: Column, b: Column) -> Column:
    """Of two array columns; 0 if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


def distance(a: Column, b: Column) -> Column:
    """Root mean square over positions where both have values; infinite where there are none."""
    d = F.filter(F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double")) ** 2), lambda v: v.isNotNull())
    total = F.aggregate(d, F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.sqrt(F.try_divide(total, F.size(d))), F.lit(float("inf")))


def welch_tests(cells: DataFrame, groups: DataFrame, a: str, b: str) -> DataFrame:
    """(feature_id, t, df, p) between the samples of two groups; groups is (sample_id, group)."""
    m = cells.join(groups, "sample_id").groupBy("feature_id").agg(
        *(f.alias(n) for g, s in ((a, "a"), (b, "b")) for f, n in ((F.count(F.when(F.col("group") == g, F.col("value"))), f"n{s}"), (F.avg(F.when(F.col("group") == g, F.col("value"))), f"m{s}"), (F.var_samp(F.when(F.col("group") == g, F.col("value"))), f"v{s}")))
    )
    ea, eb = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    m = m.where("na > 1 and nb > 1").withColumns({"t": F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(ea + eb)), "df": F.try_divide((ea + eb) ** 2, ea**2 / (F.col("na") - 1) + eb**2 / (F.col("nb") - 1))})
    p = F.pandas_udf(_welch_p, "double")
    return m.select("feature_id", "t", "df", p("t", "df").alias("p"))


def _welch_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or x != x else student_sf(float(x), float(d)) for x, d in zip(t, df)], dtype="float64")


def rank_sum_tests(cells: DataFrame, groups: DataFrame, a: str, b: str) -> DataFrame:
    """(feature_id, u, p) of the Mann-Whitney test between two groups, with the normal approximation."""
    some = cells.join(groups, "sample_id").where(F.col("group").isin(a, b) & F.col("value").isNotNull())
    ranked = some.withColumn("rank", average_rank("value", "feature_id"))
    m = ranked.groupBy("feature_id").agg(F.count_if(F.col("group") == a).alias("na"), F.count_if(F.col("group") == b).alias("nb"), F.sum(F.when(F.col("group") == a, F.col("rank"))).alias("ra"))
    m = m.where("na > 0 and nb > 0").withColumn("u", F.col("ra") - F.col("na") * (F.col("na") + 1) / 2)
    z = (F.col("u") - F.col("na") * F.col("nb") / 2) / F.sqrt(F.col("na") * F.col("nb") * (F.col("na") + F.col("nb") + 1) / 12)
    return m.select("feature_id", "u", F.pandas_udf(_normal_p, "double")(z).alias("p"))


def _normal_p(z: pd.Series) -> pd.Series:
    return z.map(lambda x: 2 * norm_cdf(-abs(float(x)))).astype(float)
