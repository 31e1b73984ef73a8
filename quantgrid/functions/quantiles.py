"""Exact quantiles and ranks over all rows of a column, without bringing the rows into one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize, once

BUCKETS = 2048
SMALL = 20_000


def order_statistic(df: DataFrame, column: str, place: int) -> float:
    """The value at a place (from 0) in the ascending order of a column without nulls.

    Counts of value ranges narrow the place down until at most SMALL distinct values are left.
    """
    x = F.col(column)
    low, high, n = df.agg(F.min(x), F.max(x), F.count(x)).first()
    part, left = df.select(x.alias("x")), place
    while n > SMALL and low < high:
        width = (high - low) / BUCKETS
        bucket = F.least(F.floor((F.col("x") - low) / width), F.lit(BUCKETS - 1)).alias("b")
        rows = part.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("b").collect()
        for r in rows:
            if left < r["n"]:
                break
            left -= r["n"]
        if (r["low"], r["high"]) == (low, high):  # no range is narrower than this one
            break
        low, high, n = r["low"], r["high"], r["n"]
        part = part.where((F.col("x") >= low) & (F.col("x") <= high))
    for r in part.groupBy("x").count().orderBy("x").collect():
        if left < r["count"]:
            return r["x"]
        left -= r["count"]
    raise IndexError(place)


def quantiles(df: DataFrame, column: str, probabilities: list[float]) -> list[float | None]:
    """Linearly interpolated quantiles of the values that aren't null; None where there are none."""
    part = once(df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x")))
    n = part.count()
    if not n:
        return [None] * len(probabilities)
    out = []
    for p in probabilities:
        at = (n - 1) * p
        low = order_statistic(part, "x", math.floor(at))
        high = low if at == math.floor(at) else order_statistic(part, "x", math.ceil(at))
        out.append(low + (high - low) * (at - math.floor(at)))
    return out


def running_counts(values: DataFrame, order: str, count: str = "n") -> DataFrame:
    """Add `upto`: the sum of `count` over all rows up to each one in the order of a column of distinct values.

    Rows are dealt by ranges of the column; only one sum a range meets in one task. They are dealt once for both readers:
    ranges found by another sample, or sums added up in another order, wouldn't meet.
    """
    placed = materialize(values.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    inside = F.sum(count).over(Window.partitionBy("__part").orderBy(order))
    sums = placed.groupBy("__part").agg(F.sum(count).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = sums.select("__part", before.alias("__before"))
    return placed.withColumn("__inside", inside).join(ahead, "__part").withColumn("upto", F.col("__inside") + F.col("__before")).drop("__part", "__inside", "__before")


def suffix_min(values: DataFrame, order: str, column: str, out: str) -> DataFrame:
    """Add the least value of a column over each row and all after it in the order of another one."""
    placed = materialize(values.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    after = Window.orderBy("__part").rowsBetween(1, Window.unboundedFollowing)
    ahead = placed.groupBy("__part").agg(F.min(column).alias("__min")).select("__part", F.min("__min").over(after).alias("__later"))
    inside = F.min(column).over(Window.partitionBy("__part").orderBy(order).rowsBetween(0, Window.unboundedFollowing))
    return placed.withColumn("__inside", inside).join(ahead, "__part").withColumn(out, F.least("__inside", "__later")).drop("__part", "__inside", "__later")
