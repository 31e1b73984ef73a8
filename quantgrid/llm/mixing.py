"""Mixing sources to target weights by capped water-filling, then seeded whole and fractional repetitions.

A source's target is min(max_epochs * its size, level * its weight), with the level at which all targets sum to the share.
A source repeats all its documents whole while that fits; the rest is filled along a hashed order of its documents. That
order is never sorted as a whole: sums over two levels of hash prefixes find the leaf in which the rest runs out, and only
the few documents of this leaf are ordered one by one. So no task holds a source, however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Plans of at most so many sources are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 20_000
PREFIX = 3  # hex digits of a level
MINE = ("size", "source_size", "target", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_key(doc_id: Column, text: Column, seed: str) -> Column:
    """Of the id; of the text where the id is null, so that such rows are spread too."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), text, F.lit(""))))


def water_fill(sources: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> DataFrame:
    """Add `target` to (source, source_size); weights repeat over the sources by code point, null last.

    One row a source goes through one task here; documents never do.
    """
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("n") - 1) % len(weights) + 1)
    ranked = sources.withColumn("n", F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))).withColumn("weight", weight)
    before = Window.orderBy(F.col("source_size") / F.col("weight"), "n").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * max_epochs
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = ranked.withColumns({"left": left, "open_weight": open_weight})
    fits = F.col("left") * F.col("weight") <= F.col("source_size") * max_epochs * F.col("open_weight")
    first = F.min(F.when(fits, F.struct(F.col("source_size") / F.col("weight"), "n", (F.col("left") / F.col("open_weight")).alias("level")))).over(whole)
    cap = (F.col("source_size") * max_epochs).cast("double")
    return levels.select("source", "source_size", F.coalesce(F.least(cap, first["level"] * F.col("weight")), cap).alias("target"))


def _boundary(sums: DataFrame, plan: DataFrame, prefix: str, level: int) -> DataFrame:
    """Add to plan the hash prefix in which the rest of each source runs out, and the words before it."""
    before = Window.partitionBy("source").orderBy(prefix).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - (F.col("before1") if level == 2 else F.lit(0))
    at = sums.withColumn("done", F.coalesce(F.sum("words").over(before), F.lit(0)))
    need = plan.select(F.col("source").alias("of"), left.alias("left"))
    met = at.join(need, F.col("source").eqNullSafe(F.col("of"))).where("done < left and done + words >= left")
    met = met.select("of", F.col(prefix).alias(f"cut{level}"), "done")
    joined = plan.join(met, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    return joined.withColumn(f"before{level}", F.coalesce("done", F.lit(0)) + (F.col("before1") if level == 2 else 0)).drop("done")


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "", names: tuple[str, str, str, str] = MINE) -> DataFrame:
    """Add size, source_size, target and taken (words that the mix takes of this row, repeats counted) to each row.

    Each source's taken words are its target, rounded down. A null text has size 0, a null source is a source of its own,
    last in order. Rows of a null id are ordered by their texts; equal rows are interchangeable. `names` are those of the four
    columns; columns of the same names are replaced.
    """
    docs = docs.drop(*names)
    key = hash_key(F.col(doc_id), F.col(text), seed)
    slim = materialize(
        docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("words"), key.alias("key"))
        .select("source", F.substring("key", 1, PREFIX).alias("p1"), F.substring("key", 1 + PREFIX, PREFIX).alias("p2"), "words")
        .groupBy("source", "p1", "p2")
        .agg(F.sum("words").alias("words"))
    )
    level1 = slim.groupBy("source", "p1").agg(F.sum("words").alias("words"))
    sizes = level1.groupBy("source").agg(F.sum("words").alias("source_size"))
    repeats = F.coalesce(F.floor(F.try_divide("target", F.col("source_size"))), F.lit(0)).cast("long")
    plan = water_fill(sizes, weights, share, max_epochs).withColumn("repeats", F.least(repeats, F.lit(max_epochs)))
    plan = plan.withColumn("rest", F.floor("target") - F.col("repeats") * F.col("source_size"))
    plan = materialize(_boundary(level1, plan, "p1", 1))
    cut = slim.join(plan.select(F.col("source").alias("of"), "cut1"), F.col("source").eqNullSafe(F.col("of")) & (F.col("p1") == F.col("cut1"))).select("source", "p2", "words")
    plan = materialize(_boundary(cut, plan, "p2", 2))
    small = plan.select(*(F.col(c).alias(f"__{c}") for c in plan.columns))
    if plan.count() <= BROADCAST_SOURCES:
        small = F.broadcast(small)
    rows = docs.withColumns({"__size": word_count(F.col(text)), "__key": key})
    rows = rows.join(small, F.col(source).eqNullSafe(F.col("__source")))
    p1, p2 = F.substring("__key", 1, PREFIX), F.substring("__key", 1 + PREFIX, PREFIX)
    cut1, cut2 = F.col("__cut1"), F.col("__cut2")
    whole = F.when(cut1.isNull(), False).otherwise((p1 < cut1) | ((p1 == cut1) & F.coalesce(p2 < cut2, F.lit(False))))
    in_leaf = F.coalesce((p1 == cut1) & (p2 == cut2), F.lit(False))
    before = Window.partitionBy("__source").orderBy("__key", doc_id, "__size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("__rest") - F.col("__before2") - F.coalesce(F.sum("__size").over(before), F.lit(0))
    plain = rows.where(~in_leaf).withColumn("__extra", F.when(whole, F.col("__size")).otherwise(F.lit(0)))
    leaf = rows.where(in_leaf).withColumn("__extra", F.greatest(F.lit(0), F.least("__size", left)))
    taken = (F.col("__repeats") * F.col("__size") + F.col("__extra")).cast("long")
    values = F.col("__size"), F.col("__source_size"), F.col("__target"), taken
    return plain.unionByName(leaf).select(*docs.columns, *(v.alias(n) for v, n in zip(values, names)))


def repeat_rows(mixed: DataFrame, names: tuple[str, str, str, str] = MINE) -> DataFrame:
    """Each row of mix_sources as often as the mix takes it; a row taken in part appears whole. Rows of no words go."""
    size, taken = names[0], names[3]
    times = F.ceil(F.try_divide(taken, F.col(size))).cast("int")
    return mixed.where(F.col(taken) > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), times))).drop("__copy", *names)
