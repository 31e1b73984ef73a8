"""Evaluation metrics: batch mixing, clustering, quality of layers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.neighbors import nearest
from ..storage import materialize
from .special import chi2_sf


def labelled_neighbors(rows: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(sample_id, own, label, n): labels among the k nearest samples. rows as for `nearest`, labels (sample_id, label)."""
    near = nearest(rows, k)
    of = labels.select(F.col("sample_id").alias("other"), "label")
    own = labels.select("sample_id", F.col("label").alias("own"))
    return near.join(of, "other").groupBy("sample_id", "label").agg(F.count(F.lit(1)).alias("n")).join(own, "sample_id")


def _shares(rows: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    n = F.col("n") / F.sum("n").over(Window.partitionBy("sample_id"))
    return labelled_neighbors(rows, labels, k).withColumn("p", n)


def batch_mixing(rows: DataFrame, labels: DataFrame, k: int = 30) -> DataFrame:
    """(score): mean of (1 - sum p^2) / (1 - 1/batches) over neighbourhoods."""
    b = labels.select("label").distinct().count()
    simpson = _shares(rows, labels, k).groupBy("sample_id").agg(F.sum(F.col("p") ** 2).alias("s"))
    return simpson.agg((F.avg(1 - F.col("s")) / F.lit(max(1 - 1 / max(b, 1), 1e-12))).alias("score"))


def lisi(rows: DataFrame, labels: DataFrame, k: int = 30) -> DataFrame:
    """(sample_id, lisi): the inverse Simpson index of the labels nearby."""
    return _shares(rows, labels, k).groupBy("sample_id").agg((1 / F.sum(F.col("p") ** 2)).alias("lisi"))


def kbet(rows: DataFrame, labels: DataFrame, k: int = 30, alpha: float = 0.05) -> float:
    """The share of neighbourhoods whose labels a chi-square test finds like those of all."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    kinds, total = sizes.agg(F.count(F.lit(1)), F.sum("size")).first()
    near = labelled_neighbors(rows, labels, k).join(sizes, "label")
    terms = near.groupBy("sample_id").agg(F.sum("n").alias("k"), F.sum(F.col("n") ** 2 / F.col("size")).alias("c"))
    stat = terms.select((F.col("c") * total / F.col("k") - F.col("k")).alias("x"))
    p = F.pandas_udf(_chi2(kinds - 1), "double")
    return stat.select((p("x") >= alpha).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]


def _chi2(df: int):
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: chi2_sf(float(v), df)).astype(float)

    return tail


def perplexity_weights(d: np.ndarray, perplexity: float, tol: float = 1e-5) -> np.ndarray:
    """Weights exp(-beta d) whose entropy is log(perplexity), beta found by bisection in 50 steps at most."""
    low, high, beta = 0.0, np.inf, 1.0
    p = np.full(len(d), 1 / len(d))
    for _ in range(50):
        w = np.exp(-beta * (d - d.min()))
        p = w / w.sum()
        gap = -(p * np.log(np.maximum(p, 1e-300))).sum() - np.log(perplexity)
        if abs(gap) < tol:
            break
        low, high = (beta, high) if gap > 0 else (low, beta)
        beta = beta * 2 if np.isinf(high) else (low + high) / 2
    return p


def ilisi(rows: DataFrame, labels: DataFrame, perplexity: float = 30.0) -> float:
    """The median perplexity-weighted inverse Simpson index, scaled to 0..1 over the number of labels."""
    b = labels.select("label").distinct().count()
    near = nearest(rows, int(3 * perplexity)).join(labels.select(F.col("sample_id").alias("other"), "label"), "other")

    def simpson(x: pd.DataFrame) -> pd.DataFrame:
        p = perplexity_weights(x["distance"].to_numpy(), min(perplexity, max(len(x) / 3, 1.1)))
        s = pd.Series(p).groupby(x["label"].to_numpy()).sum()
        return pd.DataFrame({"sample_id": [x["sample_id"].iloc[0]], "s": [1 / (s**2).sum()]})

    out = near.groupBy("sample_id").applyInPandas(simpson, "sample_id string, s double").agg(F.median("s")).first()[0]
    return (out - 1) / max(b - 1, 1)


def silhouette(points: DataFrame) -> DataFrame:
    """(sample_id, s) of (sample_id, label, vec) with full vectors, by squared distances.

    The mean squared distance to a cluster follows from its size, mean and mean square, so that no pairs are formed.
    """
    long = points.select("sample_id", "label", F.posexplode("vec").alias("i", "x"))
    mean = long.groupBy("label", "i").agg(F.avg("x").alias("m"), F.avg(F.col("x") ** 2).alias("q"))
    sizes = points.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    center = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda z: z["m"]).alias("center"), F.sum("q").alias("square")).join(sizes, "label")
    near = points.select("sample_id", F.col("label").alias("own"), "vec").crossJoin(center)
    dot = F.aggregate(F.zip_with("vec", "center", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    norm = F.aggregate(F.transform("vec", lambda a: a * a), F.lit(0.0), lambda s, v: s + v)
    d = norm + F.col("square") - 2 * dot
    mine = F.when((F.col("own") == F.col("label")) & (F.col("size") > 1), F.col("d") * F.col("size") / (F.col("size") - 1))
    other = F.when(F.col("own") != F.col("label"), F.col("d"))
    s = near.withColumn("d", d).groupBy("sample_id").agg(F.max(mine).alias("a"), F.min(other).alias("b"))
    return s.select("sample_id", F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)).alias("s"))


def asw(points: DataFrame, *, batch: bool) -> DataFrame:
    """(score): the mean silhouette clipped to 0..1; for batches 1 less it."""
    mean = F.avg("s")
    return silhouette(points).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - mean if batch else mean)).alias("score"))


def dispersion(points: DataFrame) -> DataFrame:
    """(n, k, within, between): sums of squares of (label, vec)."""
    long = points.select("label", F.posexplode("vec").alias("i", "x"))
    part = long.groupBy("label", "i").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    grand = F.sum(F.col("n") * F.col("m")).over(Window.partitionBy("i")) / F.sum("n").over(Window.partitionBy("i"))
    part = part.withColumn("b", F.col("n") * (F.col("m") - grand) ** 2)
    sums = part.agg(F.sum(F.col("n") * F.col("v")).alias("within"), F.sum("b").alias("between"))
    return points.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("k")).join(F.broadcast(sums))


def calinski_harabasz(points: DataFrame) -> DataFrame:
    """(score): x / (x + 100) of the variance ratio x."""
    x = (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))
    return dispersion(points).select((x / (x + 100)).alias("score"))


def davies_bouldin(points: DataFrame) -> DataFrame:
    """(score): 1 / (1 + x) of the mean over clusters of the worst ratio of spreads to centre distance."""
    long = points.select("sample_id", "label", F.posexplode("vec").alias("i", "x"))
    center = long.groupBy("label", "i").agg(F.avg("x").alias("m"))
    far = long.join(center, ["label", "i"]).groupBy("sample_id", "label").agg(F.sqrt(F.sum((F.col("x") - F.col("m")) ** 2)).alias("d"))
    spread = far.groupBy("label").agg(F.avg("d").alias("s"))
    two = center.select(F.col("label").alias("o"), "i", F.col("m").alias("w"))
    gap = center.join(two, "i").where("label <> o").groupBy("label", "o").agg(F.sqrt(F.sum((F.col("m") - F.col("w")) ** 2)).alias("gap"))
    ratio = gap.join(spread, "label").join(spread.select(F.col("label").alias("o"), F.col("s").alias("t")), "o").withColumn("r", (F.col("s") + F.col("t")) / F.col("gap"))
    return ratio.groupBy("label").agg(F.max("r").alias("r")).agg((1 / (1 + F.avg("r"))).alias("score"))


def adjusted_rand(pairs: DataFrame) -> DataFrame:
    """(ari) of two labellings (a, b) of the same samples."""
    two = lambda c: c * (c - 1) / 2
    cell = pairs.groupBy("a", "b").count().agg(F.sum(two(F.col("count"))).alias("ij"), F.sum("count").alias("n"))
    side = lambda c: pairs.groupBy(c).count().agg(F.sum(two(F.col("count"))).alias(f"s{c}"))
    x = cell.join(F.broadcast(side("a"))).join(F.broadcast(side("b")))
    e = F.col("sa") * F.col("sb") / two(F.col("n"))
    top = (F.col("sa") + F.col("sb")) / 2 - e
    return x.select(F.when(top == 0, 1.0).otherwise((F.col("ij") - e) / F.when(top != 0, top)).alias("ari"))


def knn_purity(rows: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """(score): the mean share of a sample's k nearest that have its own label."""
    near = labelled_neighbors(rows, labels, k)
    return near.groupBy("sample_id").agg((F.sum(F.when(F.col("label") == F.col("own"), F.col("n")).otherwise(0)) / F.sum("n")).alias("p")).agg(F.avg("p").alias("score"))


def knn_jaccard(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """(sample_id, jaccard) of the k nearest in two spaces, both (sample_id, names, vec)."""
    one, two = (nearest(rows, k).select("sample_id", "other", F.lit(1).alias(name)) for rows, name in ((a, "x"), (b, "y")))
    both = one.join(two, ["sample_id", "other"], "full_outer")
    return both.groupBy("sample_id").agg((F.count_if((F.col("x") == 1) & (F.col("y") == 1)) / F.count(F.lit(1))).alias("jaccard"))


def distance_agreement(a: DataFrame, b: DataFrame, k: int = 30) -> DataFrame:
    """(r): the rank correlation, within each sample's k nearest in the first space, of distances in both, on average."""
    near = nearest(a, k).select("sample_id", "other", F.col("distance").alias("d"))
    left = b.select("sample_id", F.col("vec").alias("p"))
    right = b.select(F.col("sample_id").alias("other"), F.col("vec").alias("q"))
    gap = F.sqrt(F.aggregate(F.zip_with("p", "q", lambda x, y: (x - y) ** 2), F.lit(0.0), lambda s, v: s + v))
    x = near.join(left, "sample_id").join(right, "other").withColumn("e", gap)
    order = lambda c: F.rank().over(Window.partitionBy("sample_id").orderBy(c)).cast("double")
    return x.withColumns({"rd": order("d"), "re": order("e")}).groupBy("sample_id").agg(F.corr("rd", "re").alias("r")).agg(F.avg("r").alias("r"))


def sampled_pairs(rows: DataFrame, pairs: int = 1000, samples: int = 1000, seed: int = 42) -> DataFrame:
    """(a, b): seeded pairs of samples: those of the least hashes in a ring, each with ones at hashed offsets. No pair is formed in vain."""
    first = rows.select("sample_id").orderBy(F.xxhash64("sample_id", F.lit(seed)), "sample_id").limit(samples)
    ids = [r[0] for r in first.collect()]  # at most `samples`
    n = len(ids)
    draw = np.random.default_rng(seed)
    rounds = -(-min(pairs, n * (n - 1) // 2) // max(n, 1))
    offsets = draw.permutation(np.arange(1, n // 2 + 1))[:rounds] if n > 1 else []
    found = sorted({tuple(sorted((i, (i + int(o)) % n))) for o in offsets for i in range(n)})[: min(pairs, n * (n - 1) // 2)]
    return rows.sparkSession.createDataFrame([(ids[i], ids[j]) for i, j in found], "a string, b string")


def pair_distances(rows: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """(a, b, name): the root of the summed squares over features that both samples of (sample_id, names, vec) have."""
    long = lambda side, x: rows.select(F.col("sample_id").alias(side), F.explode(F.arrays_zip("names", "vec")).alias("c")).select(side, F.col("c.names").alias("f"), F.col("c.vec").alias(x))
    met = pairs.join(long("a", "x"), "a").join(long("b", "y"), ["b", "f"])
    return met.groupBy("a", "b").agg(F.sqrt(F.sum((F.col("x") - F.col("y")) ** 2)).alias(name))


def pair_agreement(a: DataFrame, b: DataFrame, pairs: int = 1000, samples: int = 1000, seed: int = 42) -> float:
    """(1 + r) / 2 of the distances of sampled pairs in two spaces; 0 for fewer than ten samples or without spread."""
    drawn = materialize(sampled_pairs(a, pairs, samples, seed))
    both = pair_distances(a, drawn, "d").join(pair_distances(b, drawn, "e"), ["a", "b"])
    n, r, sd, se = both.agg(F.count(F.lit(1)), F.corr("d", "e"), F.stddev_pop("d"), F.stddev_pop("e")).first()
    if a.limit(10).count() < 10 or not n or min(sd, se) < 1e-10 or r is None:
        return 0.0
    return float(np.clip((1 + r) / 2, 0, 1))


def clustering_stability(points: DataFrame, cluster: Callable[[DataFrame], DataFrame], *, subsamples: int = 10, share: float = 0.8, seed: int = 42) -> float:
    """The mean adjusted Rand index, 0 at least, of (sample_id, label, vec) against clusterings of hashed shares of the samples."""
    found = []
    for i in range(subsamples):
        hit = F.pmod(F.xxhash64("sample_id", F.lit(seed + i)), F.lit(1000)) < int(share * 1000)
        new = cluster(points.where(hit).select("sample_id", "vec")).withColumnRenamed("label", "b")
        found.append(adjusted_rand(new.join(points.select("sample_id", F.col("label").alias("a")), "sample_id")).first()[0])
    return max(0.0, float(np.mean([x for x in found if x is not None] or [0.0])))


def layer_quality(cells: DataFrame) -> DataFrame:
    """(skewness, kurtosis, dynamic_range, outlier_ratio): population moments, log10 of max by min, share outside 1.5 IQR by feature."""
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).over(Window.partitionBy("feature_id"))
    low, high = F.element_at("q", 1), F.element_at("q", 2)
    out = (F.col("value") < low - 1.5 * (high - low)) | (F.col("value") > high + 1.5 * (high - low))
    x = cells.where("value is not null").withColumn("q", q).withColumn("out", out)
    positive = F.when(F.col("value") > 0, F.col("value"))
    return x.agg(F.skewness("value").alias("skewness"), F.kurtosis("value").alias("kurtosis"), (F.log10(F.max(positive)) - F.log10(F.min(positive))).alias("dynamic_range"), F.avg(F.col("out").cast("int")).alias("outlier_ratio"))


def improvement(before: float, after: float) -> float:
    """How much nearer to 0 a moment came, 0 to 1."""
    return 0.0 if abs(before) < 1e-12 else float(np.clip(1 - abs(after) / abs(before), 0, 1))


def range_score(x: float, target: float = 6.0, spread: float = 3.0) -> float:
    return float(np.exp(-(((x - target) / spread) ** 2)))


def cv_stability(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(score): exp(-mean over groups of the median feature CV)."""
    x = cells.join(groups, "sample_id").groupBy("group", "feature_id").agg((F.stddev_pop("value") / F.when(F.abs(F.avg("value")) > 1e-12, F.avg("value"))).alias("cv"))
    return x.groupBy("group").agg(F.median(F.abs("cv")).alias("cv")).agg(F.exp(-F.avg("cv")).alias("score"))
