"""Scanorama: batches joined into panoramas, those that match best first, by shifts towards mutual neighbours.

Samples stay distributed; the driver holds names and sizes of batches and the shares of matched samples of each pair of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..model import CELL
from ..storage import materialize, once
from .matrix import cosine_normalized, row_arrays
from .neighbors import mutual_between, nearest
from .reduce import pca

MAX_BATCHES = 1000
GROUP = 512  # samples whose nearest matched samples' shifts meet in a task


def match_shares(matches: DataFrame, sizes: dict[str, int]) -> list[tuple[float, str, str]]:
    """(score, batch, batch) of all pairs of batches with matches (a, b, here, there), best first, ties by name.

    The score is the larger of the two shares of samples that have a match in the other batch.
    """
    seen = matches.groupBy("here", "there").agg(F.count_distinct("a").alias("n")).collect()
    share = {(r["here"], r["there"]): r["n"] / sizes[r["here"]] for r in seen}
    return sorted(((max(v, share[y, x]), x, y) for (x, y), v in share.items() if x < y), key=lambda r: (-r[0], r[1], r[2]))


def groups_of(samples: int, size: int) -> int:
    return max(1, -(-samples // size))


def weighted_means(rows: pa.Table) -> pa.Table:
    """(sample_id, bias): the weighted mean of the shifts (all of one length) of each sample of (sample_id, w, shift)."""
    coded = rows["sample_id"].combine_chunks().dictionary_encode()
    at = coded.indices.to_numpy()
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(len(coded.dictionary)))
    w = rows["w"].to_numpy()[order]
    shift = rows["shift"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)[order]
    shift *= w[:, None]
    mean = np.add.reduceat(shift, starts, axis=0) / np.add.reduceat(w, starts)[:, None]
    return pa.table({"sample_id": coded.dictionary, "bias": pa.array(list(mean), pa.list_(pa.float64()))})


def shifted(moving: DataFrame, standing: DataFrame, matches: DataFrame, sigma: float, anchors: int) -> DataFrame:
    """Cells of `moving` shifted towards `standing`.

    A matched sample's shift is the mean over its matches (a moving, b standing). A sample takes the mean of its nearest `anchors`
    matched samples' shifts, by weights exp(-sigma / 2 * squared distance) times their matches; relative to the nearest one's,
    so that far samples have weights too.
    """
    pairs = materialize(matches.select("a", "b"))
    of = lambda cells, key, value: cells.select(F.col("sample_id").alias(key), "feature_id", F.col("value").alias(value))
    both = pairs.join(of(moving, "a", "x"), "a").join(of(standing, "b", "y"), ["b", "feature_id"])
    shift = both.groupBy("a", "feature_id").agg(F.avg(F.col("y") - F.col("x")).alias("shift"), F.count(F.lit(1)).alias("n"))
    # Layers are complete: a sample has a shift for each feature, of as many matches.
    shift = materialize(shift.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("feature_id", "shift"))).alias("x"), F.max("n").alias("n")).select("a", F.col("x.shift").alias("shift"), "n"))
    rows = materialize(row_arrays(moving))
    near = nearest(rows, anchors, rows.join(pairs.select(F.col("a").alias("sample_id")).distinct(), "sample_id", "left_semi"))
    near = near.join(rows.select("sample_id", F.size("vec").alias("width")), "sample_id")
    square = F.col("distance") ** 2 * F.col("width")
    weight = F.exp(-sigma / 2 * (square - F.min(square).over(Window.partitionBy("sample_id"))))
    weighed = near.select("sample_id", F.col("other").alias("a"), weight.alias("w")).join(shift, "a").select("sample_id", (F.col("w") * F.col("n")).alias("w"), "shift")
    groups = groups_of(rows.count(), GROUP)
    means = weighed.groupBy(F.pmod(F.xxhash64("sample_id"), F.lit(groups)).alias("group")).applyInArrow(weighted_means, "sample_id string, bias array<double>")
    bias = rows.select("sample_id", "names").join(means, "sample_id").select("sample_id", F.explode(F.arrays_zip("names", "bias")).alias("c")).select("sample_id", F.col("c.names").alias("feature_id"), F.col("c.bias").alias("bias"))
    return moving.join(bias, ["sample_id", "feature_id"], "left").withColumn("value", F.col("value") + F.coalesce("bias", F.lit(0.0))).select(*CELL, "batch")


def integrate_scanorama(cells: DataFrame, obs: DataFrame, *, batch: str = "batch", sigma: float = 15.0, alpha: float = 0.1, knn: int | None = None, dimred: int | None = 100, anchors: int = 100, report: list | None = None) -> DataFrame:
    """Corrected cells of a complete layer of two batches or more; samples have length 1, as the method sees them, or 0.

    Matches are mutual nearest neighbours, exact ones, of all pairs of batches, in `dimred` leading axes where features are more.
    Pairs of batches whose share of matched samples is above alpha are joined, best first, unless they are in one panorama
    already: a batch of no panorama yet moves (of two, the first by name), else the first one's panorama. `report` takes
    (score, batch, batch, joined) of all pairs that match.
    """
    if sigma <= 0 or not 0 < alpha < 1 or (knn is not None and knn < 1) or anchors < 1 or (dimred is not None and dimred < 1):
        raise ValidationError("sigma, knn, dimred and anchors must be positive, alpha between 0 and 1")
    of, cells = once(obs.select("sample_id", F.col(batch).cast("string").alias("batch"))), once(cells)
    now = materialize(cosine_normalized(cells).withColumn("value", F.coalesce("value", F.lit(0.0))).join(of, "sample_id"))
    found = now.select("sample_id", "batch").distinct().groupBy("batch").count().limit(MAX_BATCHES + 1).collect()
    sizes = {r["batch"]: r["count"] for r in found if r["batch"] is not None}
    if len(sizes) < 2 or len(sizes) < len(found) or len(found) > MAX_BATCHES:
        raise ValidationError(f"integration needs two batches to {MAX_BATCHES}, and no sample without one")
    width = cells.select("feature_id").distinct().count()
    if cells.where("value is null").limit(1).count() or now.count() < width * sum(sizes.values()):
        raise ValidationError("Scanorama needs cells without missing values")
    rows = row_arrays(now)
    if dimred is not None and width > dimred:
        scores = pca(now, dimred, center=False)["scores"]
        rows = scores.select("sample_id", F.transform(F.sequence(F.lit(1), F.size("vec")), lambda i: i.cast("string")).alias("names"), "vec")
    rows = materialize(rows.join(of, "sample_id"))
    k = knn or min(20, max(1, min(sizes.values()) - 1))
    side = lambda key, name: of.select(F.col("sample_id").alias(key), F.col("batch").alias(name))
    matches = materialize(mutual_between(rows, k, sizes).join(side("a", "here"), "a").join(side("b", "there"), "b"))

    panorama = {name: {name} for name in sizes}
    for score, x, y in match_shares(matches, sizes):
        join = score > alpha and panorama[x] is not panorama[y]
        if report is not None:
            report.append((score, x, y, join))
        if not join:
            continue
        ours, theirs = panorama[x], panorama[y]
        if len(ours) > 1 and len(theirs) == 1:
            ours, theirs = theirs, ours
        inside = lambda name, of: F.col(name).isin(sorted(of))
        moved = shifted(now.where(inside("batch", ours)), now.where(inside("batch", theirs)), matches.where(inside("here", ours) & inside("there", theirs)), sigma, anchors)
        now = materialize(now.where(~inside("batch", ours)).unionByName(moved))
        whole = ours | theirs
        panorama.update(dict.fromkeys(whole, whole))
    return now.select(*CELL)
