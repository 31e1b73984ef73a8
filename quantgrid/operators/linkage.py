"""Hierarchical clustering of a table of distances, whose pairs stay in Spark.

Single linkage is the minimum spanning tree: every task keeps the spanning forest of the pairs that pass it, which is all that the
tree can need of them, and forests are put together in the same way. Average, complete and Ward linkage merge all pairs of
clusters that are each other's nearest at once, which gives the same tree as merging the nearest pair one by one. Sets of copies, all
of whose pairs are at distance 0, are merged before, since rounds would merge them one by one. Rounds are passes over the table of
pairs, of which one is kept, until at most TAIL clusters are left; one task makes the rounds that remain, on their matrix. Clusters are
named after their least member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..storage import delete, materialize, new_table

METHODS = ("single", "average", "complete", "ward")
MAX_LEAVES = 1 << 19  # items whose merges are numbered and ordered, which the driver does
TAIL = 1 << 12  # clusters whose matrix one task holds
TOGETHER = 1 << 18  # pairs that are added to a forest at a time
FORESTS = 8  # tasks that put forests together, before one does

MERGES = "a string, b string, height double, n long"


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which edges between nodes below n, listed by rising length, are in their minimum spanning forest (Boruvka's rounds)."""
    part, keep, live, every = np.arange(n), np.zeros(len(a), bool), np.arange(len(a)), np.arange(n)
    while True:
        left, right = part[a[live]], part[b[live]]
        outward = left != right
        live, left, right = live[outward], left[outward], right[outward]
        if not len(live):
            return keep
        first = np.full(n, len(a))
        np.minimum.at(first, left, live)
        np.minimum.at(first, right, live)
        own = np.flatnonzero(first < len(a))
        taken = first[own]
        keep[taken] = True
        to = every.copy()
        to[own] = part[a[taken]] + part[b[taken]] - own  # the part at the other end
        to = np.where((to[to] == every) & (every < to), every, to)
        while (to[to] != to).any():
            to = to[to]
        part = to[part]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spanning forest of all pairs of a task, in room in proportion to its items; ties by names."""
    kept, waiting, rows = [], [], 0

    def joined() -> list[pa.RecordBatch]:
        table = pa.Table.from_batches(kept + waiting)
        names = pa.chunked_array([*table["a"].chunks, *table["b"].chunks]).combine_chunks().dictionary_encode()
        words = np.array(names.dictionary.to_pylist(), object)
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(words, kind="stable")] = np.arange(len(words))
        a, b = np.split(rank[names.indices.to_numpy()], 2)
        order = np.lexsort((b, a, table["distance"].to_numpy()))
        order = order[forest(a[order], b[order], len(words))]
        return table.take(pa.array(order)).combine_chunks().to_batches()

    for batch in batches:
        waiting.append(batch)
        rows += batch.num_rows
        if rows >= TOGETHER:
            kept, waiting, rows = joined(), [], 0
    if rows:
        kept = joined()
    yield from kept


def spanning_tree(distances: DataFrame) -> DataFrame:
    """(a, b, distance): the edges of the minimum spanning forest of pairs (a, b, distance); ties by names."""
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    tree = distances.where("distance is not null and a <> b").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col("distance").cast("double").alias("distance"))
    kind = "a string, b string, distance double"
    return tree.mapInArrow(_forests, kind).repartition(FORESTS).mapInArrow(_forests, kind).repartition(1).mapInArrow(_forests, kind)


def heights(v: np.ndarray, na: np.ndarray, nb: np.ndarray, wa: np.ndarray, wb: np.ndarray, method: str) -> np.ndarray:
    """The heights at which clusters of sizes na and nb merge, of the values between them and, for Ward, those within."""
    if method == "complete":
        return v
    cross = v / (na * nb)
    if method == "average":
        return cross
    centre = cross - wa / na**2 - wb / nb**2  # the squared distance of the centres, from sums of squares
    return np.sqrt(np.maximum(2 * na * nb / (na + nb) * centre, 0.0))


def _nearest(size: np.ndarray, within: np.ndarray, method: str):
    """Of a task's pairs (a, b, v) the nearest of each cluster, ties to the lesser names of the pair as a whole, so that a nearest pair is mutual."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tuple(np.zeros(0, t) for t in (np.int32, float, np.int32, np.int32, float))
        for batch in batches:
            a, b, v = (batch[c].to_numpy() for c in ("a", "b", "v"))
            d = heights(v, size[a], size[b], within[a], within[b], method)
            new = np.concatenate([a, b]), np.tile(d, 2), np.tile(a, 2), np.tile(b, 2), np.tile(v, 2)
            c, d, x, y, v = (np.concatenate(both) for both in zip(held, new))
            order = np.lexsort((y, x, d, c))
            order = order[np.diff(c[order], prepend=-1) != 0]
            held = tuple(values[order] for values in (c, d, x, y, v))
        yield pa.record_batch([pa.array(h) for h in held], names=["c", "d", "x", "y", "v"])

    return run


def _renamed(to: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = to[batch["a"].to_numpy()], to[batch["b"].to_numpy()]
            use = a != b
            yield pa.record_batch([pa.array(np.minimum(a, b)[use]), pa.array(np.maximum(a, b)[use]), pa.array(batch["v"].to_numpy()[use])], names=["a", "b", "v"])

    return run


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of at least TOGETHER rows, and the rest."""
    waiting, rows = [], 0
    for batch in batches:
        waiting.append(batch)
        rows += batch.num_rows
        if rows >= TOGETHER:
            yield pa.Table.from_batches(waiting)
            waiting, rows = [], 0
    if rows:
        yield pa.Table.from_batches(waiting)


def _numbered(names: list[str], to: np.ndarray):
    """Pairs by the numbers of their clusters instead of the names of their items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(names, pa.string())
        for table in _together(batches):
            a, b = (to[pc.index_in(table[c].combine_chunks(), known).to_numpy()] for c in ("a", "b"))
            use = a != b
            yield pa.record_batch([pa.array(np.minimum(a, b)[use]), pa.array(np.maximum(a, b)[use]), pa.array(table["v"].to_numpy()[use])], names=["a", "b", "v"])

    return run


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's pairs (name, null, its pairs at distance 0), and (a, b, 0) for the edges of a forest of these pairs."""
    kept, zeros = None, []
    for table in _together(batches):
        names = pa.chunked_array([*table["a"].chunks, *table["b"].chunks]).combine_chunks().dictionary_encode()
        zero = np.tile(table["v"].to_numpy() == 0, 2)
        n = np.bincount(names.indices.to_numpy()[zero], minlength=len(names.dictionary))
        new = pa.table({"a": names.dictionary, "n": pa.array(n.astype(np.int64))})
        kept = new if kept is None else pa.concat_tables([kept, new]).group_by("a").aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})
        edges = table.filter(pa.array(zero[: table.num_rows])).select(["a", "b"])
        if edges.num_rows:
            edges = edges.append_column("distance", pa.array(np.zeros(edges.num_rows)))
            zeros = list(_forests(iter([*zeros, *edges.combine_chunks().to_batches()])))
    kinds = pa.schema([("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])
    if kept is not None:
        kept = kept.select(["a", "n"]).combine_chunks()
        for batch in kept.to_batches():
            yield pa.record_batch([batch["a"], pa.nulls(batch.num_rows, pa.string()), batch["n"]], schema=kinds)
    for batch in zeros:
        yield pa.record_batch([batch["a"], batch["b"], pa.array(np.zeros(batch.num_rows, np.int64))], schema=kinds)


def copies(names: list[str], zeros: list[int], edges: list[tuple[str, str]]) -> list[list[int]]:
    """Sets of items all of whose pairs are at distance 0, by rising number. zeros: how many such pairs each item has."""
    number = {name: i for i, name in enumerate(names)}
    top = list(range(len(names)))

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in edges:
        x, y = sorted((root(number[a]), root(number[b])))
        top[y] = x
    sets: dict[int, list[int]] = {}
    for i, n in enumerate(zeros):
        if n:
            sets.setdefault(root(i), []).append(i)
    return [s for s in sets.values() if sum(zeros[i] for i in s) == len(s) * (len(s) - 1)]


def _added(x: np.ndarray, y: np.ndarray, method: str) -> np.ndarray:
    """Values of two clusters beside the same others; NaN where there is none."""
    return np.fmax(x, y) if method == "complete" else np.where(np.isnan(x), y, np.where(np.isnan(y), x, x + y))


def merged_rounds(v: np.ndarray, n: np.ndarray, w: np.ndarray, method: str) -> list[tuple[int, int, float, int]]:
    """(a, b, height, n): all merges of clusters from the matrix of values between them (NaN on its diagonal and where there are none).

    Heights and each cluster's nearest are kept; a round looks again at what it merged, and at those whose nearest it merged.
    """
    ids, out = np.arange(len(n)), []
    while len(n) > 1:  # rounds until half of the clusters are gone
        h = heights(v, n[:, None], n, w[:, None], w, method)
        h = np.where(np.isnan(h), np.inf, h)
        alive, every = np.ones(len(n), bool), np.arange(len(n))
        best = h.argmin(1)
        low = h[every, best]
        while 2 * alive.sum() > len(n) or len(n) <= 2:
            x = np.flatnonzero(alive & np.isfinite(low) & (best[best] == every) & (every < best))
            if not len(x):
                return out
            y = best[x]
            out += zip(ids[x].tolist(), ids[y].tolist(), low[x].tolist(), (n[x] + n[y]).tolist())
            w[x] += w[y] + v[x, y]
            n[x] += n[y]
            alive[y] = False
            v[x] = _added(v[x], v[y], method)
            v[:, x] = _added(v[:, x], v[:, y], method)
            v[x, x] = np.nan
            h[y] = h[:, y] = np.inf
            v[y] = v[:, y] = np.nan
            new = heights(v[x], n[x][:, None], n, w[x][:, None], w, method)
            h[x] = np.where(np.isnan(new), np.inf, new)
            h[:, x] = h[x].T
            gone = np.zeros(len(n), bool)
            gone[x] = gone[y] = True
            again = np.flatnonzero(alive & (gone | gone[best]))
            for i in range(0, len(again), 256):
                some = again[i : i + 256]
                best[some] = h[some].argmin(1)
            low[again] = h[again, best[again]]
            rest = np.flatnonzero(alive & ~gone)
            near = x[h[np.ix_(rest, x)].argmin(1)]
            d = h[rest, near]
            less = (d < low[rest]) | ((d == low[rest]) & (near < best[rest]))
            best[rest[less]], low[rest[less]] = near[less], d[less]
        left = np.flatnonzero(alive)
        v, n, w, ids = v[np.ix_(left, left)], n[left], w[left], ids[left]
    return out


def _rest(left: np.ndarray, size: np.ndarray, within: np.ndarray, method: str):
    """All merges of the clusters that are left, at most TAIL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = np.full((len(left), len(left)), np.nan)
        for batch in batches:
            i, j = (np.searchsorted(left, batch[c].to_numpy()) for c in ("a", "b"))
            v[i, j] = v[j, i] = batch["v"].to_numpy()
        found = np.array(merged_rounds(v, size[left], within[left], method)).reshape(-1, 4)
        a, b = (pa.array(left[found[:, i].astype(np.int64)].astype(np.int32)) for i in (0, 1))
        yield pa.record_batch([a, b, pa.array(found[:, 2]), pa.array(found[:, 3].astype(np.int64))], names=["a", "b", "height", "n"])

    return run


def mutual_merges(distances: DataFrame, method: str, unique: bool = False) -> DataFrame:
    """(a, b, height, n): the merges of average, complete or Ward linkage; a and b are the least members, n the size after it.

    Between clusters stay sums (average), largest values (complete) or sums of squares (Ward, which also keeps those within), so
    that merging is renaming and grouping. The driver holds names, sizes and merges. A round of Spark has as many pairs as
    clusters have, and its rounds are few unless one cluster takes up the others one by one. `unique`: no two items have two rows,
    so that rows are computed anew for each of two passes, and only pairs of the clusters after the first merges are written.
    """
    spark = distances.sparkSession
    d = F.col("distance").cast("double")
    value = d * d if method == "ward" else d
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    pairs = distances.where("distance is not null and a <> b").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), value.alias("v"))
    if not unique:
        pairs = materialize(pairs.groupBy("a", "b").agg(F.min("v").alias("v")))
    seen = materialize(pairs.mapInArrow(_survey, "a string, b string, n long"))
    items = sorted((r["a"], r["n"]) for r in seen.where("b is null").groupBy("a").agg(F.sum("n").alias("n")).limit(MAX_LEAVES + 1).collect())
    if len(items) > MAX_LEAVES:
        raise ValidationError(f"more than {MAX_LEAVES} items")
    names = [name for name, _ in items]
    edges = []
    if any(n for _, n in items):  # the forest of their pairs has fewer edges than there are items
        zeros = seen.where("b is not null").select("a", "b", F.lit(0.0).alias("distance"))
        edges = zeros.repartition(1).mapInArrow(_forests, "a string, b string, distance double").collect()
    size, within, left = np.ones(len(names)), np.zeros(len(names)), np.arange(len(names))
    found, to = [], np.arange(len(names), dtype=np.int32)
    for least, *others in copies(names, [n for _, n in items], [(r["a"], r["b"]) for r in edges]):
        for i, b in enumerate(others):
            to[b] = least
            found.append((names[least], names[b], 0.0, i + 2))
        size[least] += len(others)
    left = np.setdiff1d(left, np.flatnonzero(to != left))
    add = F.max("v") if method == "complete" else F.sum("v")
    pairs = pairs.mapInArrow(_numbered(names, to), "a int, b int, v double")
    if found:
        pairs = pairs.groupBy("a", "b").agg(add.alias("v"))
    table = new_table(spark)
    pairs = materialize(pairs, table)
    while len(left) > TAIL:
        best = pairs.mapInArrow(_nearest(size, within, method), "c int, d double, x int, y int, v double")
        best = best.groupBy("c").agg(F.min(F.struct("d", "x", "y", "v")).alias("e"))
        merges = [r["e"] for r in best.groupBy("e").agg(F.count(F.lit(1)).alias("times")).where("times = 2").collect()]
        if not merges:
            break
        to = np.arange(len(names), dtype=np.int32)
        for r in merges:
            a, b = r["x"], r["y"]
            within[a] += within[b] + r["v"]
            size[a] += size[b]
            to[b] = a
            found.append((names[a], names[b], r["d"], int(size[a])))
        left = np.setdiff1d(left, np.flatnonzero(to != np.arange(len(to))))
        before, table = table, new_table(spark)
        pairs = materialize(pairs.mapInArrow(_renamed(to), "a int, b int, v double").groupBy("a", "b").agg(add.alias("v")), table)
        delete(spark, before)
    if 1 < len(left) <= TAIL:
        rest = pairs.repartition(1).mapInArrow(_rest(left, size, within, method), "a int, b int, height double, n long")
        found += [(names[r["a"]], names[r["b"]], r["height"], r["n"]) for r in rest.collect()]
    return spark.createDataFrame(found, MERGES)


def linkage(distances: DataFrame, method: str = "average", *, unique: bool = False) -> DataFrame:
    """(step, a, b, height, n) from distances (a, b, distance) of all pairs: which clusters merge, by rising height.

    a and b are the least members of the clusters, a < b, and n the size of the new one. Pairs without a distance never merge
    in single linkage; the other methods need all pairs. At most MAX_LEAVES items: the steps are numbered on the driver. `unique`: no
    two items have two rows; then the rows are computed twice instead of being written.
    """
    if method not in METHODS:
        raise ValidationError(f"method is one of {METHODS}, not {method!r}")
    spark = distances.sparkSession
    if method != "single":
        merges = mutual_merges(distances, method, unique)
        rows = merges.limit(MAX_LEAVES).collect()
        # A merge comes after those that made its parts, also at equal heights: these have fewer members.
        rows = sorted((r["height"], r["n"], r["a"], r["b"]) for r in rows)
        out = [(i + 1, a, b, float(h), int(n)) for i, (h, n, a, b) in enumerate(rows)]
    else:
        rows = sorted((r["distance"], r["a"], r["b"]) for r in spanning_tree(distances).limit(MAX_LEAVES).collect())
        above: dict[str, str] = {}
        size: dict[str, int] = {}

        def top(x: str) -> str:
            while above.get(x, x) != x:
                above[x] = above.get(above[x], above[x])
                x = above[x]
            return x

        out = []
        for i, (h, a, b) in enumerate(rows):
            a, b = sorted((top(a), top(b)))
            above[b], size[a] = a, size.get(a, 1) + size.get(b, 1)
            out.append((i + 1, a, b, float(h), size[a]))
    if len(out) >= MAX_LEAVES:
        raise ValidationError(f"more than {MAX_LEAVES} items")
    return spark.createDataFrame(out, "step int, a string, b string, height double, n long")


def leaf_order(merges: DataFrame) -> DataFrame:
    """(name, place): the leaves of a linkage from left to right; a merge's part of the lesser member comes first."""
    members: dict[str, list[str]] = {}
    for r in sorted(merges.limit(MAX_LEAVES).collect(), key=lambda r: r["step"]):
        a, b = members.pop(r["a"], [r["a"]]), members.pop(r["b"], [r["b"]])
        if len(a) < len(b):  # the shorter list is the one that is copied
            b[:0] = a
            members[r["a"]] = b
        else:
            a += b
            members[r["a"]] = a
    order = [x for name in sorted(members) for x in members[name]]
    return merges.sparkSession.createDataFrame([(x, i + 1) for i, x in enumerate(order)], "name string, place int")


def cut_tree(merges: DataFrame, k: int) -> DataFrame:
    """(name, label): the k clusters that are left before the last k - 1 merges, named after their least member."""
    if k < 1:
        raise ValidationError("k must be 1 or more")
    rows = sorted(merges.limit(MAX_LEAVES).collect(), key=lambda r: r["step"])
    label = {x: x for r in rows for x in (r["a"], r["b"])}
    for r in rows[: max(0, len(label) - k)]:
        label[r["b"]] = r["a"]

    def top(x: str) -> str:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    return merges.sparkSession.createDataFrame([(x, top(x)) for x in sorted(label)], "name string, label string")
