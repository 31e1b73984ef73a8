"""Best-fit packing of documents into bins of equal capacity, under conflicts.

Open bins are kept in order of their residual capacity and carry bitmaps of the sources and duplicate clusters in them. An
item goes to the tightest bin that holds it and doesn't conflict: the search starts at the first bin that is large enough and
goes on to its successors. Documents are packed in groups of bounded size, dealt by hash; bins never span groups.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, groups_of, materialize
from .jaccard_join import jaccard_join
from .mixing import word_count

GROUP_DOCS = 2048
PACKED = "doc_id long, source string, piece int, n_pieces int, bin long, start int, length int"


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, start) of each item, taken in the given order; a bin takes per_source items of a source and one of a cluster."""
    bins: list[tuple[int, int]] = []  # (residual, bin), ascending
    source_bits: list[list[int]] = []  # plane p of a bin: sources that it has more than p times
    cluster_bits: list[int] = []
    out, before, resume = [], None, (0, -1)
    for item in zip(sizes, sources, clusters):
        size, source, cluster = item
        at = bisect_left(bins, (size, -1))
        if item == before:  # its equal has just found all tighter bins in conflict
            at = max(at, bisect_left(bins, resume))
        while at < len(bins):
            n = bins[at][1]
            if not (source_bits[n][-1] >> source | cluster_bits[n] >> cluster) & 1:
                break
            at += 1
        if at < len(bins):
            resume = residual, n = bins.pop(at)
        else:
            residual, n = capacity, len(source_bits)
            resume = (capacity + 1, n)
            source_bits.append([0] * per_source)
            cluster_bits.append(0)
        planes = source_bits[n]
        for p in range(per_source):
            if not planes[p] >> source & 1:
                planes[p] |= 1 << source
                break
        cluster_bits[n] |= 1 << cluster
        insort(bins, (residual - size, n))
        out.append((n, capacity - residual))
        before = item
    return out


def pack_group(capacity: int, per_source: int) -> Callable:
    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "size", "cluster", "source")])  # whatever order they came in
        group, docs = rows["group"][0].as_py(), rows["doc_id"].to_pylist()
        size, names = rows["size"].to_numpy(), rows["source"].to_pylist()
        cluster = rows["cluster"].to_numpy()
        number = {s: i for i, s in enumerate(sorted({*names}, key=lambda s: (s is None, s or "")))}
        source, kind = np.array([number[s] for s in names]), np.unique(cluster, return_inverse=True)[1]
        full, rest = np.divmod(size, capacity)
        some = np.flatnonzero(rest)
        ids = np.array([-(1 << 63) if d is None else d for d in docs])
        some = some[np.lexsort((ids[some], kind[some], source[some], -rest[some]))]
        placed = best_fit(rest[some].tolist(), source[some].tolist(), kind[some].tolist(), capacity, per_source)
        out = [(int(i), int(full[i]), b, start, int(rest[i])) for i, (b, start) in zip(some, placed)]
        used = max((b for b, _ in placed), default=-1) + 1
        whole = np.repeat(np.arange(len(docs)), full)
        piece = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        out += [(int(i), int(p), used + j, 0, capacity) for j, (i, p) in enumerate(zip(whole, piece))]
        pieces = (full + (rest > 0)).tolist()
        columns = [
            pa.array([docs[i] for i, *_ in out], pa.int64()),
            pa.array([names[i] for i, *_ in out], pa.string()),
            pa.array([p for _, p, *_ in out], pa.int32()),
            pa.array([pieces[i] for i, *_ in out], pa.int32()),
            pa.array([group << 32 | b for _, _, b, _, _ in out], pa.int64()),
            pa.array([s for *_, s, _ in out], pa.int32()),
            pa.array([n for *_, n in out], pa.int32()),
        ]
        return pa.table(columns, names=[x.split()[0] for x in PACKED.split(", ")])

    return pack


def length_of(text: str) -> Column:
    """Words and one end mark."""
    return word_count(F.col(text)) + 1


def hash_of(text: str) -> Column:
    return F.xxhash64(text)


def pack_documents(docs: DataFrame, *, capacity: int = 2048, per_source: int = 2, doc_id: str = "doc_id", text: str = "text", source: str = "source", cluster: str | None = None, size: Column | None = None, own: Column | None = None) -> DataFrame:
    """(doc_id, source, piece, n_pieces, bin, start, length): where each piece of each row lies.

    A row's length is its words and one end mark, so that null and empty texts have length 1. A longer row than a bin is cut into
    pieces: full ones get bins of their own, the rest is packed like a short row. Rests are taken by falling length. A bin holds
    per_source rests of a source at most (null is a source) and one of a duplicate cluster: the column `cluster`, a long, or else
    equal texts. Equal rows are packed each, and dealt to groups like any others. Other columns don't matter. size and own take the
    place of `length_of` and `hash_of` the text, for docs that have these as columns and no text.
    """
    kind = F.coalesce(F.col(cluster).cast("long"), F.xxhash64(doc_id)) if cluster else F.xxhash64(F.coalesce(text, F.lit("")))
    size, own = length_of(text) if size is None else size, hash_of(text) if own is None else own
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), size.alias("size"), kind.alias("cluster"), own.alias("own"))
    # Equal rows are counted and numbered, so that groups depend on the rows alone, not on how they are dealt out.
    slim = slim.groupBy("doc_id", "source", "size", "cluster", "own").agg(F.count(F.lit(1)).cast("int").alias("count"))
    slim = materialize(slim.select("doc_id", "source", "size", "cluster", "own", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("again")))
    groups = groups_of(slim.count(), GROUP_DOCS)
    slim = slim.select("doc_id", "source", "size", "cluster", F.pmod(F.xxhash64("doc_id", "source", "own", "again"), F.lit(groups)).cast("long").alias("group"))
    return slim.groupBy("group").applyInArrow(pack_group(capacity, per_source), PACKED)


def near_clusters(docs: DataFrame, *, threshold: float = 0.8, text: str = "text", cluster: str = "cluster", keep: dict[str, Column] | None = None) -> DataFrame:
    """Add `cluster`: rows that links of Jaccard `threshold` or more join share it, whatever their ids; so do rows without words.

    It is the least hash of the texts of the group, so that it doesn't depend on how rows are dealt out. `keep`, if given, is
    what stays of docs: columns that are computed where the texts are first read, and stored with them.
    """
    some = F.col(text).rlike(WORD)
    kept = {f"__keep_{i}": c for i, c in enumerate((keep or {}).values())}
    marks = {"__row": F.monotonically_increasing_id(), "__own": F.xxhash64(F.when(some, F.col(text)).otherwise(F.lit("")))}
    rows = materialize(docs.withColumns(marks | kept))
    joined = jaccard_join(rows.select("__row", text), threshold=threshold, doc_id="__row", text=text)
    mates = materialize(joined.where("n_copies > 1 or n_links > 0")).select(F.col("doc_id").alias("__row"), "group_id")
    mates = mates.join(rows.select("__row", "__own"), "__row")
    least = mates.groupBy("group_id").agg(F.min("__own").alias("__least"))
    shared = mates.join(least, "group_id").select("__row", "__least")
    if keep is not None:
        rows = rows.select("__row", "__own", *(F.col(c).alias(n) for c, n in zip(kept, keep)))
    return rows.join(shared, "__row", "left").withColumn(cluster, F.coalesce("__least", "__own")).drop("__row", "__own", "__least")
