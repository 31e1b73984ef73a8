"""N-gram Jaccard join: a MinHash LSH forest over five-word shingles, verified exactly.

Documents of equal shingle sets form a class, which is searched once. Each tree of the forest labels a class with a sequence of
DEPTH min-hashes. Classes that share a tree's shortest prefix, the longest one at which a pair at the threshold meets in some
tree with the target recall, are the members of a trie: they are sorted by their whole sequences, so that longer prefixes are
runs of neighbours. A class looks at those first that share all of its sequence; it shortens the prefix level by level until
the recall estimated from the likeness of those it has met reaches the target, or down to the shortest prefix. Classes that
meet, of like size and like signature, are chained into families, so that each family's texts come together once; there all
pairs are compared by their whole shingle sets. Large tries and families are dealt out as pairs of blocks. Pairs are counted
where they are compared, not emitted.

Signatures come from one hash of each shingle: it falls into one of TREES * DEPTH bins, whose least value is the min-hash; an
empty bin takes the value of the filled bin that comes first in an order of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups_of, materialize
from .line_dedup import mix64

WORDS = 5
TREES, DEPTH = 24, 8
BLOCK = 256  # classes of a block
CELL_ROWS = 4096  # rows of a task's cell of small groups
SIGMAS = 5  # a pair is looked at from the share of equal min-hashes that lies so far below the threshold
#: A list of at most so many ids is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 200_000
TOGETHER = 4 << 20  # bytes of text whose shingles are made together
FEW = 24  # a set that fills fewer bins looks for its donors by itself
STEP = np.uint64(0x9E3779B97F4A7C15)


def meeting(likeness: np.ndarray | float, depth: int, trees: int) -> np.ndarray | float:
    """The chance that pairs of such likeness share a prefix of `depth` in one of the trees."""
    return 1 - (1 - likeness**depth) ** trees


def prefix_depth(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair at the threshold meets in one of the trees with probability `recall`; ValueError if there is none."""
    while depth and meeting(threshold, depth, trees) < recall:
        depth -= 1
    if not depth:
        raise ValueError(f"{trees} trees can't reach a recall of {recall} at a threshold of {threshold}; take more trees")
    return depth


def loose(threshold: float, hashes: int) -> float:
    """The share of equal min-hashes that a pair at the threshold falls below about once in 3 million times."""
    return threshold - SIGMAS * (threshold * (1 - threshold) / hashes) ** 0.5


def shingles(text: bytes, width: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes, ascending, of the runs of `width` words; a shorter text is one run, one without words none.

    Words are runs of non-space, A-Z lower-cased.
    """
    return shingle_sets(pa.array([text], pa.binary()).view(pa.string()), width)[0]


def word_hashes(words: pa.Array) -> np.ndarray:
    """The 64-bit hash of each word: its bytes times weights of their places, added up for all distinct words at once."""
    coded = words.dictionary_encode()
    names = coded.dictionary.cast(pa.large_binary())
    if not len(names):
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1]
    sizes = np.diff(ends)
    weights = mix64(np.arange(1, int(sizes.max(initial=0)) + 1, dtype=np.uint64) * STEP)
    place = np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], sizes)
    values = np.frombuffer(names.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        total = np.append(np.uint64(0), np.cumsum(values * weights[place]))
        return mix64(total[ends[1:] - ends[0]] - total[ends[:-1] - ends[0]])[coded.indices.to_numpy()]


def distinct(s: np.ndarray) -> np.ndarray:
    """The distinct values, ascending."""
    s = np.sort(s)
    new = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    return s[new]


def shingle_sets(texts: pa.Array, width: int = WORDS) -> list[np.ndarray]:
    """As `shingles` for each text, none of them null; words are hashed and joined for all texts at once."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = lists.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    h = word_hashes(flat)[real]
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    ends = np.concatenate([[0], np.cumsum(real)])[offsets]
    n = max(len(h) - width + 1, 0)
    s = np.full(n, np.uint64(width))
    with np.errstate(over="ignore"):
        for i in range(width):
            s = (s ^ h[i : i + n]) * STEP
            s ^= s >> np.uint64(29)
    s = mix64(s)
    out = []
    for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
        out.append(distinct(s[start : end - width + 1]) if end - start >= width else joined(h[start:end]))
    return out


def joined(h: np.ndarray, width: int = WORDS) -> np.ndarray:
    """The distinct hashes, ascending, of the runs of `width` words; of fewer words as one run."""
    if not len(h):
        return np.zeros(0, np.uint64)
    width = min(width, len(h))
    n = len(h) - width + 1
    s = np.full(n, np.uint64(width))
    with np.errstate(over="ignore"):
        for i in range(width):
            s = (s ^ h[i : i + n]) * STEP
            s ^= s >> np.uint64(29)
    return np.unique(mix64(s))


def donors(bins: int) -> np.ndarray:
    """order[i]: the rank of each bin as a donor for bin i."""
    grid = mix64((np.arange(bins, dtype=np.uint64)[:, None] << np.uint64(32)) + np.arange(bins, dtype=np.uint64) + np.uint64(1))
    return np.argsort(np.argsort(grid, axis=1), axis=1).astype(np.int16)


def signatures(sets: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """The min-hash of each bin, in 32 bits, of sets of ascending hashes that aren't empty; an empty bin takes that of its first donor."""
    bins = len(order)
    whole = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    place = np.repeat(np.arange(len(sets)) * bins, [len(s) for s in sets]) + (whole % np.uint64(bins)).astype(np.int64)
    out, filled = np.zeros(len(sets) * bins, np.uint64), np.zeros(len(sets) * bins, bool)
    out[place[::-1]] = whole[::-1]  # of several values for one bin the last counts: the least
    filled[place] = True
    out, filled = out.reshape(-1, bins), filled.reshape(-1, bins)
    n = filled.sum(1)
    for i in np.flatnonzero(n < FEW):
        empty, full = np.flatnonzero(~filled[i]), np.flatnonzero(filled[i])
        out[i, empty] = out[i, full[order[empty][:, full].argmin(1)]]
    row, own = np.nonzero(~filled & (n >= FEW)[:, None])
    for donor in np.argsort(order, axis=1).T:  # each bin's first donor, then its next, until all have met a filled one
        if not len(row):
            break
        theirs = donor[own]
        has = filled[row, theirs]
        out[row[has], own[has]] = out[row[has], theirs[has]]
        row, own = row[~has], own[~has]
    return (mix64(out) >> np.uint64(32)).astype(np.uint32)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about TOGETHER bytes of text, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + TOGETHER, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def signature_rows(trees: int, depth: int, prefix: int) -> Callable:
    """(doc_id, shingle_set, n, keys, bytes): the set's hash and size, each tree's shortest prefix as a key, the signature's low bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = donors(trees * depth)
        salt = mix64(np.arange(trees, dtype=np.uint64) * STEP)
        kinds = pa.schema([("doc_id", pa.int64()), ("shingle_set", pa.binary()), ("n", pa.int32()), ("keys", pa.list_(pa.int64())), ("bytes", pa.binary())])
        for batch in (some for b in batches for some in slices(b)):
            sets = shingle_sets(pc.fill_null(batch["text"], ""))
            sizes = [len(s) for s in sets]
            names = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            found = [s for s in sets if len(s)]
            sig = signatures(found, order).reshape(len(found), trees, depth)
            key = np.repeat(salt[None], len(found), axis=0)
            with np.errstate(over="ignore"):
                for level in range(prefix):
                    key = mix64((key ^ sig[:, :, level]) * STEP)
            some = np.array(sizes) > 0
            ends = np.concatenate([[0], np.cumsum(np.where(some, trees, 0))])
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key.view(np.int64).ravel(), pa.int64()))
            marks = iter((sig & 255).astype(np.uint8).reshape(len(found), -1))
            low = pa.array([next(marks).tobytes() if x else None for x in some], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(names, pa.binary()), pa.array(sizes, pa.int32()), keys, low], schema=kinds)

    return rows


def dealt(df: DataFrame, group: str, size: str, node: str, cells: int) -> DataFrame:
    """Add cell, side and cross: small groups share cells; a large one is cut into blocks, and each pair of blocks is a cell.

    side is 0 or 1 in a cell of two blocks, whose members are compared across only (cross); else all are compared.
    """
    blocks = F.ceil(F.col(size) / F.lit(BLOCK)).cast("int")
    large = df.where(F.col(size) > BLOCK).withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64(node), F.col("blocks")).cast("int"))
    large = large.withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = [F.least("mine", "theirs"), F.greatest("mine", "theirs")]
    large = large.withColumn("cell", F.xxhash64(group, *pair)).withColumn("side", (F.col("mine") > F.col("theirs")).cast("int")).withColumn("cross", F.col("mine") != F.col("theirs"))
    small = df.where(F.col(size) <= BLOCK).withColumn("cell", F.pmod(F.xxhash64(group), F.lit(cells)))
    return small.withColumns({"side": F.lit(0), "cross": F.lit(False)}).unionByName(large.drop("blocks", "mine", "theirs"))


def runs_of(group: np.ndarray) -> Iterator[np.ndarray]:
    """The places of each value."""
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.diff(group[order])) + 1
    yield from (x for x in np.split(order, cuts) if len(x))


def smallest_linked(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each member of a symmetric link matrix the least id that links lead to."""
    least = ids.copy()
    while True:
        new = np.minimum(least, np.where(linked, least[None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max))
        if (new == least).all():
            return least
        least = new


def allowed(n: np.ndarray, side: np.ndarray, cross: bool, threshold: float) -> np.ndarray:
    """Pairs to compare: of like size, not a member with itself, across sides where asked."""
    out = np.minimum(n[:, None], n[None]) >= threshold * np.maximum(n[:, None], n[None]) - 1e-9
    np.fill_diagonal(out, False)
    return out & (side[:, None] != side[None]) if cross else out


def chain_trie(levels: np.ndarray, marks: np.ndarray, ok: np.ndarray, shortest: int, trees: int, recall: float, least: float) -> np.ndarray:
    """The symmetric matrix of pairs of a trie that meet and are alike.

    levels: what follows the shortest prefix in each member's sequence. From the whole sequence on, members whose estimated
    recall is below the target look at those that they share one level less with.
    """
    m, longest = len(levels), shortest + levels.shape[1]
    order = np.lexsort(levels.T[::-1]) if levels.shape[1] else np.arange(m)
    same = levels[order[1:]] == levels[order[:-1]]
    shared = shortest + np.cumprod(same, axis=1).sum(1)  # levels that neighbours share
    linked, open_ = np.zeros((m, m), bool), np.ones(m, bool)
    met, weight = np.zeros(m), np.zeros(m)
    inner = np.arange(m)
    for depth in range(longest, shortest - 1, -1):
        run = np.empty(m, np.int64)
        run[order] = np.concatenate([[0], np.cumsum(shared < depth)])
        new = (run[:, None] == run) & ((inner[:, None] != inner) if depth < longest else True) & ok & (open_[:, None] | open_)
        inner = run
        i, j = np.nonzero(np.triu(new))
        if not len(i):
            continue
        like = np.concatenate([(marks[i[k : k + 8192]] == marks[j[k : k + 8192]]).mean(1) for k in range(0, len(i), 8192)])
        near = like >= least
        i, j = i[near], j[near]
        linked[i, j] = linked[j, i] = True
        one = 1 / np.maximum(meeting(like[near], depth, trees), 1e-9)
        for side in (i, j):
            met += np.bincount(side, minlength=m)
            weight += np.bincount(side, one, m)
        open_ = met < recall * weight if recall < 1 else open_
        open_ |= met == 0
    return linked


def chain_cell(threshold: float, recall: float, trees: int, depth: int) -> Callable:
    """(a, b): members of a cell's tries and the least id that they are chained to."""
    shortest, least = prefix_depth(threshold, recall, trees, depth), loose(threshold, trees * depth)

    def chain(rows: pa.Table) -> pa.Table:
        key, tree, node, n, side, cross = (rows[c].to_numpy() for c in ("key", "tree", "node", "n", "side", "cross"))
        marks = np.frombuffer(b"".join(rows["bytes"].to_pylist()), np.uint8).reshape(len(node), trees * depth)
        found: list[np.ndarray] = []
        for at in runs_of(key):
            if len(at) < 2:
                continue
            ok = allowed(n[at], side[at], bool(cross[at[0]]), threshold)
            if not ok.any():
                continue
            levels = marks[at].reshape(len(at), trees, depth)[:, tree[at[0]], shortest:]
            linked = chain_trie(levels, marks[at], ok, shortest, trees, recall, least)
            root = smallest_linked(linked, node[at])
            moved = root != node[at]
            found.append(np.stack([node[at][moved], root[moved]]))
        pairs = np.unique(np.concatenate(found, 1), axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})

    return chain


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    total = np.zeros((len(sets), len(sets)))
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n > 1
    owner, at = owner[shared[at]], (np.cumsum(shared) - 1)[at[shared[at]]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    width = 4096
    for first in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(at, [first, first + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[lo:hi], at[lo:hi] - first] = 1
        total += part @ part.T
    return total


def verify_cell(threshold: float) -> Callable:
    """(shingle_set, node, root, links, linked_docs) of each member: its links, and the least id that they lead to."""

    def verify(rows: pa.Table) -> pa.Table:
        family, node, side, cross, copies = (rows[c].to_numpy() for c in ("family", "node", "side", "cross", "copies"))
        names, found = rows["shingle_set"].to_pylist(), shingle_sets(pc.fill_null(rows["text"].combine_chunks(), ""))
        out: list[tuple] = []
        for at in runs_of(family):
            kept, sets, seen = [], [], set()
            for i in at:
                s = found[i]
                name = xxhash.xxh3_128_digest(s.tobytes())
                if name == names[i] and (name, side[i]) not in seen:  # another text under the same id is another class's
                    seen.add((name, side[i]))
                    kept.append(i)
                    sets.append(s)
            if len(kept) < 2:
                continue
            n = np.array([len(s) for s in sets])
            ok = allowed(n, side[kept], bool(cross[at[0]]), threshold)
            same = intersections(sets)
            linked = ok & (same >= threshold * (n[:, None] + n[None] - same) - 1e-9)
            root = smallest_linked(linked, node[kept])
            docs = linked @ copies[kept]
            out += [(names[i], int(node[i]), int(r), int(k), int(d)) for i, r, k, d in zip(kept, root, linked.sum(1), docs) if k]
        columns = list(zip(*out)) or [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=["shingle_set", "node", "root", "links", "linked_docs"])

    return verify


def components(edges: DataFrame) -> DataFrame:
    """(a, root) for each node of the undirected edges (a, b) but the roots themselves: the least id of its component.

    Alternating large-star and small-star steps; each round is written to the shared folder.
    """
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    now = mark(e)
    while now[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        before, now = now, mark(e)
        if before == now:
            break
    return e.select("a", F.col("b").alias("root"))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def jaccard_join(docs: DataFrame, *, threshold: float = 0.8, recall: float = 0.9999, trees: int = TREES, depth: int = DEPTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, n_copies, n_links, n_linked_docs, group_id) for each row.

    class_id: the least doc_id of equal shingle sets, of n_copies rows; n_links: other classes at the threshold or above, with
    n_linked_docs rows; group_id: the least doc_id that links lead to. Rows without words or id are in no class with others: class
    and group are their own id, without links. Rows that repeat an id with different texts are in classes of their own, in one
    group. A pair at the threshold meets with probability `recall` in a class that has met no other; one that has met closer
    classes alone may stop at longer prefixes, at which the same pair meets with probability 0.98 (24 trees of depth 8 at 0.8).
    ValueError if the trees can't reach the recall. Other columns of docs don't matter.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    prefix = prefix_depth(threshold, recall, trees, depth)
    rows = materialize(slim.mapInArrow(signature_rows(trees, depth, prefix), "doc_id long, shingle_set binary, n int, keys array<long>, bytes binary"))
    some = rows.where("doc_id is not null and shingle_set is not null")
    classes = some.groupBy("shingle_set").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("bytes").alias("bytes"))
    classes = materialize(classes)

    met = classes.select("node", F.posexplode("keys").alias("tree", "key"))
    places = met.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = materialize(met.join(places, "key"))
    cells = groups_of(met.count(), CELL_ROWS)
    marked = met.join(classes.select("node", "n", "bytes"), "node")
    chained = dealt(marked, "key", "size", "node", cells).groupBy("cell").applyInArrow(chain_cell(threshold, recall, trees, depth), "a long, b long")
    families = components(chained)

    roots = families.select(F.col("root").alias("node"), F.col("root").alias("family")).distinct()
    members = materialize(families.select(F.col("a").alias("node"), F.col("root").alias("family")).unionByName(roots))
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("size"))
    members = materialize(members.join(sizes, "family").join(classes.select("node", "shingle_set", "copies"), "node"))
    # A row that repeats an id and a text is read once, or a family would hold it as often.
    again = materialize(rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    single = slim if again.isEmpty() else slim.join(again, "doc_id", "left_anti").unionByName(slim.join(again, "doc_id", "left_semi").dropDuplicates())
    texts = single.join(_few(members), single["doc_id"] == F.col("node")).drop("doc_id")
    cells = groups_of(members.count(), CELL_ROWS // 8)
    links = dealt(texts, "family", "size", "node", cells).groupBy("cell").applyInArrow(verify_cell(threshold), "shingle_set binary, node long, root long, links long, linked_docs long")
    links = materialize(links)
    groups = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("shingle_set").agg(F.sum("links").alias("n_links"), F.sum("linked_docs").alias("n_linked_docs"))

    known = classes.select("shingle_set", "node", "copies").join(counted, "shingle_set", "left").join(groups.withColumnRenamed("a", "node"), "node", "left").where("copies > 1 or n_links > 0 or root is not null")
    found = rows.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("shingle_set")).alias("shingle_set")).join(known, "shingle_set", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.select(
        "doc_id",
        F.coalesce("node", "doc_id").alias("class_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        zero("n_links"),
        zero("n_linked_docs"),
        F.coalesce("root", "node", "doc_id").alias("group_id"),
    )


def keep_one(docs: DataFrame, joined: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of docs that are the least of their group, and those without an id; of equal rows one stays."""
    lost = joined.where("doc_id <> group_id").select(F.col("doc_id").alias("__lost")).distinct()
    left = docs.join(lost, F.col(doc_id) == F.col("__lost"), "left_anti")
    again = joined.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again"))
    if again.isEmpty():
        return left
    once = left.join(again, F.col(doc_id) == F.col("__again"), "left_anti")
    return once.unionByName(left.join(again, F.col(doc_id) == F.col("__again"), "left_semi").dropDuplicates([doc_id, text]))
