"""Exact top-k search by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks of bounded size; each block sorts one list per dimension. The queries read the lists in
parallel from their ends, score what they meet, and stop once the bound on all unread rows is below their kth score. Blocks meet
queries in chunks, so that no task sees all of either; the best k of all blocks are merged at the end. Each row travels once
for every chunk and each query once for every block. Both grow with the input up to MOST rows, so that what is shuffled is
rows * queries * (1 / block + 1 / chunk) vectors of 4 bytes a component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import groups_of, materialize

BLOCK_ROWS, QUERY_ROWS = 4096, 1024  # of small inputs
MOST = 65_536  # rows of a block, and of a chunk
SPREAD = 64  # blocks, and chunks, that an input has before these grow beyond their least size
CELLS = 1 << 22  # scores that a task holds at once
FIRST_DEPTH = 16
FOUND = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.int64()), ("n_read", pa.int64())])


def quantized(vector: Column) -> Column:
    """floor(256 * x) of each component; null if the vector is null or has a null or non-finite component."""
    x = F.transform(vector, lambda v: v.cast("double"))
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(good, F.transform(x, lambda v: F.floor(v * 256).cast("long")))


def threshold_search(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each query the places of its k best rows of a block, ties to smaller ids, and how many rows it read.

    own: the place of the query's own row, which takes no part, or -1. All queries read the lists together, twice as deep in
    each round: of each list those ends that some query still at work has weight for. A query leaves when its bound on the
    rows that nobody has met is below its kth score (at an equal bound, such a row could still tie).
    """
    n = len(rows)
    order = np.argsort(rows, axis=0, kind="stable")
    dims = np.arange(rows.shape[1])
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    met, places = np.zeros(n, bool), np.zeros(0, np.int64)
    scores, active = np.zeros((len(queries), 0)), np.arange(len(queries))
    out: list[np.ndarray] = [places] * len(queries)
    read = np.zeros(len(queries), np.int64)
    depth = min(FIRST_DEPTH, n)
    while len(active):
        if 2 * depth >= n:
            new = np.flatnonzero(~met)
        else:
            high, low = up[active].any(0), down[active].any(0)
            ends = np.unique(np.concatenate([order[:depth, low].ravel(), order[n - depth :, high].ravel()]))
            new = ends[~met[ends]]
        met[new] = True
        fresh = queries[active] @ rows[new].T
        mine = np.searchsorted(new, own[active])
        hit = np.flatnonzero((mine < len(new)) & (own[active] >= 0))
        hit = hit[new[mine[hit]] == own[active][hit]]
        fresh[hit, mine[hit]] = -np.inf
        places = np.concatenate([places, new])
        scores = np.concatenate([scores, fresh], 1)
        done = np.full(len(active), met.all())
        kth = np.full(len(active), -np.inf)
        if len(places) >= k:
            kth = np.partition(scores, len(places) - k, axis=1)[:, len(places) - k]
        if not met.all():
            bound = up[active] @ rows[order[n - depth], dims] + down[active] @ rows[order[depth - 1], dims]
            done = bound < kth
        for i in np.flatnonzero(done):
            best = np.flatnonzero((scores[i] >= kth[i]) & (scores[i] > -np.inf))
            out[active[i]] = places[best[np.lexsort((ids[places[best]], -scores[i][best]))[:k]]]
        read[active] = len(places)
        active, scores = active[~done], scores[~done]
        depth *= 2
    return out, read


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)


def search_block(k: int):
    def search(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not candidates.num_rows or not queries.num_rows:
            return FOUND.empty_table()
        candidates = candidates.sort_by("row")
        rows, ids, row = _matrix(candidates["vec"], candidates.num_rows), candidates["id"].to_numpy(), candidates["row"].to_numpy()
        asked, name, query = _matrix(queries["vec"], queries.num_rows), queries["id"].to_numpy(), queries["row"].to_numpy()
        at = np.minimum(np.searchsorted(row, query), len(row) - 1)
        own = np.where(row[at] == query, at, -1)
        parts = []
        some = max(16, CELLS // len(rows))
        for i in range(0, len(query), some):
            best, read = threshold_search(rows, ids, asked[i : i + some], own[i : i + some], k)
            who, place = i + np.repeat(np.arange(len(best)), [len(x) for x in best]), np.concatenate(best)
            scores = np.einsum("ij,ij->i", rows[place], asked[who]).astype(np.int64)
            parts.append(pa.table([query[who], name[who], ids[place], row[place], scores, read[who - i]], schema=FOUND))
        return pa.concat_tables(parts)

    return search


def exact_topk(vectors: DataFrame, is_query: Column, *, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows by integer inner product, ties to smaller ids.

    Null ids and vectors that are null, empty or hold null or non-finite components take no part. Rows that repeat an id are
    candidates each, and queries each: then a query_id has as many rows of a rank. Vectors of different lengths never meet.
    ValueError if sums could reach 2**53, from where they aren't exact. Other columns don't matter.
    """
    clean = materialize(
        vectors.select(F.col(vec_id).cast("long").alias("id"), quantized(F.col(embedding)).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("query"))
        .where("id is not null and vec is not null and size(vec) > 0")
        .select(F.monotonically_increasing_id().alias("row"), "id", "vec", "query", F.size("vec").alias("dim"))
    )
    largest = F.max(F.col("dim") * F.pow(F.greatest(F.array_max("vec"), -F.array_min("vec")).cast("double"), 2))
    sizes = clean.agg(F.count(F.lit(1)).alias("n"), F.count_if("query").alias("q"), largest.alias("sum")).first()
    if (sizes["sum"] or 0) >= 2.0**53:
        raise ValueError("components are too large for exact sums")
    size = lambda rows, least: min(MOST, max(least, rows // SPREAD))
    blocks, chunks = groups_of(sizes["n"], size(sizes["n"], BLOCK_ROWS)), groups_of(sizes["q"], size(sizes["q"], QUERY_ROWS))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    chunk = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(chunks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    small = F.col("vec").cast("array<int>")  # of at most 27 bits each
    columns = lambda: [F.col("row").alias("row"), F.col("id").alias("id"), small.alias("vec"), F.col("dim").alias("dim")]
    candidates = clean.select(*columns(), block.alias("block"), every(chunks).alias("chunk"))
    queries = clean.where("query").select(*columns(), every(blocks).alias("block"), chunk.alias("chunk"))
    key = ["dim", "block", "chunk"]
    found = candidates.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(search_block(k), "query long, query_id long, vec_id long, row long, score long, n_read long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
