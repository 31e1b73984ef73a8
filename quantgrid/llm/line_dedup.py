"""Line dedup: a sharded minimal perfect hash over line hashes indexes fingerprint and count arrays.

Lines are counted by 128-bit hashes of their keys. The distinct hashes that reach the threshold are dealt into shards; each
shard builds a minimal perfect hash (levels of bit arrays, one rank each) that indexes arrays of fingerprints, counts and
keepers. Documents send each hash of their lines once, to its shard, and get back those that they lose; no line text is ever
joined or shuffled. A shard that more hashes go to than PART_LINES is copied to as many parts, and its documents are dealt over these.
So what is shuffled grows with the lines, and no common line gathers in a task.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import SPACES, groups_of, materialize

SHARD_LINES = 50_000
PART_LINES = 100_000  # hashes that probe one copy of a shard
NOBODY = -(1 << 63)  # stands for a null doc_id
MINE = ("n_lines", "n_dropped")


def line_keys(text: bytes, min_chars: int) -> list[bytes]:
    """For each line the 16-byte hash of its key, or b"" where the key is shorter than min_chars code points."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip(SPACES.encode()).lower()  # bytes: ASCII letters alone
        short = len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars)
        out.append(b"" if short else xxhash.xxh3_128_digest(key))
    return out


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class LineIndex:
    """A minimal perfect hash with its arrays. Words of 64 bits stand for keys in pairs (a, b)."""

    def __init__(self, levels: list[np.ndarray], prints: np.ndarray, counts: np.ndarray, keepers: np.ndarray):
        self.levels, self.prints, self.counts, self.keepers = levels, prints, counts, keepers
        self.ranks = [np.cumsum(x, dtype=np.int64) for x in levels]
        self.bases = np.cumsum([0, *(int(r[-1]) for r in self.ranks)])

    @staticmethod
    def spot(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(a ^ mix64(b + np.uint64(level))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> LineIndex:
        levels, left = [], np.arange(len(a))
        while len(left):
            size = max(64, 2 * len(left))
            at = cls.spot(a[left], b[left], len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        index = cls(levels, np.zeros(len(a), np.uint64), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64))
        at = index.find(a, b)
        index.prints[at], index.counts[at], index.keepers[at] = b, counts, keepers
        return index

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The index of each key; any index or -1 for keys that were not built in."""
        out, left = np.full(len(a), -1), np.arange(len(a))
        for n, (level, rank) in enumerate(zip(self.levels, self.ranks)):
            at = self.spot(a[left], b[left], n, len(level))
            hit = level[at]
            out[left[hit]] = self.bases[n] + rank[at[hit]] - 1
            left = left[~hit]
        return out

    def probe(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The index of each key, -1 where the fingerprint differs."""
        at = self.find(a, b)
        return np.where((at >= 0) & (self.prints[at] == b), at, -1) if len(self.prints) else np.full(len(a), -1)

    def dump(self) -> bytes:
        file = io.BytesIO()
        bits = {f"bits{i}": np.packbits(x) for i, x in enumerate(self.levels)}
        np.savez(file, sizes=[len(x) for x in self.levels], prints=self.prints, counts=self.counts.astype(np.uint32), keepers=self.keepers, **bits)
        return file.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> LineIndex:
        z = np.load(io.BytesIO(raw))
        levels = [np.unpackbits(z[f"bits{i}"], count=n).astype(bool) for i, n in enumerate(z["sizes"].astype(int))]
        return cls(levels, z["prints"], z["counts"], z["keepers"])


def _ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.fill_null(NOBODY).to_numpy(zero_copy_only=False).astype(np.int64)


def line_rows(min_chars: int) -> Callable:
    """(a, b, doc_id) for each distinct long line of each (doc_id, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [{*line_keys(t, min_chars)} - {b""} for t in texts_of(batch["text"])]
            words = np.frombuffer(b"".join(h for x in found for h in x), "<i8").reshape(-1, 2)
            ids = batch["doc_id"].take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found])))
            yield pa.RecordBatch.from_arrays([pa.array(words[:, 0]), pa.array(words[:, 1]), ids], ["a", "b", "doc_id"])

    return rows


def probe_rows(min_chars: int, parts: np.ndarray) -> Callable:
    """(shard, part, doc_id, tie, keys) for each document and shard that its long lines belong to; a shard has parts[shard] parts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, tie, text in zip(batch["doc_id"].to_pylist(), batch["tie"].to_pylist(), texts_of(batch["text"])):
                words = np.frombuffer(b"".join(sorted({*line_keys(text, min_chars)} - {b""})), "<u8").reshape(-1, 2)
                home = words[:, 0] % np.uint64(len(parts))
                salt = int(mix64(np.array([((doc or 0) ^ tie) % (1 << 64)], np.uint64))[0])
                out += [(int(s), salt % int(parts[s]), doc, tie, words[home == s].tobytes()) for s in np.unique(home)]
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["shard", "part", "doc_id", "tie", "keys"])

    return rows


def build_shard(lines: pa.Table) -> pa.Table:
    a, b = (lines[c].to_numpy().astype(np.int64).view(np.uint64) for c in "ab")
    index = LineIndex.build(a, b, lines["n"].to_numpy(), _ids(lines["keeper"].combine_chunks()))
    return pa.table({"shard": pa.array([lines["shard"][0].as_py()], pa.int32()), "index": pa.array([index.dump()], pa.binary())})


def probe_shard(probes: pa.Table, shards: pa.Table) -> pa.Table:
    """(doc_id, tie, lost): the keys that each document loses."""
    kinds = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("lost", pa.binary())])
    if not probes.num_rows or not shards.num_rows:
        return kinds.empty_table()
    index = LineIndex.load(shards["index"][0].as_py())
    raw = probes["keys"].to_pylist()
    words = np.frombuffer(b"".join(raw), "<u8").reshape(-1, 2)
    doc = np.repeat(np.arange(len(raw)), [len(x) // 16 for x in raw])
    at = index.probe(words[:, 0], words[:, 1])
    lost = (at >= 0) & (index.keepers[at] != _ids(probes["doc_id"].combine_chunks())[doc])
    words, doc = words[lost], doc[lost]
    rows, first = np.unique(doc, return_index=True)
    parts = [x.tobytes() for x in np.split(words, first[1:])] if len(rows) else []
    return pa.table([*(probes[c].combine_chunks().take(pa.array(rows)) for c in ("doc_id", "tie")), pa.array(parts, pa.binary())], schema=kinds)


def drop_lines(text: str, min_chars: int, names: tuple[str, str]) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, counts = [], []
            for raw, lost in zip(texts_of(batch[text]), batch["__lost"].to_pylist()):
                lines = raw.split(b"\n")
                gone = {x[i : i + 16] for x in lost or [] for i in range(0, len(x), 16)}
                stay = [line for line, key in zip(lines, line_keys(raw, min_chars)) if key not in gone] if gone else lines
                kept.append(b"\n".join(stay).decode())
                counts.append((len(lines), len(lines) - len(stay)))
            n = batch.schema.get_field_index(text)
            batch = batch.set_column(n, pa.field(text, pa.string()), pa.array(kept, pa.string())).drop_columns(["__lost"])
            for i, name in enumerate(names):
                batch = batch.append_column(name, pa.array([c[i] for c in counts], pa.int64()))
            yield batch

    return rows


def count_lines(docs: DataFrame, *, min_chars: int = 40) -> DataFrame:
    """(a, b, n, keeper): hash, rows and largest doc_id of each line key of enough code points."""
    lines = docs.select("doc_id", "text").mapInArrow(line_rows(min_chars), "a long, b long, doc_id long")
    return lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))


def dedup_lines(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5, doc_id: str = "doc_id", text: str = "text", names: tuple[str, str] = MINE) -> DataFrame:
    """Drop lines that many documents share from all but the one of the largest id; add their numbers, n_lines and n_dropped.

    A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. Keys of at least min_chars code
    points found in at least min_docs rows lose all their lines but those of the largest doc_id that holds them. Null texts
    count as empty: one empty line. Rows of a null id lose such lines unless only such rows hold them; rows that repeat an id
    are separate documents with one fate. Columns called as `names` are replaced, others stay.
    """
    docs = docs.drop(*names)
    tie = F.xxhash64(F.col(text))  # with the id it tells rows apart, null ids too
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), tie.alias("tie"), F.col(text).alias("text"))
    seen = Observation()
    counted = count_lines(slim, min_chars=min_chars).observe(seen, F.coalesce(F.sum("n"), F.lit(0)).alias("lines"))
    repeated = materialize(counted.where(F.col("n") >= min_docs))
    shards = groups_of(repeated.count(), SHARD_LINES)
    # unsigned remainder, as numpy takes it
    home = F.expr(f"cast((pmod(a, {shards}) + if(a < 0, pmod(pmod(9223372036854775807, {shards}) * 2 + 2, {shards}), 0)) % {shards} as int)")
    repeated = repeated.withColumn("shard", home)
    parts = np.full(shards, groups_of(seen.get["lines"] // shards, PART_LINES), np.int64)
    for r in repeated.groupBy("shard").agg(F.sum("n").alias("n")).where(F.col("n") > PART_LINES).collect():  # a row a shard at most
        parts[r["shard"]] += r["n"] // PART_LINES
    index = repeated.groupBy("shard").applyInArrow(build_shard, "shard int, index binary")
    copies = docs.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(parts)], "shard int, parts int")  # a row a shard
    index = index.join(F.broadcast(copies), "shard").select("shard", "index", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    probes = slim.mapInArrow(probe_rows(min_chars, parts), "shard int, part int, doc_id long, tie long, keys binary")
    lost = probes.groupBy("shard", "part").cogroup(index.groupBy("shard", "part")).applyInArrow(probe_shard, "doc_id long, tie long, lost binary")
    lost = lost.groupBy(F.col("doc_id").alias("__doc"), F.col("tie").alias("__tie")).agg(F.collect_set("lost").alias("__lost"))
    joined = docs.join(lost, F.col(doc_id).eqNullSafe(F.col("__doc")) & (tie == F.col("__tie")), "left").drop("__doc", "__tie")
    fields = ", ".join(f"`{f.name}` {'string' if f.name == text else f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(drop_lines(text, min_chars, names), f"{fields}, `{names[0]}` long, `{names[1]}` long")
