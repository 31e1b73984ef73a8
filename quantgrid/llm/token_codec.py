"""Token-id output: canonical length-limited Huffman coding of ids from global counts, in independent blocks.

`tokenize_blocks` encodes texts in ascending doc_id order with a tokenizer of the `tokenizers` library, ends each document
with an id of its own, and keeps blocks of about BLOCK_IDS ids. `write_token_files` counts all ids, derives a canonical code of
at most LIMIT bits and writes each block as a bit stream with a checkpoint (bit offset) every STEP ids, beside the code's
lengths. `read_token_files` reads both back and decodes by one table look-up an id, all runs between checkpoints at once.

File format. `codebook`: Parquet (id int, bits int), ids by canonical order of (bits, id). `blocks`: Parquet (part int,
block int, first: ids of the part before the block, doc_ids: little-endian 64-bit signed, doc_nulls: a byte each, lengths: 32-bit ids of each document, n_ids long,
checkpoints: 16-bit bit lengths of each run of STEP ids, payload: the runs' bits, most significant first).
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete_at_exit, materialize, shared_dir

BLOCK_IDS = 1 << 18
STEP = 64
BROADCAST_PARTS = 100_000
LIMIT = 16
KEPT = 600_000  # pieces that a worker remembers
TOGETHER = 6 << 20  # bytes of text that are cut up together
GROUPS = 16  # strings of 512 pieces that the library encodes in one call
FEW = 8  # added tokens that are looked for in each text
FIRST, WHOLE = "\0", "\0\0"
SPACE = "".join(rf"\x{{{i:x}}}" for i in range(sys.maxunicode + 1) if chr(i).isspace())
#: Parts that show that white space follows white space in their text, or other white space than a space or line end starts it.
UNEVEN = rf"\A\z|[{SPACE}]\z|\A\x00?[{SPACE.replace(r'\x{a}', '')}]|\A\n[{SPACE}]"
MARKED = r"\pL[.,]\z"  # the library never puts a letter and such a mark into one word
MARKS = ".,"
CUT = re.compile(r"(?<=\S)(?=\s)")

_encoders: dict[tuple[str, bool], PieceEncoder] = {}


class PieceEncoder:
    """Encodes texts piece by piece and remembers pieces.

    A byte-level tokenizer never puts a non-space and a following white space into one word. So a text may be cut before white
    space that follows a non-space, and the ids of the pieces, one after the other, are those of the text. The distinct pieces
    of many texts are found together and each is encoded once; the pieces met last and their ids are kept as Arrow arrays. Texts
    that hold a special token's string, and all texts of other tokenizers, are encoded whole.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        rule = str(self.tokenizer.pre_tokenizer)
        self.by_piece = rule.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in rule and self.tokenizer.normalizer is None and len(added) <= FEW
        self.added = added
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # bytes of each token
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        self.pieces, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())
        self.odd, self.met, self.calls = np.zeros(0, bool), np.zeros(0, np.int64), 0  # met: the last call with each piece
        self.marks = [np.array(self.tokenizer.encode(m, add_special_tokens=False).ids, "<u4").tobytes() for m in MARKS]

    @classmethod
    def of(cls, path: str, special_as_text: bool = False) -> PieceEncoder:
        """One encoder a worker."""
        key = path, special_as_text
        if key not in _encoders:
            _encoders[key] = cls(*key)
        return _encoders[key]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, none of them null, and how many of them each text has."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        special = np.full(len(texts), not self.by_piece)
        for token in self.added if self.by_piece else ():
            special |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        # A text's parts: the first after FIRST, others without the space that they start with.
        parts = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(pa.scalar(FIRST, texts.type), texts, pa.scalar("", texts.type)), "\n", " \n"), " ")
        starts = parts.offsets.to_numpy()[:-1] - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        at, (found, odd) = coded.indices.to_numpy(), self.ids_of(coded.dictionary.cast(pa.string()))
        apart = special | (np.maximum.reduceat(odd[at], starts) if odd.any() else False) | pc.match_substring(texts, FIRST).to_numpy(zero_copy_only=False)
        if not apart.any():
            return self.joined(found, at, starts)
        sizes, pieces = np.zeros(len(texts), np.int64), np.repeat(~apart, np.diff(np.append(starts, len(at))))
        rest = np.flatnonzero(~apart)
        plain, sizes[rest] = self.joined(found, at[pieces], np.cumsum(pieces)[starts[rest]] - 1) if len(rest) else (np.zeros(0, np.uint32), sizes[rest])
        own = self.encode_apart([texts[int(i)].as_py() for i in np.flatnonzero(apart)], special[apart])
        sizes[apart] = [len(x) // 4 for x in own]
        out, mine = np.empty(int(sizes.sum()), np.uint32), np.repeat(apart, sizes)
        out[~mine], out[mine] = plain, np.frombuffer(b"".join(own), "<u4")
        return out, sizes

    @staticmethod
    def joined(found: pa.Array, at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the parts `at`, and how many of them belong to each text; texts begin at `starts`."""
        ends, ids = taken(found, at)
        return ids, np.diff(np.append(ends[starts], ends[-1])) // 4

    def ids_of(self, parts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The ids of distinct parts, and which of them are uneven. A full stop or comma after a letter is apart from its stem."""
        marked = _flags(pc.match_substring_regex(parts, MARKED)) & ~_flags(pc.starts_with(parts, FIRST))
        stems = pc.if_else(pa.array(marked), pc.ascii_rtrim(parts, MARKS), parts).dictionary_encode()
        pieces = stems.dictionary
        place = pc.index_in(pieces, value_set=self.pieces)
        lacking = _flags(place.is_null())
        place = place.fill_null(0).to_numpy().astype(np.int64)
        place[lacking] = len(self.pieces) + np.arange(lacking.sum())
        self.calls += 1
        if lacking.any():
            fresh = pieces.filter(pa.array(lacking))
            ids, odd = self._encoded(fresh)
            self.pieces, self.ids = pa.concat_arrays([self.pieces, fresh]), pa.concat_arrays([self.ids, ids])
            self.odd, self.met = np.append(self.odd, odd), np.append(self.met, np.zeros(len(odd), np.int64))
        self.met[place] = self.calls
        stem = place[stems.indices.to_numpy()]
        each = np.cumsum(marked + 1) - marked - 1  # where a part's stem is; its mark comes after it
        at = np.empty(len(parts) + int(marked.sum()), np.int64)
        at[each] = stem
        at[each[marked] + 1] = len(self.ids) + _flags(pc.ends_with(parts, MARKS[1]))[marked]
        ends, ids = taken(pa.concat_arrays([self.ids, pa.array(self.marks, pa.large_binary())]), at)
        found, odd = binaries(np.append(ends[each], ends[-1]), ids), self.odd[stem]
        if len(self.pieces) > KEPT:
            last = np.sort(np.argsort(self.met, kind="stable")[-KEPT * 3 // 4 :])
            self.pieces, self.ids = self.pieces.take(pa.array(last)), self.ids.take(pa.array(last))
            self.odd, self.met = self.odd[last], self.met[last]
        return found, odd

    def encode_apart(self, texts: list[str], whole: np.ndarray) -> list[bytes]:
        """The ids of each text: whole, or cut before each white space after a non-space."""
        out = [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([t for t, w in zip(texts, whole) if w], add_special_tokens=False)]
        pieces = [[WHOLE + x for x in CUT.split(t)] for t, w in zip(texts, whole) if not w]
        distinct = list({x for p in pieces for x in p})
        known = dict(zip(distinct, self.ids_of(pa.array(distinct, pa.string()))[0].to_pylist())).__getitem__
        by_piece = (b"".join(map(known, p)) for p in pieces)
        each = iter(out)
        return [next(each) if w else next(by_piece) for w in whole]

    def _encoded(self, parts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The ids of each part, none of uneven ones, and which of them are uneven."""
        first = _flags(pc.starts_with(parts, FIRST))
        odd = _flags(pc.match_substring_regex(parts, UNEVEN)) & ~_flags(pc.starts_with(parts, WHOLE))
        plain, alone = ~first & ~odd, first & ~odd
        texts = [x.removeprefix(WHOLE if x.startswith(WHOLE) else FIRST) for x in parts.filter(pa.array(alone)).to_pylist()]
        own = [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        found = pa.concat_arrays([self._encode_joined(parts.filter(pa.array(plain))), pa.array([*own, b""], pa.large_binary())])
        place = np.full(len(parts), len(found) - 1)
        place[plain], place[alone] = np.arange(plain.sum()), plain.sum() + np.arange(len(own))
        return found.take(pa.array(place)), odd

    def _encode_joined(self, parts: pa.Array) -> pa.Array:
        """Encode parts in long strings and cut the ids apart by the bytes of their tokens."""
        sizes = pc.binary_length(parts).to_numpy().astype(np.int64) + ~_flags(pc.starts_with(parts, "\n"))
        groups = pa.ListArray.from_arrays(pa.array(np.append(np.arange(0, len(parts), 512), len(parts)), pa.int32()), parts)
        texts = pc.replace_substring(pc.binary_join_element_wise("", pc.binary_join(groups, " "), " "), " \n", "\n")
        ids = [np.zeros(0, np.uint32)]
        for first in range(0, len(texts), GROUPS):
            ids += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts.slice(first, GROUPS).to_pylist(), add_special_tokens=False)]
        whole = np.concatenate(ids)
        ends = np.searchsorted(np.cumsum(self.width[whole]), np.cumsum(sizes)) + 1
        return binaries(4 * np.append(0, ends), whole)


def _flags(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def binaries(ends: np.ndarray, ids: np.ndarray) -> pa.Array:
    """An array of the bytes of ids between each two of `ends`."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])


def taken(found: pa.Array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the entries `at` one after the other, and the bytes before each of them and after the last."""
    some = found.take(pa.array(at))
    ends = np.frombuffer(some.buffers()[1], np.int64)[some.offset : some.offset + len(at) + 1]
    ids = np.frombuffer(some.buffers()[2], "<u4", (ends[-1] - ends[0]) // 4, int(ends[0])) if ends[-1] > ends[0] else np.zeros(0, np.uint32)
    return ends - ends[0], ids


def slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of text, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def block_rows(tokenizer: str, end: int, special_as_text: bool) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, block, part = PieceEncoder.of(tokenizer, special_as_text), 0, None
        held, size, first = [], 0, 0  # (doc_ids, ids, lengths), with end ids
        press = zstandard.ZstdCompressor(level=1)

        def flush() -> pa.RecordBatch:
            docs, ids, lengths = (np.concatenate([h[i] for h in held]) for i in range(3))
            null = np.concatenate([h[3] for h in held])
            wide = ids.astype("<u2") if ids.max() < 1 << 16 else ids.astype("<u4")
            row = {
                "part": [part],
                "block": [block],
                "first": [first],
                "doc_ids": [docs.astype("<i8").tobytes()],
                "doc_nulls": [null.astype(np.uint8).tobytes()],
                "lengths": [lengths.astype("<u4").tobytes()],
                "n_ids": [len(ids)],
                "width": [wide.itemsize],
                "ids": [press.compress(wide.tobytes())],
            }
            return pa.RecordBatch.from_pydict(row, schema=BLOCKS)

        for batch in batches:
            part = batch["part"][0].as_py() if batch.num_rows else part
            for some in slices(batch, TOGETHER):
                ids, n = encoder.encode(pc.fill_null(some["text"], ""))
                ids, n = np.insert(ids, np.cumsum(n), end), n + 1
                docs, null = some["doc_id"].fill_null(0).to_numpy(), some["doc_id"].is_null().to_numpy(zero_copy_only=False)
                ends, at = np.cumsum(n), 0
                while at < len(n):  # a block is full with the text that reaches BLOCK_IDS
                    done = ends[at - 1] if at else 0
                    to = min(len(n), int(np.searchsorted(ends, done + BLOCK_IDS - size)) + 1)
                    held.append((docs[at:to], ids[done : ends[to - 1]], n[at:to], null[at:to]))
                    size += int(ends[to - 1] - done)
                    at = to
                    if size >= BLOCK_IDS:
                        yield flush()
                        held, size, block, first = [], 0, block + 1, first + size
        if held:
            yield flush()

    return rows


BLOCKS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.binary()), ("doc_nulls", pa.binary()), ("lengths", pa.binary()), ("n_ids", pa.int64()), ("width", pa.int32()), ("ids", pa.binary())])
FILE = "part int, block int, first long, doc_ids binary, doc_nulls binary, lengths binary, n_ids long, checkpoints binary, payload binary"


def tokenize_blocks(docs: DataFrame, tokenizer: str, *, end: int = 0, special_as_text: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of ids in ascending order of (doc_id, hash of the text, text), null ids first; part and block number them in this order.

    A null or empty text has its end id alone. A text is never split over blocks. The string of a special token in a text gives
    that token, as the tokenizer does by itself, unless special_as_text makes it ordinary text. Rows that repeat an id, null ids
    among them, are spread by their texts' hashes, so that no task gets them all.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    placed = slim.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").withColumn("part", F.spark_partition_id())
    return materialize(placed.select("doc_id", "text", "part").mapInArrow(block_rows(tokenizer, end, special_as_text), "part int, block int, first long, doc_ids binary, doc_nulls binary, lengths binary, n_ids long, width int, ids binary"))


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol of a shortest code of at most `limit` bits (package-merge); the limit grows if it is too small."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    limit = max(limit, (n - 1).bit_length())
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    level, marks = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([leaves, pairs])
        by = np.argsort(merged, kind="stable")
        level = merged[by]
        marks.append(by < n)
    bits, take = np.zeros(n, np.int64), 2 * (n - 1)
    for mark in reversed(marks):
        used = int(mark[:take].sum())
        bits[:used] += 1
        take = 2 * (take - used)
    out = np.empty(n, np.int64)
    out[order] = bits
    return out


def canonical(ids: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids and bits by (bits, id), and their codes."""
    order = np.lexsort((ids, bits))
    ids, bits = ids[order], bits[order]
    top = int(bits[-1]) if len(bits) else 0
    step = np.int64(1) << (top - bits)
    return ids, bits, (np.cumsum(step) - step) >> (top - bits)


class Codec:
    """Coder and decoder of one codebook."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        ids, bits, codes = canonical(ids, bits)
        self.top = int(bits[-1]) if len(bits) else 1
        size = int(ids.max()) + 1 if len(ids) else 1
        self.code, self.bits = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.code[ids], self.bits[ids] = codes, bits
        span = np.int64(1) << (self.top - bits)
        self.table_id = np.zeros(1 << self.top, np.uint32)
        self.table_bits = np.ones(1 << self.top, np.int64)
        filled = int(span.sum())
        self.table_id[:filled], self.table_bits[:filled] = np.repeat(ids, span), np.repeat(bits, span)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """The bit stream, and the bits of each run of STEP ids."""
        bits = self.bits[ids]
        end = np.cumsum(bits)
        total = int(end[-1]) if len(end) else 0
        out = np.zeros(total // 64 + 2, np.uint64)
        if total:  # each 64-bit word is the sum of the codes that start in it and of what the word before leaves over
            start = end - bits
            word, over = start >> 6, (start & 63) + bits - 64
            code = self.code[ids].view(np.uint64)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            last = np.append(first[1:], len(ids)) - 1
            out[word[first]] = np.add.reduceat(np.where(over > 0, code >> np.maximum(over, 0).view(np.uint64), code << np.maximum(-over, 0).view(np.uint64)), first)
            last = last[over[last] > 0]
            out[word[last] + 1] += code[last] << (64 - over[last]).view(np.uint64)
        runs = np.add.reduceat(bits, np.arange(0, len(ids), STEP)) if len(ids) else bits
        return out.astype(">u8").tobytes()[: -(-total // 8)], runs.astype("<u2").tobytes()

    def decode(self, payload: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        runs = np.frombuffer(checkpoints, "<u2").astype(np.int64)
        at = np.cumsum(runs) - runs
        data = np.frombuffer(payload + b"\0" * 4, np.uint8).astype(np.int64)
        window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        out = np.zeros((len(runs), STEP), np.uint32)
        last = n - (len(runs) - 1) * STEP if len(runs) else 0
        mask, shift = (1 << self.top) - 1, 32 - self.top
        for i in range(STEP):
            live = len(runs) if i < last else len(runs) - 1
            if live <= 0:
                break
            here = at[:live]
            spot = (window[here >> 3] >> (shift - (here & 7))) & mask
            out[:live, i] = self.table_id[spot]
            at[:live] += self.table_bits[spot]
        return out.reshape(-1)[:n]


def _ids(row: dict) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(row["ids"]), "<u2" if row["width"] == 2 else "<u4")


def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1, np.int64)
    for batch in batches:
        for row in batch.to_pylist():
            new = np.bincount(_ids(row))
            if len(new) > len(total):
                total, new = new, total
            total[: len(new)] += new
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["id", "n"])


def coded_rows(ids: np.ndarray, bits: np.ndarray) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ids, bits)
        for batch in batches:
            for row in batch.to_pylist():
                payload, runs = codec.encode(_ids(row))
                out = {k: [row[k]] for k in ("part", "block", "first", "doc_ids", "doc_nulls", "lengths", "n_ids")} | {"checkpoints": [runs], "payload": [payload]}
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([*list(BLOCKS)[:7], ("checkpoints", pa.binary()), ("payload", pa.binary())]))

    return rows


def write_token_files(blocks: DataFrame, path: str) -> None:
    """Write the blocks of tokenize_blocks under path. The driver sees one count for each id of the vocabulary."""
    spark = blocks.sparkSession
    counts = blocks.select("ids", "width").mapInArrow(count_rows, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    ids = counts["id"].to_numpy(np.int64)
    bits = code_lengths(counts["n"].to_numpy(np.int64))
    book = [(int(i), int(b)) for i, b in zip(ids, bits)]
    spark.createDataFrame(book, "id int, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    blocks.mapInArrow(coded_rows(ids, bits), FILE).write.option("compression", "none").parquet(f"{path}/blocks")


def decoded_rows(ids: np.ndarray, bits: np.ndarray) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ids, bits)
        for batch in batches:
            for row in batch.to_pylist():
                found = codec.decode(row["payload"], row["checkpoints"], row["n_ids"]).astype("<u4")
                size = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(size)
                raw = found.tobytes()
                each = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), size.tolist())]
                null = np.frombuffer(row["doc_nulls"], np.uint8).astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(size), row["part"]), pa.int32()),
                        pa.array(np.frombuffer(row["doc_ids"], "<i8"), pa.int64(), mask=null),
                        pa.array(row["first"] + ends - size, pa.int64()),
                        pa.array(size, pa.int64()),
                        pa.array(each, pa.binary()),
                    ],
                    ["part", "doc_id", "offset", "n_tokens", "ids"],
                )

    return rows


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents under path; start counts the ids of all documents before it."""
    book = spark.read.parquet(f"{path}/codebook").toPandas()
    blocks = spark.read.parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("part", before.alias("before"))
    if parts.count() <= BROADCAST_PARTS:  # a row for each task that wrote
        starts = F.broadcast(starts)
    docs = blocks.mapInArrow(decoded_rows(book["id"].to_numpy(np.int64), book["bits"].to_numpy(np.int64)), "part int, doc_id long, offset long, n_tokens long, ids binary")
    start = F.col("before") + F.col("offset")
    return docs.join(starts, "part").select("doc_id", start.alias("start"), "n_tokens", "ids")


def encode_corpus(docs: DataFrame, tokenizer: str, *, end: int = 0, special_as_text: bool = False, path: str | None = None) -> DataFrame:
    """Tokenize, write the files under path and read them back.

    Without a path they go to a new folder of the shared one, which is deleted when the driver's JVM ends.
    """
    spark = docs.sparkSession
    if path is None:
        path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
        delete_at_exit(spark, path)
    write_token_files(tokenize_blocks(docs, tokenizer, end=end, special_as_text=special_as_text), path)
    return read_token_files(spark, path)

