"""Fill-in-the-middle transformation of documents, by an index of the distinct texts.

Texts travel compressed (zstandard; equal texts give equal bytes). They are grouped by SHA-256 and compared within the group,
so that the index holds each content once, with the ends of its lines as an Elias-Fano list. Documents (id and digest alone)
are joined to the index, and each selects its two seeded cuts from the list. A text of many copies is dealt: its documents go
to as many cells as they need at COPIES a cell, and its index row to each of these.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import materialize

LEVEL = 6  # of compression: texts travel twice, to be grouped and to meet their documents
COPIES = 4096  # documents of one text that a cell holds
MARKS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle
SCAN = 1 << 24  # bytes searched for line ends at once
INDEX = "digest binary, cells int, packed binary, n long, shift int, low binary, high binary"
ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)


def line_ends(text: bytes) -> np.ndarray:
    """Byte offsets after each line; a line ends after its newline, the last one at the end of the text."""
    raw = np.frombuffer(text, np.uint8)
    found = [np.flatnonzero(raw[i : i + SCAN] == 10) + (i + 1) for i in range(0, len(raw), SCAN)]
    if len(raw) and raw[-1] != 10:
        found.append(np.array([len(raw)]))
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


def elias_fano(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """An ascending list as (shift, low, high): the `shift` low bits of each value side by side, and the rest in unary."""
    n = len(values)
    shift = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
    low = (values[:, None] >> np.arange(shift)) & 1
    high = np.zeros(n + (int(values[-1]) >> shift) + 1 if n else 0, np.uint8)
    high[(values >> shift) + np.arange(n)] = 1
    return shift, np.packbits(low.astype(np.uint8), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()


def select(i: int, shift: int, low: bytes, high: bytes) -> int:
    """Value i of an Elias-Fano list: the place of one-bit i of the high part, and its low bits."""
    bits = np.frombuffer(high, np.uint8)
    upto = np.cumsum(ONES[bits])
    byte = int(np.searchsorted(upto, i, side="right"))
    rest, value = i - int(upto[byte] - ONES[bits[byte]]), int(bits[byte])
    for _ in range(rest):
        value &= value - 1
    top = byte * 8 + (value & -value).bit_length() - 1 - i
    first, last = i * shift, (i + 1) * shift
    word = int.from_bytes(low[first // 8 : (last + 7) // 8], "little") >> (first % 8)
    return (top << shift) | (word & ((1 << shift) - 1))


def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, packed) of (digest, text)."""
    press = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        packed = [press.compress(t.as_buffer()) for t in batch.column(1)]
        yield pa.record_batch([batch.column(0), pa.array(packed, pa.binary())], names=["digest", "packed"])


def index_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the lines of each distinct text, as an Elias-Fano list."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        ends = [line_ends(unpack.decompress(p.as_buffer())) for p in batch.column(2)]
        lists = [elias_fano(e) for e in ends]
        new = [pa.array([len(e) for e in ends], pa.int64()), pa.array([x[0] for x in lists], pa.int32()), *(pa.array([x[i] for x in lists], pa.binary()) for i in (1, 2))]
        yield pa.record_batch([*batch.columns, *new], names=[*batch.schema.names, "n", "shift", "low", "high"])


def cut_texts(batches: Iterator[pa.RecordBatch], seed: int, rate: int, spm: int) -> Iterator[pa.RecordBatch]:
    """The cut texts of (doc_id, seeded, packed, n, shift, low, high); seeded is the id in decimal digits."""
    unpack = zstandard.ZstdDecompressor()
    marks = [m.encode() for m in MARKS]
    for batch in batches:
        first = batch.num_columns - 6
        out: dict[str, list] = {"form": [], "prefix_chars": [], "middle_chars": [], "output": []}
        key, text, marked = None, b"", False
        for row, (doc, packed, n, shift, low, high) in enumerate(zip(*(batch.column(i) for i in range(first, batch.num_columns)))):
            if packed != key:
                key, text = packed, unpack.decompress(packed.as_buffer())
                marked = any(m in text for m in marks)
            digest = hashlib.sha256(b"%d:%s" % (seed, (doc.as_py() or "").encode())).hexdigest()
            h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
            if not text or marked or h[2] % 100 >= rate:
                for name, value in zip(out, ("plain", None, None, text)):
                    out[name].append(value)
                continue
            n, where = n.as_py(), (shift.as_py(), low.as_py(), high.as_py())
            a, b = (select(u - 1, *where) if u else 0 for u in sorted((h[0] % (n + 1), h[1] % (n + 1))))
            p, m, s = text[:a], text[a:b], text[b:]
            spm_form = h[3] % 100 < spm
            parts = (marks[1], s, marks[0], p, marks[2], m) if spm_form else (marks[0], p, marks[1], s, marks[2], m)
            for name, value in zip(out, ("spm" if spm_form else "psm", len(p.decode()), len(m.decode()), b"".join(parts))):
                out[name].append(value)
        types = (pa.string(), pa.int64(), pa.int64(), pa.binary())
        yield pa.record_batch([*batch.columns[:first], batch.column(first + 2), *(pa.array(v, t) for v, t in zip(out.values(), types))], names=[*batch.schema.names[:first], "n", *out])


def restored(output: Column, form: Column) -> Column:
    """The exact text that an output was made of. Pieces hold no marks, so the output falls apart at the marks alone."""
    p, s, m = MARKS
    psm = F.split(F.substring(output, len(p) + 1, 2**31 - 1), f"{s}|{m}", 3)  # prefix, suffix, middle
    spm = F.split(F.substring(output, len(s) + 1, 2**31 - 1), f"{p}|{m}", 3)  # suffix, prefix, middle
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)


def fill_middle(docs: DataFrame, *, seed: int = 7, rate: int = 100, spm: int = 50, doc_id: str = "doc_id", text: str = "text", copies: int = COPIES) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): each text cut at two seeded line boundaries and put in order.

    n counts lines (`[^\\n]*\\n|[^\\n]+`). rate and spm are percentages: of documents cut at all, and of those in which the suffix
    comes first. A null text is empty; empty texts and those that hold a mark stay as they are (form plain, null chars). A
    null id is cut as an empty one. Rows that repeat an id have a row each. Other columns don't matter; chars are code points.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    slim = source.select("doc_id", "digest")
    # Of known size once written, so that Spark can choose how to join it; at most one row for every `copies` documents.
    hot = materialize(slim.groupBy("digest").count().where(F.col("count") > copies).select("digest", F.ceil(F.col("count") / copies).cast("int").alias("cells")))
    asked = slim.join(hot, "digest", "left").withColumn("cell", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("cells")).cast("int"), F.lit(0))).select("doc_id", "digest", "cell")
    packed = source.select("digest", "text").mapInArrow(pack_texts, "digest binary, packed binary")
    # collect_set compares contents; equal digests of unlike contents would stop the job instead of giving one the other's text.
    alike = packed.groupBy("digest").agg(F.collect_set("packed").alias("texts"), F.count(F.lit(1)).alias("count"))
    only = F.when(F.size("texts") == 1, F.col("texts")[0]).otherwise(F.raise_error(F.lit("two texts of one SHA-256")).cast("binary"))
    index = alike.select("digest", F.ceil(F.col("count") / copies).cast("int").alias("cells"), only.alias("packed")).mapInArrow(index_texts, INDEX)
    dealt = index.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    met = asked.join(dealt, ["digest", "cell"]).select("doc_id", F.col("doc_id").cast("string").alias("seeded"), "packed", "n", "shift", "low", "high")
    fields = [StructField("doc_id", source.schema["doc_id"].dataType), StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", BinaryType())]
    return met.mapInArrow(partial(cut_texts, seed=seed, rate=rate, spm=spm), StructType(fields)).withColumn("output", F.col("output").cast("string"))
