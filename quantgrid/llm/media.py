"""Media columns: ISO base media containers kept in a binary column.

`pack_media` stores a byte payload as an audio track of unsigned 8-bit samples (codec ``raw ``) in a container of
ftyp, moov and mdat boxes. `probe_media` walks the nested boxes of any such container, decodes the sample tables
(stsd, mdhd, stts, stss, stsz, stsc, stco/co64) and returns codec, duration and the byte ranges of the key frames; it
never decodes a payload. `read_payload` returns the bytes that the sample tables point to.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = 192  # bytes of an access unit
KEY_EVERY = 16  # access units from one key frame to the next; also the units of a chunk
RATE = 8000  # samples a second
CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex")
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)

PROBE = "codec string, timescale long, duration long, n_units long, keyframes array<struct<start:long,end:long>>, error string"


class Track(NamedTuple):
    codec: str
    timescale: int
    duration: int
    offsets: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    size = len(body) + 8
    return (struct.pack(">I4s", size, kind) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8)) + body


def full(kind: bytes, *parts: bytes) -> bytes:
    return box(kind, b"\0\0\0\0", *parts)


def pad(raw: bytes) -> bytes:
    """Spaces up to a positive multiple of UNIT."""
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")


def container(payload: bytes) -> bytes:
    """The payload, a positive multiple of UNIT bytes, as one track of 8-bit samples."""
    units = len(payload) // UNIT
    chunks, rest = divmod(units, KEY_EVERY)
    runs = ([(1, KEY_EVERY, 1)] if chunks else []) + ([(chunks + 1, rest, 1)] if rest else [])
    keys = range(1, units + 1, KEY_EVERY)
    entry = box(b"raw ", b"\0" * 6, struct.pack(">H", 1), b"\0" * 8, struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))

    def moov(base: int) -> bytes:
        offsets = base + np.arange(len(keys), dtype=np.int64) * (UNIT * KEY_EVERY)
        wide = base + len(payload) >= 1 << 32
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, units, UNIT)),
            full(b"stss", struct.pack(">I", len(keys)), np.asarray(keys, ">u4").tobytes()),
            full(b"stsz", struct.pack(">II", UNIT, units)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"co64" if wide else b"stco", struct.pack(">I", len(keys)), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        head = struct.pack(">IIII", 0, 0, RATE, len(payload))
        return box(
            b"moov",
            full(b"mvhd", head, struct.pack(">IH", 0x10000, 0x100), b"\0" * 10, MATRIX, b"\0" * 24, struct.pack(">I", 2)),
            box(
                b"trak",
                full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, len(payload)), b"\0" * 8, struct.pack(">HHHH", 0, 0, 0x100, 0), MATRIX, b"\0" * 8),
                box(
                    b"mdia",
                    full(b"mdhd", head, struct.pack(">HH", 0x55C4, 0)),
                    full(b"hdlr", b"\0" * 4, b"soun", b"\0" * 13),
                    box(b"minf", full(b"smhd", b"\0" * 4), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url "))), stbl),
                ),
            ),
        )

    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    base = len(ftyp) + len(moov(0)) + (8 if len(payload) + 8 < 1 << 32 else 16)
    return ftyp + moov(base) + box(b"mdat", payload)


def walk(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first byte, end) of each box body from start to end, those in containers too, however deep; ValueError on a bad size."""
    open_ = [(start, end)]
    while open_:
        start, end = open_.pop()
        if start >= end:
            continue
        if end - start < 8:
            raise ValueError("truncated box header")
        length, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if length == 1:
            if end - start < 16:
                raise ValueError("truncated box header")
            (length,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif length == 0:
            length = end - start
        if length < head or start + length > end:
            raise ValueError(f"bad size of box {kind!r}")
        yield kind, start + head, start + length
        open_.append((start + length, end))
        if kind in CONTAINERS:
            open_.append((start + head, start + length))


def numbers(data: bytes, at: int, end: int, kind: str, count: int) -> np.ndarray:
    if at + count * np.dtype(kind).itemsize > end:
        raise ValueError("truncated table")
    return np.frombuffer(data, kind, count, at).astype(np.int64)


def tracks(data: bytes) -> list[Track]:
    """The tracks of a container, their sample tables decoded."""
    found: list[dict] = []
    for kind, at, end in walk(data, 0, len(data)):
        if kind == b"trak":
            found.append({})
        elif found and kind in (b"mdhd", b"stsd", b"stts", b"stss", b"stsz", b"stsc", b"stco", b"co64"):
            found[-1][kind] = (at, end)
    return [decode(data, boxes) for boxes in found]


def decode(data: bytes, boxes: dict[bytes, tuple[int, int]]) -> Track:
    def rows(kind: bytes, width: int, item: str = ">u4") -> np.ndarray:
        at, end = boxes[kind]
        count = int(numbers(data, at + 4, end, ">u4", 1)[0])
        return numbers(data, at + 8, end, item, count * width).reshape(count, width)

    missing = [k.decode() for k in (b"mdhd", b"stsd", b"stts", b"stsz", b"stsc") if k not in boxes]
    if missing or not {b"stco", b"co64"} & boxes.keys():
        raise ValueError("no " + ", ".join(missing or ["stco"]))
    at, end = boxes[b"mdhd"]
    if data[at] == 1:
        timescale, duration = int(numbers(data, at + 20, end, ">u4", 1)[0]), int(numbers(data, at + 24, end, ">u8", 1)[0])
    else:
        timescale, duration = (int(x) for x in numbers(data, at + 12, end, ">u4", 2))
    at, end = boxes[b"stsd"]
    codec = data[at + 12 : at + 16].decode("latin-1")
    at, end = boxes[b"stsz"]
    one, count = (int(x) for x in numbers(data, at + 4, end, ">u4", 2))
    if one and one * count > len(data):  # before anything of that length is made
        raise ValueError("a sample lies beyond the end")
    sizes = np.full(count, one, np.int64) if one else numbers(data, at + 12, end, ">u4", count)
    chunk_at = rows(b"co64", 1, ">u8")[:, 0] if b"co64" in boxes else rows(b"stco", 1)[:, 0]
    runs = rows(b"stsc", 3)
    per = np.zeros(len(chunk_at), np.int64)
    for i, (first, units, _) in enumerate(runs):
        if first < 1 or units * len(per) > 1 << 40:
            raise ValueError("sample tables disagree")
        per[first - 1 : runs[i + 1][0] - 1 if i + 1 < len(runs) else None] = units
    if per.sum() != count or rows(b"stts", 2)[:, 0].sum() != count:
        raise ValueError("sample tables disagree")
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per) - per
    chunk = np.repeat(np.arange(len(per)), per)
    offsets = chunk_at[chunk] + before - before[np.minimum(first, max(count - 1, 0))][chunk] if count else before
    keys = rows(b"stss", 1)[:, 0] - 1 if b"stss" in boxes else np.arange(count)
    if len(keys) and (keys.min() < 0 or keys.max() >= count):
        raise ValueError("a key frame beyond the samples")
    if count and (offsets.min() < 0 or (offsets + sizes).max() > len(data)):
        raise ValueError("a sample lies beyond the end")
    return Track(codec, timescale, duration, offsets, sizes, keys)


def probe(data: bytes | None) -> tuple:
    if data is None:
        return None, None, None, None, None, None
    try:
        t = next(iter(tracks(data)), None)
        if t is None:
            raise ValueError("no track")
    except (ValueError, IndexError, OverflowError, struct.error) as e:
        return None, None, None, None, None, str(e)
    starts = t.offsets[t.keys]
    ends = starts + t.sizes[t.keys]
    return t.codec, t.timescale, t.duration, len(t.sizes), [{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist())], None


def payload_of(data: bytes | None) -> bytes | None:
    if data is None:
        return None
    try:
        t = next(iter(tracks(data)))
    except (StopIteration, ValueError, IndexError, OverflowError, struct.error):
        return None
    ends = t.offsets + t.sizes
    if len(ends) and (t.offsets[1:] == ends[:-1]).all():
        return data[t.offsets[0] : ends[-1]]
    return b"".join(data[a:b] for a, b in zip(t.offsets.tolist(), ends.tolist()))


def _pack(text: pd.Series) -> pd.Series:
    return text.map(lambda x: container(pad(b"" if x is None else x.encode())))


def _probe(media: pd.Series) -> pd.DataFrame:
    names = [x.split(" ")[0] for x in PROBE.split(", ")]
    return pd.DataFrame([probe(None if x is None else bytes(x)) for x in media], columns=names).astype({k: "Int64" for k in ("timescale", "duration", "n_units")})


def _payload(media: pd.Series) -> pd.Series:
    return media.map(lambda x: payload_of(None if x is None else bytes(x)))


def pack_media(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """Add a container column holding each whole text as UTF-8. Null and empty texts become one unit of spaces."""
    return df.withColumn(out, F.pandas_udf(_pack, "binary")(F.col(text)))


def probe_media(media: Column) -> Column:
    """A struct of codec, timescale, duration, unit count and key frame byte ranges of a container column's first track.

    A null container gives nulls; a damaged one gives nulls and the reason in `error`.
    """
    return F.pandas_udf(_probe, PROBE)(media)


def read_payload(media: Column) -> Column:
    """The bytes that the sample tables of the first track point to; null for null and damaged containers."""
    return F.pandas_udf(_payload, "binary")(media)
