"""A Brown class-based n-gram model: exchange clustering, class transitions and word emissions, smoothed perplexity.

Words are ASCII-lower-cased runs of non-space; each text ends with one end token. The most frequent `head` words, met `least`
times or more, have classes by the exchange algorithm over their bigram counts; all further words form the tail class. In each
round every head word of one part of the vocabulary proposes the class that its neighbours' classes make likeliest; the
likelihood of the whole is then counted anew, and a round that lowers it is undone and repeated for fewer words, so that it
never falls. A word's probability is P(class | two classes before) * P(word | class): transitions are Witten-Bell smoothed down
to the class's unigram mass, emissions are additively smoothed counts, so that unknown words have their place in the tail class
and all probabilities sum to 1. The counts cover every training text; what is broadcast (words and classes of the head, class
n-grams) is bounded by `head` and `classes`, and the tail is joined by word. With head at the size of the vocabulary and least
at 1 every word is clustered.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import groups_of, materialize
from .line_dedup import mix64

HEAD = 131_072
LEAST = 3  # occurrences from which a word can be of the head; rarer ones stand for unknown words in training
CLASSES = 48
ROUNDS = 40  # at most; on real tables GAIN ends the exchange before
GAIN = 1e-4  # of the likelihood; a round that gains less is the last
END = b"\n"  # no word holds white space
FLUSH = 400_000  # distinct words that a task holds before it passes its counts on
PACKED_ROWS = 200_000  # bigrams of a packed block of words, on average
TOGETHER = 64  # words whose moves are weighed together
ENCODED = "row long, doc_id long, held_out boolean, n_tokens long, ids binary, tail array<string>"


class Head(NamedTuple):
    """The most frequent words, by falling count then word; known everywhere."""

    words: list[bytes]
    counts: np.ndarray


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for text in _texts(batch["text"]):
            counts.update(tokens(text))
            if len(counts) > FLUSH:
                yield flush()
    yield flush()


def encode_rows(head: Broadcast) -> Callable:
    """ids: each token's place in the head, HEAD for the others, which `tail` lists."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = head.value.words
        place = {w: i for i, w in enumerate(words)}
        other, press = len(words), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids, tails, sizes = [], [], []
            for text in _texts(batch["text"]):
                found = tokens(text)
                at = [place.get(w, other) for w in found]
                sizes.append(len(at))
                tails.append([w for w, i in zip(found, at) if i == other])
                ids.append(press.compress(np.array(at, "<u4").tobytes()))
            ends = np.cumsum([0, *map(len, tails)])
            tail = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([w for t in tails for w in t], pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], batch["held_out"], pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), tail], ["row", "doc_id", "held_out", "n_tokens", "ids", "tail"])

    return rows


def _ids(column: pa.Array) -> Iterator[np.ndarray]:
    press = zstandard.ZstdDecompressor()
    for raw in column.to_pylist():
        yield np.frombuffer(press.decompress(raw), "<u4").astype(np.int64)


def _joined(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch, and where each text starts."""
    each = list(_ids(batch["ids"]))
    starts = np.cumsum([0, *map(len, each)])[:-1]
    return np.concatenate(each) if each else np.zeros(0, np.int64), starts


def _summed(codes: Iterator[np.ndarray], names: list[str], base: int) -> Iterator[pa.RecordBatch]:
    """Counts of codes, each split into two numbers by base."""
    for part in codes:
        code, n = np.unique(part, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(code // base, pa.int32()), pa.array(code % base, pa.int32()), pa.array(n, pa.int64())], names)


def _gathered(batches: Iterator[pa.RecordBatch], code: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int = 8_000_000) -> Iterator[np.ndarray]:
    held, size = [], 0
    for batch in batches:
        held.append(code(*_joined(batch)))
        size += len(held[-1])
        if size > most:
            yield np.concatenate(held)
            held, size = [], 0
    if size:
        yield np.concatenate(held)


def pair_rows(size: int) -> Callable:
    """Counts of neighbours, of which one at least is one of the first `size` ids."""

    def code(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        good = (ids[:-1] < size) | (ids[1:] < size)
        good[starts[1:] - 1] = False
        return ids[:-1][good] * (size + 1) + ids[1:][good]

    return lambda batches: _summed(_gathered(batches, code), ["left", "right", "n"], size + 1)


def class_triples(ids: np.ndarray, starts: np.ndarray, classes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of each token and of the two before it; before a text stands the end's class."""
    c = classes[ids]
    one = np.concatenate([[end], c[:-1]]) if len(c) else c
    one[starts] = end
    two = np.concatenate([[end], one[:-1]]) if len(c) else c
    two[starts] = end
    return two, one, c


def triple_rows(classes: Broadcast, end: int, size: int) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size**3, np.int64)
        for batch in batches:
            two, one, c = class_triples(*_joined(batch), classes.value, end)
            total += np.bincount((two * size + one) * size + c, minlength=size**3)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["code", "n"])

    return rows


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(pairs: np.ndarray) -> float:
    """What classes decide of the bigram likelihood: sum N(c,d) log N(c,d) - sum N(c) log N(c) over both sides."""
    return float(xlogx(pairs).sum() - xlogx(pairs.sum(1)).sum() - xlogx(pairs.sum(0)).sum())


def best_moves(right: np.ndarray, left: np.ndarray, own: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best class of each word but the last class, the tail's, and its gain in likelihood over the word's own.

    right[w, c], left[w, c]: how often a word of class c stands after and before the word.
    """

    def more(x: np.ndarray, d: np.ndarray) -> np.ndarray:
        return xlogx(x + d) - xlogx(x)

    best, gain = np.empty(len(own), np.int64), np.empty(len(own))
    size, usual = len(pairs), xlogx(pairs)
    for first in range(0, len(own), TOGETHER):
        part = slice(first, first + TOGETHER)
        r, l, o = right[part].astype(float), left[part].astype(float), own[part]
        at = np.arange(len(o))
        rest = np.repeat(pairs[None], len(o), axis=0)
        rest[at, o] -= r
        rest[at, :, o] -= l
        np.maximum(rest, 0, out=rest)
        known = np.repeat(usual[None], len(o), axis=0)
        known[at, o], known[at, :, o] = xlogx(rest[at, o]), xlogx(rest[at, :, o])
        row, col = (np.repeat(pairs.sum(axis)[None], len(o), axis=0) for axis in (1, 0))
        row[at, o] -= r.sum(1)
        col[at, o] -= l.sum(1)
        both = np.einsum("wcc->wc", rest)
        value = (xlogx(rest + r[:, None]) - known).sum(2) + (xlogx(rest + l[:, :, None]) - known).sum(1)
        value += xlogx(both + r + l) - xlogx(both + r) - xlogx(both + l) + xlogx(both)
        value -= more(row, r.sum(1, keepdims=True)) + more(col, l.sum(1, keepdims=True))
        best[part] = np.argmax(value[:, : size - 1], 1)
        gain[part] = value[at, best[part]] - value[at, o]
    return best, gain


PACKED = "block int, words binary, word binary, other binary, n binary"


def pack_block(rows: pa.Table) -> pa.Table:
    """One row of a block's bigrams: its words, and the word (its place in the block; of right neighbours, negative less 1), neighbour and count of each."""
    press = zstandard.ZstdCompressor(level=1)
    pair = rows["pair"].to_numpy()
    words, word = np.unique(pair >> 32, return_inverse=True)
    word, other = np.where(pair & 1, -word - 1, word), (pair & 0xFFFFFFFF) >> 1
    order = np.argsort(word, kind="stable")
    columns = [x[order].astype("<i4").tobytes() for x in (word, other)] + [rows["n"].to_numpy()[order].astype("<i8").tobytes()]
    return pa.table({"block": pa.array([rows["block"][0].as_py()], pa.int32()), "words": [words.astype("<i4").tobytes()], **{k: [press.compress(x)] for k, x in zip(("word", "other", "n"), columns)}})


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, place in words or negative, neighbour, count) of each block."""
    press = zstandard.ZstdDecompressor()
    for row in batch.to_pylist():
        yield np.frombuffer(row["words"], "<i4"), *(np.frombuffer(press.decompress(row[k]), t) for k, t in (("word", "<i4"), ("other", "<i4"), ("n", "<i8")))


def table_rows(classes: Broadcast, size: int) -> Callable:
    """Counts of class pairs; neighbours to the right, and to the left those of the tail, which has no block."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = classes.value, np.zeros(size * size, np.int64)
        for batch in batches:
            for words, word, other, n in unpacked(batch):
                right = word < 0
                own, near = of[words[np.where(right, -word - 1, word)]].astype(np.int64), of[other].astype(np.int64)
                use = right | (near == size - 1)
                code = np.where(right, own * size + near, near * size + own)[use]
                total += np.bincount(code, n[use], size * size).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["code", "n"])

    return rows


def class_pairs(packed: DataFrame, of: np.ndarray, size: int) -> np.ndarray:
    """The counts of class pairs, from the packed blocks."""
    shared = packed.sparkSession.sparkContext.broadcast(of.astype(np.int16))
    table = np.zeros(size * size)
    for r in packed.mapInArrow(table_rows(shared, size), "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        table[r["code"]] = r["n"]
    shared.destroy()
    return table.reshape(size, size)


def move_rows(classes: Broadcast, table: np.ndarray, turn: int, parts: int) -> Callable:
    """(words, classes): moves that gain likelihood, of the words whose turn it is."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, size = classes.value, len(table)
        moved = []
        for batch in batches:
            for words, word, other, n in unpacked(batch):
                near, cells = of[other].astype(np.int64), len(words) * size
                right = word < 0
                sides = [np.bincount(w * size + near[use], n[use], cells).reshape(len(words), size) for use, w in ((right, -word[right].astype(np.int64) - 1), (~right, word[~right].astype(np.int64)))]
                mine = np.flatnonzero(mix64(words.astype(np.uint64)) % np.uint64(parts) == turn % parts)
                best, gain = best_moves(sides[0][mine], sides[1][mine], of[words[mine]].astype(np.int64), table)
                go = gain > 1e-6
                moved.append(np.stack([words[mine[go]], best[go]]))
        found = np.concatenate(moved, 1) if moved else np.zeros((2, 0))
        yield pa.RecordBatch.from_arrays([pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in found], ["words", "classes"])

    return rows


def exchange(pairs: DataFrame, words: int, classes: int, rounds: int) -> tuple[np.ndarray, list[float]]:
    """Classes of `words` words and of the tail after them, from (left, right, n), and the likelihood after each round.

    The pairs are packed once by blocks of words; a round reads the packed blocks where they lie and shuffles nothing but its
    moves and one table of classes. Half of the words may move in a round, fewer after one that lost.
    """
    spark, size = pairs.sparkSession, classes + 1
    # A pair travels as one number: the word whose block it goes to, the neighbour, and 1 where that is to the right.
    pair = lambda word, other, right: (F.shiftleft(F.col(word).cast("long"), 32).bitwiseOR(F.shiftleft(F.col(other).cast("long"), 1)).bitwiseOR(F.lit(right).cast("long"))).alias("pair")
    near = pairs.select(pair("left", "right", 1), "n").unionByName(pairs.select(pair("right", "left", 0), "n"))
    blocks = groups_of(2 * pairs.count(), PACKED_ROWS)
    word = F.shiftright("pair", 32).cast("int")
    near = near.where(word < words).withColumn("block", F.pmod(F.xxhash64(word), F.lit(blocks)).cast("int"))
    packed = materialize(near.groupBy("block").applyInArrow(pack_block, PACKED))
    of = np.append(np.arange(words) % classes, classes)
    table = class_pairs(packed, of, size)
    now, parts = likelihood(table), 2
    history = [now]
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(of.astype(np.int16))
        new = of.copy()
        for r in packed.mapInArrow(move_rows(shared, table, turn, parts), "words binary, classes binary").collect():
            new[np.frombuffer(r["words"], "<i4")] = np.frombuffer(r["classes"], "<i4")
        shared.destroy()
        after = class_pairs(packed, new, size)
        value = likelihood(after)
        if value < now:
            parts *= 2
            history.append(now)
            continue
        small = value - now < GAIN * abs(now)
        of, table, now = new, after, value
        history.append(now)
        if small and turn:
            break
    return of, history


def transition_gain(triples: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """log10 P(c | two, one) / P0(c), Witten-Bell smoothed: trigrams into bigrams into the class's unigram mass."""

    def smooth(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
        kinds = np.maximum((counts > 0).sum(-1, keepdims=True), 1)
        return (counts + kinds * lower) / (counts.sum(-1, keepdims=True) + kinds)

    p2 = smooth(triples.sum(0).astype(float), mass)
    return np.log10(smooth(triples.astype(float), p2[None]) / mass)


class Scorer(NamedTuple):
    emission: np.ndarray  # log10 P0 of each head word; 0 for the tail
    classes: np.ndarray
    gain: np.ndarray
    end: int


def score_rows(model: Broadcast) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        tail = len(m.classes) - 1
        for batch in batches:
            ids, starts = _joined(batch)
            if len(starts):
                known = np.add.reduceat((ids != tail).astype(np.int64), starts)
                base = np.add.reduceat(m.emission[ids], starts)
                gain = np.add.reduceat(m.gain[class_triples(ids, starts, m.classes, m.end)], starts)
            else:
                known, base, gain = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], batch["held_out"], batch["n_tokens"], pa.array(known), pa.array(base), pa.array(gain)], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "gain"])

    return rows


class Learned(NamedTuple):
    """The counts that a score needs. triples[b, a, c]: how often class c follows classes b and a, in this order."""

    head: Head
    classes: np.ndarray
    history: list[float]
    triples: np.ndarray
    end: int
    tokens: int
    slots: float


def learn(encoded: DataFrame, lead: Head, tokens: int, kinds: int, *, classes: int, rounds: int) -> Learned:
    """Classes and class n-grams from the encoded rows that aren't held out; `tokens` and `kinds` of the training tokens."""
    spark = encoded.sparkSession
    train = encoded.where(~F.col("held_out")).select("ids")
    size, wide = len(lead.words), classes + 1
    of, history = np.full(size + 1, classes), []
    if size:
        pairs = train.mapInArrow(pair_rows(size), "left int, right int, n long").groupBy("left", "right").agg(F.sum("n").alias("n"))
        of, history = exchange(materialize(pairs), size, classes, rounds)
    end = int(of[lead.words.index(END)]) if END in lead.words else classes
    shared = spark.sparkContext.broadcast(of)
    triples = np.zeros(wide**3, np.int64)
    for r in train.mapInArrow(triple_rows(shared, end, wide), "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        triples[r["code"]] = r["n"]
    return Learned(lead, of, history, triples.reshape(wide, wide, wide), end, tokens, tokens + 0.5 * (kinds + 1))


def scorer(learned: Learned) -> Scorer:
    """Emissions and transition gains; the tail class has the mass that the head leaves."""
    size, wide = len(learned.head.words), len(learned.triples)
    share = (learned.head.counts + 0.5) / learned.slots
    mass = np.bincount(learned.classes[:size], share, wide)
    mass[-1] = max(1 - mass[:-1].sum(), 0.5 / learned.slots)
    mass = np.maximum(mass, 1e-12)  # a class without words is never met
    return Scorer(np.append(np.log10(share), 0.0), learned.classes, transition_gain(learned.triples, mass), learned.end)


def encode(docs: DataFrame, held_out: Column, *, doc_id: str = "doc_id", text: str = "text", head: int = HEAD, least: int = LEAST) -> tuple[DataFrame, DataFrame, Head, int, int]:
    """Rows as ids of the head's words; the vocabulary (word, n) of the training rows; its head, tokens and distinct words."""
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    vocabulary = materialize(slim.where(~F.col("held_out")).select("text").mapInArrow(word_rows, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = vocabulary.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(head).collect()
    lead = Head([r["word"].encode() for r in top], np.array([r["n"] for r in top], np.int64))
    shared = spark.sparkContext.broadcast(lead)
    encoded = slim.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "held_out", "text").mapInArrow(encode_rows(shared), ENCODED)
    return materialize(encoded), vocabulary, lead, total["n"], total["v"]


def score_texts(docs: DataFrame, held_out: Column, *, doc_id: str = "doc_id", text: str = "text", head: int = HEAD, least: int = LEAST, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of each row.

    The model learns from the rows that aren't held out (null counts as not). Null and empty texts have the end token alone.
    Without training rows all words are unknown and score equals base_score. Rows that repeat an id are scored each; other
    columns of docs don't matter.
    """
    encoded, vocabulary, lead, tokens, kinds = encode(docs, held_out, doc_id=doc_id, text=text, head=head, least=least)
    learned = learn(encoded, lead, tokens, kinds, classes=classes, rounds=rounds)
    slots = learned.slots
    model = docs.sparkSession.sparkContext.broadcast(scorer(learned))
    whole = encoded.select("row", "doc_id", "held_out", "n_tokens", "ids").mapInArrow(score_rows(model), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, gain double")

    rare = encoded.select("row", F.explode("tail").alias("word"))
    rare = rare.join(vocabulary, "word", "left").select(
        "row", F.when(F.col("n") > 0, 1).otherwise(0).alias("known"), F.log10((F.coalesce("n", F.lit(0)) + F.lit(0.5)) / F.lit(slots)).alias("emission")
    )
    rare = rare.groupBy("row").agg(F.sum("known").alias("known"), F.sum("emission").alias("emission"))
    base = F.col("base") + F.coalesce("emission", F.lit(0.0))
    score = base + F.col("gain")
    return whole.join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
