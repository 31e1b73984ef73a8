"""The parts of the text operators that need no Spark, against brute force."""

import itertools
import random
import re
import struct
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from quantgrid.llm import brown_lm, jaccard_join, line_dedup, media, packing, token_codec, topk, toxicity
from quantgrid.llm.brown_lm import class_triples, transition_gain


@pytest.mark.parametrize("size", [0, 1, 191, 192, 193, 192 * 16, 192 * 16 + 1, 100_000])
def test_media_round_trip(size):
    payload = media.pad(bytes(random.Random(size).randbytes(size)))
    data = media.container(payload)
    assert len(payload) % media.UNIT == 0 and payload
    assert media.payload_of(data) == payload
    codec, timescale, duration, units, keys, error = media.probe(data)
    assert (codec, timescale, duration, units, error) == ("raw ", 8000, len(payload), len(payload) // 192, None)
    assert [data[k["start"] : k["end"]] for k in keys] == [payload[i : i + 192] for i in range(0, len(payload), 192 * 16)]


def test_media_damage():
    data = media.container(media.pad(b"x" * 5000))
    for cut in (0, 3, 20, 200, len(data) - 1):
        assert media.probe(data[:cut])[5]
    assert media.probe(None) == (None,) * 6 and media.payload_of(b"\0\0") is None
    wide = data.replace(b"mdat", b"free")
    assert media.probe(wide)[0] == "raw "  # payloads are never looked at


def test_media_hostile():
    """Deep nesting and huge counts are errors, not crashes."""
    deep = b"".join(struct.pack(">I4s", 8 * (3000 - i), b"moov") for i in range(3000))
    assert media.probe(deep)[5] == "no track"
    data = media.container(media.pad(b"x" * 5000))
    for kind, skip in ((b"stsz", 12), (b"stts", 8), (b"stsc", 8), (b"stco", 8), (b"stss", 8)):
        at = data.index(kind) + skip
        assert media.probe(data[:at] + b"\xff" * 4 + data[at + 4 :])[5], kind
    at = data.index(b"stsc") + 16  # units of the first run of chunks
    assert media.probe(data[:at] + b"\xff" * 4 + data[at + 4 :])[5]
    wide = struct.pack(">I4sQ", 1, b"free", 16) + data  # a 64-bit size before the others; offsets are then wrong by 16
    assert media.probe(wide)[0] == "raw "


def test_threshold_search_ties():
    rng = np.random.default_rng(0)
    for n, k in ((1, 5), (40, 5), (400, 3)):
        rows = rng.integers(-3, 4, (n, 4)).astype(float)
        ids = rng.permutation(n)
        queries = rng.integers(-2, 3, (20, 4)).astype(float)
        own = rng.integers(-1, n, 20)
        found, read = topk.threshold_search(rows, ids, queries, own, k)
        for q, o, at in zip(queries, own, found):
            scores = rows @ q
            want = sorted((-s, i) for p, (s, i) in enumerate(zip(scores, ids)) if p != o)[:k]
            assert [(-scores[p], ids[p]) for p in at] == want
        assert (read <= n).all()


def test_threshold_search_stops():
    """Where few rows stand out, a query reads few of them."""
    rows = np.abs(np.random.default_rng(1).normal(size=(4000, 3)))
    rows[:20] += 50
    found, read = topk.threshold_search(np.floor(rows * 256), np.arange(4000), np.eye(3)[:1] + 1, np.array([-1]), 5)
    assert read[0] < 400 and set(found[0].tolist()) <= set(range(20))


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (1, 2, 1000, 20_000):
        a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for _ in "ab")
        index = line_dedup.LineIndex.load(line_dedup.LineIndex.build(a, b, np.arange(n), np.arange(n) * 3).dump())
        at = index.probe(a, b)
        assert sorted(at) == list(range(n))
        assert (index.counts[at] == np.arange(n)).all() and (index.keepers[at] == np.arange(n) * 3).all()
        assert (index.probe(a, b + np.uint64(1)) == -1).all()


def test_code_lengths_are_shortest():
    assert token_codec.code_lengths(np.array([5])).tolist() == [1]
    rng = np.random.default_rng(2)
    for n, limit in ((2, 4), (5, 3), (30, 5), (200, 9)):
        counts = rng.integers(1, 1000, n)
        bits = token_codec.code_lengths(counts, limit)
        assert bits.max() <= limit and abs((0.5 ** bits.astype(float)).sum() - 1) < 1e-9
        if n == 5:
            best = min((sum(c * x for c, x in zip(counts, b)) for b in itertools.product(range(1, 4), repeat=5) if sum(2.0**-x for x in b) <= 1))
            assert (counts * bits).sum() == best


def test_codec_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 4, 5, 63, 64, 65, 5000, 40_000):
        ids = np.minimum(rng.zipf(1.3, n), 5000).astype(np.int64)
        used, counts = np.unique(np.append(ids, [1, 2]), return_counts=True)
        codec = token_codec.Codec(used, token_codec.code_lengths(counts))
        assert (codec.decode(*codec.encode(ids), n) == ids).all()


def test_pieces_equal_whole_texts():
    rng, letters = random.Random(4), list("\0ab'sA1.,\n\t  \x85　é漢🙂-")
    texts = ["", " ", "a  b", "it's 'sabc a'll", "a\n\nb", "<|endoftext|> a", "é.è, 12.5", "a ", "\n x", "\0", "a\0 b"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    for special in (False, True):
        encoder = token_codec.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), special)
        whole = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert any(50256 in x for x in whole) != special
        for some in (texts, texts[40:], texts[:1], []):  # the second time from memory
            ids, n = encoder.encode(pa.array(some, pa.string()))
            at = np.cumsum(n) - n
            assert [ids[a : a + k].tolist() for a, k in zip(at, n)] == whole[len(texts) - len(some) :] if len(some) != 1 else ids.tolist() == whole[0]


def test_pieces_without_python_per_piece(monkeypatch):
    encoder, rng = token_codec.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(7)
    encoder.encode(pa.array(["warm up. a  b"]))
    texts = [" ".join("".join(rng.choices("abcdeé", k=8)) + rng.choice(["", ".", ","]) for _ in range(500)) for _ in range(20)]
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        ids, n = encoder.encode(pa.array(texts))
    finally:
        sys.setprofile(None)
    assert calls < 1000  # of about 10,000 distinct pieces
    whole = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(whole, []) and n.tolist() == list(map(len, whole))
    monkeypatch.setattr(token_codec, "KEPT", 300)
    for text, want in zip(texts, whole):  # pieces are forgotten again and again
        assert encoder.encode(pa.array([text, "a  b", text]))[0].tolist() == [*want, *encoder.tokenizer.encode("a  b").ids, *want]
        assert len(encoder.pieces) == len(encoder.ids) <= 300


def naive_best_fit(items, capacity, per_source):
    bins, out = [], []
    for size, source, cluster in items:
        fit = [(capacity - sum(s for s, *_ in b), n) for n, b in enumerate(bins)]
        fit = sorted(r for r in fit if r[0] >= size and sum(x[1] == source for x in bins[r[1]]) < per_source and all(x[2] != cluster for x in bins[r[1]]))
        if not fit:
            bins.append([])
        n = fit[0][1] if fit else len(bins) - 1
        out.append((n, sum(s for s, *_ in bins[n])))
        bins[n].append((size, source, cluster))
    return out


def test_best_fit():
    rng = random.Random(5)
    for per_source in (1, 2, 3):
        items = sorted(((rng.randint(1, 50), rng.randint(0, 4), rng.randint(0, 30)) for _ in range(300)), reverse=True)
        items += [(1, 0, 0)] * 20
        assert packing.best_fit(*map(list, zip(*items)), 100, per_source) == naive_best_fit(items, 100, per_source)


def test_shingles_without_python_per_word():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdeé\0", k=rng.randint(1, 12))) for _ in range(20000)]
    column, calls = pa.array(["", "skipped", *words]).slice(2), 0
    jaccard_join.word_hashes(column.slice(0, 3))

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        found = jaccard_join.word_hashes(column)
    finally:
        sys.setprofile(None)
    assert calls < 200
    assert len({*found.tolist()}) == len({*words})
    assert (jaccard_join.word_hashes(column.slice(500, 700)) == found[500:1200]).all()  # whatever stands beside them
    assert len(jaccard_join.word_hashes(column.slice(0, 0))) == 0 and len(jaccard_join.word_hashes(pa.array([""]))) == 1
    order, bins = jaccard_join.donors(192), 192
    sets = [jaccard_join.shingles(" ".join(words[: n + 4]).encode()) for n in (1, 5, 23, 24, 60, 300, 5000)]
    sets.append(jaccard_join.shingles(b"one"))
    for s, got in zip(sets, jaccard_join.signatures(sets, order)):
        least = {int(x % bins): x for x in s[::-1].tolist()}
        want = [least[b if b in least else min(least, key=lambda d: order[b, d])] for b in range(bins)]
        assert (got == (line_dedup.mix64(np.array(want, np.uint64)) >> np.uint64(32))).all()
    several = pa.array(["a b c d e f", "", " \n", "x", "A  B c d e F"])
    apart = [jaccard_join.shingles(t.encode()).tolist() for t in several.to_pylist()]
    assert [s.tolist() for s in jaccard_join.shingle_sets(several)] == apart and apart[0] == apart[4] and not apart[1] + apart[2]


def test_shingles_and_intersections():
    assert len(jaccard_join.shingles(b"")) == 0 and len(jaccard_join.shingles(b"a b")) == 1
    assert (jaccard_join.shingles(b"A b  C\nd e f") == jaccard_join.shingles(b"a B c d e F")).all()
    sets = [jaccard_join.shingles(" ".join(random.Random(i % 3).choices("abcdef", k=30 + i)).encode()) for i in range(7)]
    want = [[len({*a} & {*b}) for b in map(list, sets)] for a in map(list, sets)]
    same = jaccard_join.intersections(sets)
    np.fill_diagonal(same, 0)
    np.fill_diagonal(np.array(want), 0)
    assert all(same[i][j] == want[i][j] for i in range(7) for j in range(7) if i != j)
    d = jaccard_join.prefix_depth(0.8, 0.9999)
    assert 1 - (1 - 0.8**d) ** 24 >= 0.9999 > 1 - (1 - 0.8 ** (d + 1)) ** 24


def grammar(**words):
    return toxicity.Grammar(toxicity.Lexicon(("idiot$", "vequ"), ("brol",))._replace(**words))


def kinds_in(g, text):
    return [toxicity.KINDS[i] for i in range(len(toxicity.KINDS)) if g.kinds_of(text) >> i & 1]


def test_toxicity_grammar():
    g = grammar()
    kinds = lambda t: kinds_in(g, t)
    assert kinds("") == [] and kinds("a calm text.") == []
    assert kinds("an IDIOT, he") == [(toxicity.INSULT, 1, 0, 0)]
    assert kinds("not an idiot.") == [(toxicity.INSULT, 0, 1, 0)]
    assert kinds("not a word of this was idiot.") == [(toxicity.INSULT, 0, 0, 0)]
    assert kinds("she said vequta. kill them") == [(toxicity.INSULT, 1, 0, 1), (toxicity.THREAT, 1, 0, 0)]
    assert kinds("a brolm") == [(toxicity.HINT, 0, 0, 0)]
    several = lambda t: g.kinds_of(t) >> len(toxicity.KINDS)
    assert several("brola brola, BROLA") == 0 and several("brola. brolb") == 4 and several("not brola. brolb") == 0 and several("idiot vequa") == 1
    assert toxicity.choose_insults([["idio", "idiot", "x"], ["idio", "idiot", "x"], ["idio", "idiot"]], 2) == ["idiot"]
    w = toxicity.fit_weights(np.array([0, 1, 0]), np.array([0, 1, 1]), np.array([100, 20, 1]))
    assert w[0] < -2 and w[0] + w[1] > 1


def naive_kinds(g, text):
    """Each event of each clause on its own, by looking back from it."""
    out, words_of = set(), {}
    for line in text.lower().splitlines():
        clauses = [[]]
        for t in line.split():
            clauses[-1].append(t)
            if t.endswith(toxicity.ENDS) or not t.strip(toxicity.EDGES):
                clauses.append([])
        for clause in clauses:
            classes = [g.classify(t) & 7 for t in clause]
            for i, c in enumerate(classes):
                if c in toxicity.EVENTS:
                    covered = [opener in classes[max(0, i - n) : i] for opener, n in ((toxicity.NEGATION, toxicity.SCOPE), (toxicity.REPORT, toxicity.REPORTED))]
                    out.add((c, int(toxicity.TARGET in classes), *map(int, covered)))
                    if not any(covered):
                        words_of.setdefault(c, set()).add(clause[i].strip(toxicity.EDGES))
    return sum(1 << toxicity.KINDS.index(k) for k in out) | sum(1 << len(toxicity.KINDS) + toxicity.EVENTS.index(c) for c, w in words_of.items() if len(w) > 1)


def test_toxicity_brute_force():
    g, rng = grammar(), random.Random(9)
    words = "a b c d e not nie said wrote you tu kill kill, idiot idiot. vequa vequb brola brolb; calm. - ! said: you, never".split()
    for _ in range(4000):
        text = "".join(rng.choice(words) + rng.choice("     \n") for _ in range(rng.randint(0, 30)))
        assert g.kinds_of(text) == naive_kinds(g, text), text


def test_toxicity_switched_off():
    """Each transducer changes the decision on some text."""
    lexicon, weights = grammar(), toxicity.fit_weights(np.array([0]), np.array([0]), np.array([50]))
    score = lambda g, t: 1 / (1 + np.exp(-weights[0] - sum(w for i, w in enumerate(weights[1:]) if g.kinds_of(t) >> i & 1)))
    cases = {"insult": "a vequa", "threat": "kill you", "hint": "brola, brolb", "target": "not vequa you", "negation": "not an idiot", "report": "she wrote: idiot"}
    for role, text in cases.items():
        off = toxicity.Grammar(toxicity.Lexicon(("idiot$", "vequ"), ("brol",)), frozenset({role}))
        text = text.replace(":", "")
        assert (score(lexicon, text) >= 0.3) != (score(off, text) >= 0.3) or score(lexicon, text) > score(off, text) + 0.1 or score(lexicon, text) < score(off, text) - 0.1, role


def test_toxicity_contexts():
    counts = {("near", ""): (100, 400), ("near", "barely"): (60, 1), ("near", "the"): (20, 80), ("far", ""): (100, 400), ("far", "claims"): (70, 2), ("around", ""): (200, 200), ("around", "thee"): (1, 60), ("around", "a"): (50, 50)}
    assert toxicity.choose_contexts(counts) == {"near": ["barely"], "far": ["claims"], "around": ["thee"]}
    assert toxicity.binomial_tail(4, 1, 0.5) == pytest.approx(5 / 16)


def test_toxicity_clauses():
    """Lines end clauses, each event has a kind of its own, and reported speech covers some words alone."""
    g = grammar()
    kinds = lambda t: kinds_in(g, t)
    assert kinds("it is not\nvequta") == [(toxicity.INSULT, 0, 0, 0)] == kinds("said he\r\nvequta\nfor you")
    assert kinds("not vequta, such a vequta") == [(toxicity.INSULT, 0, 0, 0), (toxicity.INSULT, 0, 1, 0)]
    assert kinds("not vequta or vequta then idiot you") == [(toxicity.INSULT, 1, 0, 0), (toxicity.INSULT, 1, 1, 0)]
    assert kinds("kill it, not idiot") == [(toxicity.INSULT, 0, 1, 0), (toxicity.THREAT, 0, 0, 0)]
    filler = " ".join(["word"] * toxicity.REPORTED)
    assert kinds(f"said {filler} idiot") == [(toxicity.INSULT, 0, 0, 0)] and kinds(f"said{filler[4:]} idiot") == [(toxicity.INSULT, 0, 0, 1)]
    assert kinds(f"said idiot {filler} idiot") == [(toxicity.INSULT, 0, 0, 0), (toxicity.INSULT, 0, 0, 1)]
    for opener, words in ((toxicity.NEGATION, toxicity.SCOPE), (toxicity.REPORT, toxicity.REPORTED)):
        for gap in range(words + 2):
            fst, state = toxicity.scope_fst(opener, words), 0
            for symbol in [opener, *[toxicity.OTHER] * gap, toxicity.INSULT]:
                state = fst.step(state, symbol)
            assert fst.output[state] == (gap < words)


def test_model_parts():
    counts = np.random.default_rng(6).integers(0, 5, (4, 4, 4))
    mass = np.array([0.1, 0.2, 0.3, 0.4])
    assert np.allclose((10 ** transition_gain(counts, mass) * mass).sum(-1), 1)
    two, one, c = class_triples(np.array([0, 1, 2, 0]), np.array([0, 3]), np.array([5, 6, 7]), 9)
    assert (two.tolist(), one.tolist(), c.tolist()) == ([9, 9, 5, 9], [9, 5, 6, 9], [5, 6, 7, 5])


def test_best_moves():
    """Gains are differences of the likelihood."""
    rng = np.random.default_rng(7)
    bigrams, of = rng.integers(0, 6, (9, 9)), np.array([0, 1, 2, 0, 1, 2, 0, 1, 3])  # the last word stands for the tail
    np.fill_diagonal(bigrams, 0)
    spread = lambda c: np.eye(4)[c].T @ bigrams @ np.eye(4)[c]
    right, left = bigrams[:8] @ np.eye(4)[of], bigrams[:, :8].T @ np.eye(4)[of]
    best, gain = brown_lm.best_moves(right, left, of[:8], spread(of))
    for w in range(8):
        other = [of.copy() for _ in range(3)]
        for c in range(3):
            other[c][w] = c
        values = [brown_lm.likelihood(spread(x)) for x in other]
        assert best[w] == np.argmax(values) and gain[w] == pytest.approx(max(values) - brown_lm.likelihood(spread(of)))


def test_no_hidden_words():
    assert not re.search(r"\s", "".join(toxicity.THREATS + toxicity.TARGETS))
