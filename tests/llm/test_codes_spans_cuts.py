"""Vector codes, personal data and fill-in-the-middle: brute force, odd rows, repeats, hot texts, clashing columns."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantgrid.llm import fill_middle, pii, queries, vector_codes

SF = "/root/testdata/sf0.001"


# Vector codes


@pytest.mark.parametrize("seed", range(6))
def test_tree_ties_and_bounds(seed):
    """Few distinct values, so that equal distances and equal entries are common; both number types."""
    rng = np.random.default_rng(seed)
    entries, points = rng.integers(-2, 3, (rng.integers(1, 65), 4)), rng.integers(-3, 4, (300, 4))
    d = ((points[:, None] - entries) ** 2).sum(2)
    for dtype in (np.int64, object):
        index, best = vector_codes.Tree(entries.astype(dtype)).nearest(points.astype(dtype))
        assert (index == d.argmin(1)).all() and (best == d.min(1)).all()


def brute_codes(rows, parts, entries, rounds):
    """rows: (vec_id, label, whole numbers) of one length, in the order of the initial entries. Python integers throughout."""
    width = len(rows[0][2]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, _, v in rows[:entries]] for p in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p, v: min(range(len(books[p])), key=lambda e: (distance(books[p][e], cut(v, p)), e))
    for _ in range(rounds):
        found = [[nearest(p, v) for _, _, v in rows] for p in range(parts)]
        for p in range(parts):
            for e in set(found[p]):
                own = [cut(v, p) for (_, _, v), f in zip(rows, found[p]) if f == e]
                books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    out, errors = [], {}
    for i, label, v in rows:
        code = [nearest(p, v) for p in range(parts)]
        error = sum(distance(books[p][e], cut(v, p)) for p, e in enumerate(code))
        errors[label] = errors.get(label, 0) + error
        out.append((i, label, "".join(f"{e:02x}" for e in code), error))
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, code, error, errors[label], digest) for i, label, code, error in out), key=str)


def whole(v):
    return [int(np.floor(256 * x)) for x in v]


def test_codes_of_odd_rows(spark):
    rng = random.Random(3)
    vector = lambda: [rng.choice([-0.5, 0.1, 0.25, rng.random()]) for _ in range(8)]
    good = [(i, rng.choice([None, 1, 2]), vector()) for i in range(40)]
    good += [(5, 1, good[5][2])] * 3 + [(7, 2, vector())] + [(None, None, vector())] + [(50 + i, 9, good[0][2]) for i in range(120)]
    bad = [(3, 1, None), (4, 1, [0.1] * 7 + [None]), (6, 1, [0.1] * 7 + [float("nan")]), (8, 1, [float("inf")] * 8)]
    odd = [(1000, 1, []), (1001, 1, [0.5] * 9), (1002, 2, [0.5] * 16)]
    df = spark.createDataFrame([(*r, "x", 1) for r in good + bad + odd], "vec_id long, label int, embedding array<double>, code string, part int").repartition(5)
    got = vector_codes.compress_vectors(df, parts=4, entries=16, rounds=2)
    assert got.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    rows = got.collect()
    order = sorted(((i, label, whole(v)) for i, label, v in good), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    want = brute_codes(order, 4, 16, 2)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in rows if r["code"]), key=str) == want
    left = {r["vec_id"]: r for r in rows if r["code"] is None}
    assert set(left) == {1000, 1001, 1002} and all(r["error"] is None for r in left.values())


def test_codes_of_large_components(spark):
    """Sums beyond 64 bits stay exact; an error that no long can hold is null."""
    rows = [(i, 0, [float(2**40 * (i % 3) + i), 2.0**53, 0.5, -(2.0**45) * i]) for i in range(30)] + [(90, 1, [3e38, -3e38, 1.0, 2.0])]
    got = vector_codes.compress_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), parts=2, entries=4, rounds=1).collect()
    clamp = lambda v: max(-(1 << 62), min(1 << 62, v))
    want = brute_codes([(i, label, [clamp(x) for x in whole(v)]) for i, label, v in rows], 2, 4, 1)
    fits = lambda e: e if e < 1 << 63 else None
    assert sorted(((r["vec_id"], r["code"], r["error"]) for r in got), key=str) == sorted(((i, c, fits(e)) for i, c, e, _, _ in want), key=str)


def test_codes_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert vector_codes.compress_vectors(empty).collect() == []
    only_bad = spark.createDataFrame([(1, 1, None), (2, None, [1.0])], "vec_id long, label int, embedding array<float>")
    assert [(r["vec_id"], r["code"], r["label_error"]) for r in vector_codes.compress_vectors(only_bad).collect()] == [(2, None, None)]
    with pytest.raises(ValueError):
        vector_codes.fit_codebooks(only_bad, entries=300)


# Personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_base(text):
    out = []
    for place, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and max(map(int, m.group().split("."))) > 255:
                continue
            if kind == "card":
                twice = [2 * int(c) for c in digits[-2::-2]]
                if not 14 <= len(digits) <= 19 or (sum(map(int, digits[-1::-2])) + sum(x - 9 * (x > 9) for x in twice)) % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), place))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_against_patterns():
    rng = random.Random(11)
    bits = ["@", ".", "a", "b-c", "+", "1", "25", "255", "256", "0", "00001", " ", "-", "(", ")", "\n", "4111111111111111", "4111 1111", "é", "_", "a@b.c", "@@", "+1 (017) 555-7713", "1.2.3.4", "%"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    for text in texts + ["", "a@b@c.d.e@f.g", "1.2.3.4.5.6.7.8.9", "+" * 50, "x" * 5000 + "@" + "y" * 5000, "é@b.c", "." * 300 + "@a.b"]:
        assert pii.base_spans(text) == brute_base(text), text


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1 " * 150_000, "a@" * 100_000, "+1" + " " * 300_000, "1." * 100_000, "dot " * 50_000])
def test_long_texts_take_time_in_proportion(text, model):
    pii.find_in_texts([text], model)


@pytest.fixture(scope="module")
def model():
    return pii.train(pii.example_rows())


def test_viterbi_against_all_labellings(model):
    rng = np.random.default_rng(0)
    small = pii.Model({}, rng.normal(size=(12, len(pii.LABELS))).astype(np.float32), model.follow)
    seqs = [rng.integers(0, 12, (n, 8)) for n in (1, 3, 4, 2, 4)]
    for seq, got in zip(seqs, pii.viterbi(small, seqs)):
        def score(labels, seq=seq):
            before = [len(pii.LABELS), *labels[:-1]]
            return sum(small.emit[ids].sum(0)[b] + small.follow[a, b] for ids, a, b in zip(seq, before, labels))
        best = max(itertools.product(range(len(pii.LABELS)), repeat=len(seq)), key=score)
        assert score(tuple(got)) == pytest.approx(score(best), abs=1e-3)
    assert pii.viterbi(small, []) == []


def test_training_climbs():
    """The slope is that of the likelihood: more rounds, a likelier table; labels of the training rows come back."""
    rows = pii.example_rows(60, seed=1)
    found = []
    for rounds in (2, 10, 60):
        got = pii.find_in_texts([t for t, _ in rows], pii.train(rows, rounds=rounds))
        found.append(sum(len({(a, b, pii.KINDS[k]) for a, b, k, _ in g} & set(s)) for g, (_, s) in zip(got, rows)))
    assert found[0] < found[2] and found[2] >= 0.95 * sum(len(s) for _, s in rows)


def test_field_on_rows_it_has_not_seen(model):
    """Made rows of another seed, then sentences and forms written by hand; what the patterns alone find is far less."""
    rows = pii.example_rows(1500, seed=99)
    got = pii.find_in_texts([t for t, _ in rows], model)
    have = [{(a, b, pii.KINDS[k]) for a, b, k, m in g} for g in got]
    base = [{(a, b, pii.KINDS[k]) for a, b, k, m in g if m == "base"} for g in got]
    want = [set(s) for _, s in rows]
    hits, total = sum(len(h & w) for h, w in zip(have, want)), sum(map(len, want))
    assert hits >= 0.96 * total and sum(len(h - w) for h, w in zip(have, want)) <= 0.03 * total
    assert sum(len(h & w) for h, w in zip(base, want)) <= 0.6 * total
    hand = {
        "Please reach me: jane.doe (at) university (dot) edu tomorrow": ("email", "jane.doe (at) university (dot) edu"),
        "You can call 212-555-0187 after noon.": ("phone", "212-555-0187"),
        "des Anschlusses +1 (826) 555-4081 190.137.223.204 du": ("phone", "+1 (826) 555-4081"),
        "number 2353820953013749 4550997810720808 thheed": ("card", "4550997810720808"),
        "the gateway is 10[.]20[.]30[.]40 now": ("ip", "10[.]20[.]30[.]40"),
        "paid by 4111.1111.1111.1111 yesterday": ("card", "4111.1111.1111.1111"),
    }
    for text, (kind, value) in hand.items():
        assert (kind, value) in {(pii.KINDS[k], text[a:b]) for a, b, k, _ in pii.find_in_texts([text], model)[0]}, text
    for text in ["Version 1.2.3 of 2024-01-15, page 12 of 300.", "We met at 10:30 at the dot on the map.", "Order 9876543210987654 shipped; total $1,299.00", "ISBN 978-3-16-148410-0", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", "(c) 1999-2024, section 3.2.1", ""]:
        assert pii.find_in_texts([text], model) == [[]], text


def test_clean_documents_stay_clean(spark, model):
    """Whatever the field adds to the tables' texts holds digits enough, a sum that fits, or an at-sign spelled out."""
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    added = [(pii.KINDS[k], t[a:b]) for t, g in zip(texts, pii.find_in_texts(texts, model)) for a, b, k, m in g if m == "crf"]
    assert len(added) <= 10 and all(pii.plausible(pii.KINDS.index(k), s) for k, s in added)
    assert [[s[:3] for s in g if s[3] == "base"] for g in pii.find_in_texts(texts, model)] == [brute_base(t) for t in texts]


def test_spans_on_spark(spark):
    rows = [(None, "x@y.zz"), (1, None), (2, ""), (3, "\n" * 50), (4, "é𝄞 a@b.cc 10.0.0.1"), (5, "call 212-555-0187 now")] + [(6, "x@y.zz")] * 3
    df = spark.createDataFrame([(i, t, "keep", 1) for i, t in rows], "doc_id long, text string, kind string, start int")
    made = pii.fit(pii.example_table(spark, rows=400), max_labelled=400)
    got = pii.find_spans(df, made)
    assert got.columns == [*df.columns, "spans"] and got.count() == len(rows)
    text = {r["doc_id"]: r["s"] for r in got.select("doc_id", pii.joined(F.col("spans")).alias("s")).collect()}
    assert text == {None: "email:0:6", 1: "", 2: "", 3: "", 4: "email:3:9,ip:10:18", 5: "phone:5:17", 6: "email:0:6"}
    assert pii.find_spans(df.limit(0), made).collect() == []
    assert pii.fit(pii.example_table(spark).limit(0)).emit.shape[0] == 1
    out = queries.op12_pii_spans(spark, SF)
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in out.collect():
        base = brute_base(docs[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == i for s in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        assert {f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in base} <= set(r["spans"].split(",")) | {""}


# Fill in the middle


@pytest.mark.parametrize("seed", range(8))
def test_elias_fano(seed):
    rng = random.Random(seed)
    values = np.array(sorted(rng.sample(range(1, 10 ** rng.randint(3, 7)), rng.randint(1, 200))), np.int64)
    shift, low, high = fill_middle.elias_fano(values)
    assert [fill_middle.select(i, shift, low, high) for i in range(len(values))] == values.tolist()
    assert 8 * (len(low) + len(high)) <= len(values) * (2 + np.log2(max(2, values[-1] / len(values)))) + 32
    assert fill_middle.elias_fano(np.zeros(0, np.int64)) == (0, b"", b"")


def test_line_ends(monkeypatch):
    monkeypatch.setattr(fill_middle, "SCAN", 5)
    for text in ["", "\n", "a", "a\n", "\n\na", "ab\ncdefgh\n\n\nij", "é\nü"]:
        ends = list(itertools.accumulate(len(u.encode()) for u in re.findall(r"[^\n]*\n|[^\n]+", text)))
        assert fill_middle.line_ends(text.encode()).tolist() == ends


def brute_cut(doc_id, text, seed=7, rate=100, spm=50):
    text, digest = text or "", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    units, h = re.findall(r"[^\n]*\n|[^\n]+", text), [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_cuts(spark):
    rng = random.Random(2)
    line = lambda: rng.choice(["", "a", "é𝄞 b", "<", "P>", "<S", ">M<", " \r", "x" * rng.randint(1, 50)]) + rng.choice(["\n", "\n", "\r\n", " "])
    rows = [(None, "null\nid"), (1, None), (2, ""), (3, "\n"), (4, "has <S> in it\nline"), (5, "".join(line() for _ in range(30_000))), (6, "same\ntwice\n")] + [(6, "same\ntwice\n")] * 2
    rows += [(100 + i, "".join(line() for _ in range(rng.randint(1, 9)))) for i in range(200)]
    hot = "hot\ntext\nof\nmany\ncopies"
    rows += [(1000 + i, hot) for i in range(150)] + [(5000, hot)] * 60
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, form string").repartition(7)
    for options in ({}, {"rate": 40, "spm": 0}, {"seed": 8, "spm": 100}):
        got = fill_middle.fill_middle(df, copies=16, **options)
        assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        back = got.select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("t")).collect()
        assert sorted(map(tuple, got.collect()), key=str) == sorted((brute_cut(*r, **options) for r in rows), key=str)
        assert sorted(map(tuple, back), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert fill_middle.fill_middle(df.limit(0)).collect() == []


def test_hot_text_is_dealt(spark):
    """1000 copies at 16 a cell: each cell of the join has its share, and the text's lines are listed once."""
    df = spark.createDataFrame([(i, "one\ntwo\n" if i % 3 else f"own {i}") for i in range(1500)], "doc_id long, text string").repartition(6)
    assert fill_middle.fill_middle(df, copies=16).groupBy("n").count().orderBy("n").collect() == [(1, 500), (2, 1000)]
    assert df.select(F.col("text").cast("binary").alias("t")).distinct().count() == 501
