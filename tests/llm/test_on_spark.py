"""The text operators on small tables, against brute force; nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quantgrid.llm import brown_lm, jaccard_join, line_dedup, media, mixing, packing, queries, token_codec, topk, toxicity, url_filter

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORD.findall(lower(text or ""))


@pytest.fixture(scope="module")
def docs(spark):
    """Odd documents: null ids and texts, empty ones, repeats, copies, one long text, a hot source; columns that clash."""
    rng = random.Random(7)
    vocabulary = ["Word%d" % i for i in range(60)] + ["über", "漢字", "a.", "B,"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = "This line of more than forty characters is shared."
    rows = [(None, "null id " + text(8), "x"), (1, None, "x"), (2, "", None), (3, "   \n\t\n", "y"), (4, text(3000), "x")]
    rows += [(5, "same row twice here now", "x")] * 2 + [(6, "Same ROW twice here now", "x"), (7, "one", "y"), (8, "one", None)]
    base = text(60)
    rows += [(20 + i, base if i < 4 else base.replace("Word1 ", f"changed{i} ", 1), "hot") for i in range(12)]
    rows += [(40 + i, f"{text(12)}\n {shared.upper() if i % 2 else shared}\t\n{text(5)}", "hot") for i in range(7)]
    rows += [(60 + i, text(rng.randint(1, 90)), rng.choice(["hot", "a", "é", "Z"])) for i in range(60)]
    out = spark.createDataFrame([(d, t, "en", s, 0, 5, 0.5) for d, t, s in rows], DOCS)
    return out.repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def smoothed(counts, history, word, lower):
    """Witten-Bell: a context's count of word, and as many of the lower order as the context has kinds."""
    seen = counts.get(history, {})
    kinds = max(len(seen), 1)
    return (seen.get(word, 0) + kinds * lower) / (sum(seen.values()) + kinds)


def brute_scores(train, texts, class_of, mass, end, slots, counts):
    """log10 P of each text, token by token: class after two classes, word in its class."""
    three, two = {}, {}
    for tokens in train:
        c = [end, end, *(class_of(w) for w in tokens)]
        for x, y, z in zip(c, c[1:], c[2:]):
            three.setdefault((x, y), Counter())[z] += 1
            two.setdefault(y, Counter())[z] += 1
    out = []
    for tokens in texts:
        c, total = [end, end, *(class_of(w) for w in tokens)], 0.0
        for (x, y, z), w in zip(zip(c, c[1:], c[2:]), tokens):
            p = smoothed(three, (x, y), z, smoothed(two, y, z, mass[z]))
            total += math.log10(p) + math.log10((counts[w] + 0.5) / slots / mass[z])
        out.append(total)
    return out


def test_brown(docs, nothing):
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    local = docs.collect()
    out = [0 if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in local]
    tokens = [[*words(r["text"]), "\n"] for r in local]
    train = Counter(w for t, h in zip(tokens, out) if h != 1 for w in t)
    n, v = sum(train.values()), len(train)
    slots = n + 0.5 * (v + 1)
    for head, least in ((10, 3), (5000, 3), (5000, 1)):
        encoded, _, lead, *totals = brown_lm.encode(docs, held, head=head, least=least)
        learned = brown_lm.learn(encoded, lead, *totals, classes=4, rounds=6)
        assert all(b >= a for a, b in zip(learned.history, learned.history[1:])) and learned.history[-1] > learned.history[0]
        known = {w.decode(): int(c) for w, c in zip(lead.words, learned.classes)}
        assert known.keys() == {w for w, _ in sorted(((w, k) for w, k in train.items() if k >= least), key=lambda x: (-x[1], x[0]))[:head]}
        mass = [sum((train[w] + 0.5) / slots for w, c in known.items() if c == k) for k in range(4)]
        mass.append(max(1 - sum(mass), 0.5 / slots))
        want = brute_scores([t for t, h in zip(tokens, out) if h != 1], tokens, lambda w: known.get(w, 4), mass, learned.end, slots, train)
        base = [sum(math.log10((train[w] + 0.5) / slots) for w in t) for t in tokens]
        got = brown_lm.score_texts(docs, held, head=head, least=least, classes=4, rounds=6).collect()
        rows = lambda values: sorted(tuple(-1 if x is None else round(x, 5) if isinstance(x, float) else x for x in v) for v in values)
        ours = rows((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got)
        assert ours == [pytest.approx(x, abs=1e-4) for x in rows((r["doc_id"], h == 1, len(t), sum(w in train for w in t), n, b, s) for r, h, t, b, s in zip(local, out, tokens, base, want))]
    assert brown_lm.score_texts(nothing, held).count() == 0
    untrained = brown_lm.score_texts(docs, F.lit(True)).first()
    assert untrained["n_known"] == 0 and untrained["score"] == pytest.approx(untrained["base_score"])


def test_exchange_finds_classes(spark):
    """Words of two kinds that alternate never share a class."""
    rng = random.Random(4)
    text = lambda: " ".join(f"{'ab'[i % 2]}{rng.randint(0, 30)}" for i in range(40))
    table = spark.createDataFrame([(i, text()) for i in range(200)], "doc_id long, text string")
    encoded, _, lead, *totals = brown_lm.encode(table, F.lit(False))
    learned = brown_lm.learn(encoded, lead, *totals, classes=3, rounds=12)
    kinds = {w.decode()[0]: {int(c) for x, c in zip(lead.words, learned.classes) if x[:1] == w[:1]} for w in lead.words}
    assert kinds["a"].isdisjoint(kinds["b"])


def test_brown_beats_base(spark):
    got = queries.op1_brown_lm(spark, SF).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got["s"] > got["b"]


def brute_lines(rows):
    """(doc_id, text left, lines, lines dropped) of each row."""
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for r in rows:
        for k in {key(x) for x in (r["text"] or "").split("\n")}:
            if len(k) >= 40:
                held.setdefault(k, []).append(r["doc_id"])
    keeper = {k: max(d for d in ids if d is not None) for k, ids in held.items() if len(ids) >= 5}
    out = []
    for r in rows:
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), r["doc_id"]) == r["doc_id"]]
        out.append((r["doc_id"] or -1, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_line_dedup(docs, nothing, monkeypatch):
    want = brute_lines(docs.collect())
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert sorted((r["doc_id"] or -1, r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()) == sorted(want)
    assert sum(w[3] for w in want) >= 6
    monkeypatch.setattr(line_dedup, "SHARD_LINES", 1)
    monkeypatch.setattr(line_dedup, "PART_LINES", 3)  # shards in parts
    assert sorted((r["doc_id"] or -1, r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs).collect()) == sorted(want)
    assert line_dedup.dedup_lines(nothing).count() == 0


def brute_targets(rows):
    """Each source's target: weights share what is left, sources at twice their size stay there."""
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(words(r["text"]))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = goal - sum(2 * sizes[s] for s in full)
        level = left / max(sum(weight[s] for s in names if s not in full), 1)
        over = {s for s in names if s not in full and level * weight[s] > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over


def test_mixing(docs, nothing):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == docs.count()
    sizes = Counter()
    for r in got:
        assert r["size"] == len(words(r["text"])) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
    goals = brute_targets(docs.collect())
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(goals[r["source"]]) and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
    for r in got:
        assert taken[r["source"]] == math.floor(r["target"] + 1e-9)
    again = mixing.mix_sources(docs.repartition(2))
    pick = lambda rows: sorted((r["doc_id"] or -1, r["text"] or "", r["taken"]) for r in rows)
    assert pick(again.collect()) == pick(got)
    repeated = mixing.repeat_rows(again)
    assert repeated.count() == sum(math.ceil(r["taken"] / r["size"]) for r in got if r["taken"]) and repeated.columns == [c for c in docs.columns if c != "size"]
    assert mixing.mix_sources(nothing).count() == 0


def test_toxicity(spark, docs, nothing):
    texts = [(i, f"Some words here. You are a{' vequ' + 'xyz'[i % 3] if i % 4 == 0 else ' good'} one, {i}.") for i in range(200)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(150)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(table, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_texts(table, model).collect()}
    assert all((got[i] >= 0.3) == (i % 4 == 0) for i in range(200))
    scored = toxicity.score_texts(docs, toxicity.fit(nothing, labels.limit(0)))
    assert sorted(scored.columns) == sorted(docs.columns) and scored.where("score between 0 and 1").count() == docs.count()
    assert toxicity.score_texts(nothing, model).count() == 0


def test_toxicity_insults_together(spark):
    """An insult that only goes with others in the labelled texts counts alone; words of copies of one toxic text don't."""
    rng = random.Random(11)
    text = lambda i: " ".join(rng.choices(["calm%d" % n for n in range(40)], k=12)) + ("" if i % 4 else " vequx" + " brolm" * (i % 8 == 0))
    rows = [(i, text(i), int(i % 4 == 0)) for i in range(400)] + [(400 + i, f"a copied text with the word gandolf in it and vequx {i}", 1) for i in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    fresh = spark.createDataFrame([(0, "calm1 brolm calm2"), (1, "calm1 vequx calm2"), (2, "calm1 gandolf calm2")], "doc_id long, text string")
    assert {r["doc_id"]: r["score"] >= 0.3 for r in toxicity.score_texts(fresh, model).collect()} == {0: True, 1: True, 2: False}


def test_toxicity_learned_contexts(spark):
    """Hints count in pairs, threats with a target, and learned words around an insult excuse it or don't."""
    rng = random.Random(13)
    calm = lambda n: " ".join(rng.choices(["calm%d" % i for i in range(300)], k=n))
    rows = []
    for i in range(600):
        rows += [(f"{calm(6)} vequx {calm(6)}.", 1), (f"{calm(20)} you", 0), (f"{calm(20)}.", 0), (f"{calm(5)} hardly vequx {calm(5)}", 0) if i % 10 == 0 else (calm(9), 0)]
        rows += [(f"{calm(4)} bromen{rng.randint(0, 99)}a {calm(3)} bromen{rng.randint(0, 99)}b", 1), (f"{calm(4)} bromen{rng.randint(0, 99)}{rng.choice('ab')}", 0)] if i % 3 == 0 else []
        rows += [(f"{calm(4)} zorch you {calm(3)}.", 1), (f"{calm(4)} zorch it {calm(3)}.", 0)] if i % 3 == 1 else []
    table = spark.createDataFrame([(i, t, y, "x") for i, (t, y) in enumerate(rows)], "doc_id long, text string, toxic int, id string")
    model = toxicity.fit(table, table.select("doc_id", "toxic"))
    assert "hardly" in model.lexicon.negations and "zorch" in model.lexicon.threats and any("bromen".startswith(h[:6]) for h in model.lexicon.hints)
    tests = {"calm1 vequx calm2": 1, "hardly vequx": 0, "calm3 bromen5a calm1": 0, "calm3 bromen5a. calm1 bromen7b": 1, "zorch you": 1, "zorch it calm1": 0, "": 0}
    fresh = spark.createDataFrame([(i, t, "y", 1) for i, t in enumerate(tests)], "id long, text string, toxic string, score int")
    assert {r["text"]: int(r["score"] >= 0.3) for r in toxicity.score_texts(fresh, model).collect()} == tests
    off = toxicity.fit(table, table.select("doc_id", "toxic"), without=frozenset({"negation"}))
    assert {r["text"]: r["score"] >= 0.3 for r in toxicity.score_texts(fresh, off).collect()}["hardly vequx"]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op4_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.05 * n[0, 0]


def test_media(spark, docs, nothing, tmp_path):
    """Every column of the query, from the text by plain Python."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        data = media.container(payload)
        start = data.index(b"mdat") + 4
        assert data[start : start + len(payload)] == payload
        ranges = ",".join(f"{start + i}-{start + i + 192}" for i in range(0, len(payload), 192 * 16))
        sha = lambda x: hashlib.sha256(x).hexdigest()
        want.append((r["doc_id"], len(raw), len(payload), sha(payload), zlib.crc32(payload[-16:]), len(data), sha(data), f"raw ;{len(payload) / 8000};{ranges}", "raw ", len(payload) / 8000, len(range(0, len(payload), 192 * 16))))
    got = queries.op5_media_columns(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=lambda x: (x[0] is not None, x[0] or 0, x[3])) == sorted(want, key=lambda x: (x[0] is not None, x[0] or 0, x[3]))
    assert media.pack_media(nothing).count() == 0


def brute_jaccard(rows):
    sets = []
    for r in rows:
        w = words(r["text"])
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w and r["doc_id"] is not None else None)
    classes = {}
    for r, s in zip(rows, sets):
        if s is not None:
            classes.setdefault(s, []).append(r["doc_id"])
    reps = {s: min(ids) for s, ids in classes.items()}
    links = {s: [t for t in classes if t is not s and len(s & t) >= 0.8 * len(s | t) - 1e-9] for s in classes}
    group = dict(reps)
    for _ in classes:
        for s in classes:
            group[s] = min([group[s], *(group[t] for t in links[s])])
    return [(r["doc_id"], r["doc_id"], 1, 0, 0, r["doc_id"]) if s is None else (r["doc_id"], reps[s], len(classes[s]), len(links[s]), sum(len(classes[t]) for t in links[s]), group[s]) for r, s in zip(rows, sets)]


def test_jaccard(spark, docs, nothing, monkeypatch):
    key = lambda x: tuple(-1 if v is None else v for v in x)
    want = sorted(map(key, brute_jaccard(docs.collect())))
    assert any(w[3] for w in want)
    got = jaccard_join.jaccard_join(docs)
    assert sorted(map(key, map(tuple, got.collect()))) == want
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)  # large groups, in pairs of blocks
    got = jaccard_join.jaccard_join(docs)
    assert sorted(map(key, map(tuple, got.collect()))) == want
    kept = jaccard_join.keep_one(docs, got).collect()
    assert len(kept) == len({w[5] for w in want})
    assert jaccard_join.jaccard_join(nothing).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 75), (7, 7)]
    got = dict(map(tuple, jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(1, 31)} | {75: 50, 100: 50}


def brute_url(url):
    """Host, path, rule and its verdict, and the tokens of a URL."""
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = lower(host)
    fit = max((r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)), key=lambda r: len(r.host + r.path), default=None)
    tokens = {f"host={x}" for x in host.split(".") if x} | {f"path={x}" for x in path.split("/") if x}
    return host, path, fit and fit.host + fit.path, fit and fit.verdict, tokens


def brute_rules(rows, least, confidence):
    """(antecedent, verdict) -> (confidence, support) of all token sets that enough rows hold."""
    sets = Counter(frozenset(c) for tokens, v in rows if v and tokens for n in range(1, len(tokens) + 1) for c in itertools.combinations(sorted(tokens), n))
    known = [(t, v) for t, v in rows if v and t]
    out = {}
    for ante in (a for a, n in sets.items() if n >= least):
        for verdict in ("allow", "block"):
            n = sum(v == verdict and ante <= t for t, v in known)
            if n >= least and n / sets[ante] >= confidence:
                out[ante, verdict] = n / sets[ante], n / len(known)
    return out


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://Example.ORG/es/1?x", "https://a.example.org/en/12#t", "http://x.com/fr/2", "http://com/de/", "http://xcom/de/1", "http://a.net", "a://b://c/d", "http://example.org?q"]
    urls += [f"http://blog{i % 3}.site.com/{'de' if i % 2 else 'fr'}/p{i}" for i in range(60)] + ["http://blog1.site.net/de/9", "http://blog1.site.net/fr/9"]
    urls += ["http://long.example.org/" + "/".join(f"s{i}" for i in range(40))] * 7 + ["http://other.net/" + "/".join(f"s{i}" for i in range(40))]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, queries.URL_RULES).collect()}
    brute = [brute_url(u) for u in urls]
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(len(urls))] == [b[:3] for b in brute]
    assert brute[3][2:4] == ("example.org/es/", "block") and brute[4][2:4] == ("example.org/en/1", "block") and brute[5][2:4] == ("com/fr/", "allow") and brute[7][2] is None and brute[10][:3] == ("example.org", "", None)
    rules = brute_rules([(b[4], b[3]) for b in brute if len(b[4]) < 20] , 5, 0.9)
    for i, (_, _, rule, verdict, tokens) in enumerate(brute):
        if rule is None and len(tokens) < 20:
            held = {v for (ante, v) in rules if ante <= tokens}
            assert got[i]["verdict"] == "allow" if not held else got[i]["verdict"] in held
        elif rule:
            assert got[i]["verdict"] == verdict
    assert got[10]["verdict"] == "allow" or got[10]["confidence"] >= 0.9
    assert got[71]["verdict"] == "block" and got[72]["verdict"] == "allow"  # by mined rules
    assert got[len(urls) - 1]["verdict"] == "allow" and got[len(urls) - 1]["mined_rule"]  # as the other URL of 40 segments
    empty = url_filter.filter_urls(pages.limit(0), queries.URL_RULES)
    assert empty.count() == 0 and empty.columns.count("host") == 1


def test_mined_rules_brute_force(spark):
    rows = [(["a", "b"], "block")] * 8 + [(["a"], "allow")] * 6 + [(["b", "c"], "block")] * 5 + [(["c"], "allow")] * 2 + [(["d", "e", "f", "g"], "allow")] * 6 + [([], "allow"), (["a"], None)]
    table = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    want = {" ".join(sorted(a)) + f" verdict={v}": (round(c, 6), round(n, 6)) for (a, v), (c, n) in brute_rules([({*t}, v) for t, v in rows], 5, 0.6).items()}
    found = lambda **o: {r["rule_id"]: (round(r["confidence"], 6), round(r["support"], 6)) for r in url_filter.mine_rules(table, min_support=0.1, min_confidence=0.6, **o).collect()}
    assert found() == want and len(want) > 15
    few = lambda n: {k: v for k, v in want.items() if len(k.split()) <= n + 1}
    for longest in (1, 2, 3):  # all rules of so many tokens, in rows of any length, counted over all
        assert found(max_items=longest, longest=longest) == few(longest)
    some = found(max_items=3, longest=1)
    assert some.keys() >= few(1).keys() and some == {k: want[k] for k in some}
    assert found(least_rows=8).keys() == {k for k in want if round(want[k][1] * 27) >= 8}
    with pytest.raises(ValueError):
        found(max_items=2, longest=3)


def test_rules_of_rare_tokens_in_long_urls(spark):
    """Rows of 30 frequent tokens, the least frequent pair of which decides."""
    common = [f"c{i:02d}" for i in range(28)]
    rows = [([*common, "x", "y"], "block")] * 6 + [([*common, "x"], "allow")] * 6 + [([*common, "y"], "allow")] * 6 + [(common, "allow")] * 9
    rules = url_filter.mine_rules(spark.createDataFrame(rows, "tokens array<string>, verdict string"), min_support=0.1, min_confidence=0.9)
    got = {r["rule_id"]: r["confidence"] for r in rules.where("verdict = 'block'").collect()}
    assert got == {"x y verdict=block": 1.0}


def test_topk(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in rng.integers(-4, 5, 6) / 4]) for i in range(120)] + [(200, [1.0] * 6), (201, [1.0] * 6), (None, [1.0] * 6), (202, None), (203, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (204, [float("nan")] * 6), (205, [])]
    rows += [(7, [0.5] * 6), (7, [1.0] * 6), (100, [0.75] * 6), (200, [1.0] * 6)]  # repeated ids: rows of their own, queries too
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, row string, query int")
    good = [(i, np.floor(256 * np.array(v))) for i, v in rows if i is not None and v and None not in v and not np.isnan(v).any()]
    want = []
    for n, (i, q) in enumerate(good):
        if i % 50 == 0:
            best = sorted((-int(q @ c), j) for m, (j, c) in enumerate(good) if m != n)[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted(map(tuple, topk.exact_topk(table, F.col("vec_id") % 50 == 0).collect())) == sorted(want)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 2)
    assert sorted(map(tuple, topk.exact_topk(table, F.col("vec_id") % 50 == 0).collect())) == sorted(want)
    assert topk.exact_topk(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    with pytest.raises(ValueError):
        topk.exact_topk(spark.createDataFrame([(0, [1e9])], "vec_id long, embedding array<double>"), F.lit(True))


def test_packing(docs, nothing):
    got = packing.pack_documents(docs, capacity=50, per_source=2).collect()
    total = Counter()
    bins = {}
    for r in got:
        total[r["doc_id"]] += r["length"]
        bins.setdefault(r["bin"], []).append(r)
    want = Counter()
    for r in docs.collect():
        want[r["doc_id"]] += len(words(r["text"])) + 1
    assert total == want
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at <= 50 and (len(rows) == 1 or max(Counter(r["source"] for r in rows).values()) <= 2)
    assert packing.pack_documents(nothing).count() == 0


def test_packing_near_copies(spark, tmp_path):
    """Near copies, rows without id among them, and rows without words are one cluster each: a bin holds one of them."""
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["w%d" % n for n in range(500)], k=60)) for _ in range(6)]
    rows = [(i, "abcdef"[i // 6], texts[i // 6] + ["", " end", "\n"][i % 3]) for i in range(36)] + [(None, "n", texts[0].upper()), (None, "o", texts[1] + " other"), (90, "p", ""), (91, "q", " \n"), (92, "r", None)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op9_best_fit_packing(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    kind = lambda r: {"n": 0, "o": 1, "p": -1, "q": -1, "r": -1}.get(r["source"], (r["doc_id"] or 0) // 6)
    assert max(Counter((r["bin"], kind(r)) for r in got).values()) == 1


def test_token_codec(docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    docs = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame([(300, "one <|endoftext|> two"), (301, "<|endoftext|>")], "doc_id long, text string"))
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("tie")).collect()
    rows = [(r["doc_id"], r["text"]) for r in sorted(hashed, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["tie"]))]
    start, want = 0, []
    for d, text in rows:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes()
        want.append((d, start, len(ids) // 4, ids))
        start += len(ids) // 4
    got = token_codec.encode_corpus(docs, path).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in got] == want
    assert {r["doc_id"]: 50256 in np.frombuffer(bytes(r["ids"]), "<u4") for r in got if (r["doc_id"] or 0) >= 300} == {300: True, 301: True}
    assert token_codec.encode_corpus(nothing, path).count() == 0
