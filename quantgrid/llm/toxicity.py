"""Toxicity: a weighted finite-state pattern grammar that scores clauses.

A lexicon transducer maps words to classes, which are learned from labels beside short fixed lists: insults, hints (word
beginnings that only speak for toxicity where a text holds two such words or more), threats (words that speak for it in a clause with a
target), targets, negations and words of reported speech. Four small transducers read the classes of a clause, which ends with
a line or a mark such as a full stop: event (insult, threat or hint), target, negation and reported speech (each for some words
after it). Their composition is one table of states. Each event of a clause gives a kind, such as "insult at a target, not
negated, not reported", by the state that it leads to and by whether the clause holds a target. A document's score is a
logistic function of the kinds that it holds, and of which events it holds in several words that are neither negated nor
reported; the weights start from fixed prior weights and are fitted to labels.

Lexicon and weights are fitted on at most max_labelled labelled rows (those of the smallest hashes), a bound that keeps what
the driver sees small; every text is scored whole.
"""

from __future__ import annotations

import math
import string
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Words of the grammar in English, German, French and Spanish.
THREATS = "kill hurt destroy burn shoot töten vernichten umbringen tuer détruire matar destruir quemar".split()
TARGETS = "you your yours he she they them du dich dein ihr euch tu toi vous usted ustedes tú ellos".split()
NEGATIONS = "not never no isn't aren't don't nicht kein keine nie pas jamais nunca jamás".split()
REPORTS = "said says wrote quoted called sagte schrieb zitierte dit écrit cité dijo escribió citó".split()
#: Insults for use without any labels.
SEED_INSULTS = "idiot stupid moron scum loser pathetic worthless disgusting trash clown".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, HINT = range(7)
CLASSES = 7
EVENTS = (INSULT, THREAT, HINT)
ROLES = {"insult": INSULT, "threat": THREAT, "hint": HINT, "target": TARGET, "negation": NEGATION, "report": REPORT}
STOP = 8  # added to the class of a word that ends a clause
SCOPE = 3  # words that a negation covers
REPORTED = 8  # words that a word of reported speech covers
EDGES = string.punctuation + "¡¿«»“”„’…"
ENDS = (".", "!", "?", ";", ":")
LENGTHS = (4, 5, 6, 7, 8)
HARDLY = 50  # toxic texts to a clean one from which hardly any clean text holds a feature
BY_CHANCE = 0.01  # features that may enter the lexicon without reason, on average
SURE = 7  # toxic texts to a clean one that each feature of the lexicon needs
WORDS_KEPT = 300_000

#: Prior weights: of any text, of an event, of the other parts of its kind, and of several words of an event.
PRIOR = {"none": -3.0, "insult": 4.5, "threat": 3.5, "hint": 0.5, "target": 1.0, "negated": -2.5, "reported": -2.0, "insults": 0.5, "threats": 0.5, "hints": 4.0}
KINDS = [(e, t, n, r) for e in EVENTS for t in (0, 1) for n in (0, 1) for r in (0, 1)]
AIMED = 4  # a kind with a target comes so many places after the same without
BITS = len(KINDS) + len(EVENTS)  # of a text: its kinds, then the events that it holds in several words


class Fst(NamedTuple):
    """A deterministic transducer: from state 0, arcs (state, class) -> state; other classes stay. output names each state."""

    states: int
    arcs: dict[tuple[int, int], int]
    output: tuple[int, ...]

    def step(self, state: int, symbol: int) -> int:
        return self.arcs.get((state, symbol), state)


def event_fst() -> Fst:
    """The class of an event right after such a word, else 0."""
    return Fst(4, {(s, c): (0, *EVENTS).index(c) if c in EVENTS else 0 for s in range(4) for c in range(CLASSES)}, (0, *EVENTS))


def target_fst() -> Fst:
    return Fst(2, {(0, TARGET): 1}, (0, 1))


def scope_fst(opener: int, words: int) -> Fst:
    """States 1 to `words` count down the words that an opener still covers; those above stand for the same at a covered event."""
    left = lambda s: s if s <= words else s - words - 1
    arcs = {(s, c): max(left(s) - 1, 0) for s in range(2 * words + 1) for c in (OTHER, TARGET, NEGATION, REPORT)}
    arcs |= {(s, opener): words for s in range(2 * words + 1)}
    arcs |= {(s, c): words + left(s) if left(s) else 0 for s in range(2 * words + 1) for c in EVENTS}
    return Fst(2 * words + 1, arcs, (*[0] * (words + 1), *[1] * words))


def compose(*parts: Fst) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """The product of transducers that read one input: table[state, class] of reachable states, and each state's outputs."""
    index, queue, rows = {(0,) * len(parts): 0}, [(0,) * len(parts)], []
    for state in queue:
        row = []
        for symbol in range(CLASSES):
            to = tuple(p.step(s, symbol) for p, s in zip(parts, state))
            if to not in index:
                index[to] = len(index)
                queue.append(to)
            row.append(index[to])
        rows.append(row)
    return np.array(rows), [tuple(p.output[s] for p, s in zip(parts, state)) for state in queue]


class Lexicon(NamedTuple):
    """Words of each class; an insult or a hint that doesn't end with $ is a beginning."""

    insults: tuple[str, ...] = ()
    hints: tuple[str, ...] = ()
    threats: tuple[str, ...] = tuple(THREATS)
    targets: tuple[str, ...] = tuple(TARGETS)
    negations: tuple[str, ...] = tuple(NEGATIONS)
    reports: tuple[str, ...] = tuple(REPORTS)


class Grammar:
    """Lexicon and composed table, ready to read texts. Classes named in `without` are not read."""

    def __init__(self, lexicon: Lexicon, without: frozenset[str] = frozenset()):
        off = {ROLES[x] for x in without}
        starts = [(x, c) for c, words in ((HINT, lexicon.hints), (INSULT, lexicon.insults)) for x in words if not x.endswith("$")]
        self.starts = {x: c for x, c in starts if c not in off}
        self.lengths = sorted({len(x) for x in self.starts})
        wholes = ((lexicon.threats, THREAT), (lexicon.targets, TARGET), (lexicon.negations, NEGATION), (lexicon.reports, REPORT))
        words = {w: c for words, c in wholes for w in words} | {x[:-1]: c for c, words in ((HINT, lexicon.hints), (INSULT, lexicon.insults)) for x in words if x.endswith("$")}
        self.words = {w: c for w, c in words.items() if c not in off}
        table, outputs = compose(event_fst(), target_fst(), scope_fst(NEGATION, SCOPE), scope_fst(REPORT, REPORTED))
        self.table = table.tolist()
        self.kind = [KINDS.index((e, 0, n, r)) if e else -1 for e, _, n, r in outputs]  # of an event, before the target is known
        self.aimed = [t * AIMED for _, t, _, _ in outputs]
        self.after = [np.arange(len(table))]  # after[n][state]: the state n other words later
        for _ in range(max(SCOPE, REPORTED) + 1):
            self.after.append(table[self.after[-1], OTHER])
        self.after = [x.tolist() for x in self.after]
        self.known: dict[str, int] = {}

    def classify(self, token: str) -> int:
        """The class of a lower-cased token, plus STOP if a clause ends with it."""
        word = token.strip(EDGES)
        found = self.words.get(word, OTHER)
        if found == OTHER:  # of several beginnings an insult counts before a hint
            classes = {self.starts[word[:n]] for n in self.lengths if n <= len(word) and word[:n] in self.starts}
            found = INSULT if INSULT in classes else HINT if classes else OTHER
        return found + STOP * (token.endswith(ENDS) or not word)

    def clauses(self, text: str) -> Iterator[tuple[list[str], list[tuple[int, int]]]]:
        """For each clause with events: the tokens of its line, and the (place, kind) of its events."""
        lines = [line.split() for line in text.lower().splitlines()]
        known = self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        for new in set().union(*lines).difference(known):
            known[new] = self.classify(new)
        table, kind, aimed, after = self.table, self.kind, self.aimed, self.after
        for tokens in lines:
            state = last = 0
            held: list[tuple[int, int]] = []
            for i, c in [(i, c) for i, c in enumerate(map(known.__getitem__, tokens)) if c]:
                if state:
                    state = after[min(i - last, len(after) - 1)][state]
                state = table[state][c & 7]
                if kind[state] >= 0:
                    held.append((i, kind[state]))
                last = i + 1
                if c >= STOP:
                    if held:
                        yield tokens, [(i, k + aimed[state]) for i, k in held]
                        held = []
                    state = 0
            if held:
                yield tokens, [(i, k + aimed[state]) for i, k in held]

    def kinds_of(self, text: str) -> int:
        """The kinds of events that a text's clauses hold, and the events that it holds in several words, as a bit set."""
        out, first = 0, {}
        for tokens, events in self.clauses(text):
            for i, k in events:
                out |= 1 << k
                event, _, negated, reported = KINDS[k]
                if not (negated or reported) and first.setdefault(event, word := tokens[i].strip(EDGES)) != word:
                    out |= 1 << (len(KINDS) + EVENTS.index(event))
        return out


def features_of(text: str | None) -> set[str]:
    """Beginnings of the text's distinct words, and whole words ended with $; + for beginnings of several words, @ for words in a clause with a target."""
    low = (text or "").lower()
    words = {t.strip(EDGES) for t in {*low.split()}}
    starts = [w[:n] for w in words for n in LENGTHS if len(w) > n]
    out = {*starts} | {f"{w}$" for w in words if len(w) >= 3}
    out.update(f"{f}+" for f, n in Counter(starts).items() if n > 1)
    if not words.isdisjoint(TARGETS):
        clause: list[str] = []
        for tokens in (line.split() for line in low.splitlines()):
            for n, t in enumerate(tokens):
                clause.append(t.strip(EDGES))
                if t.endswith(ENDS) or not clause[-1] or n + 1 == len(tokens):
                    if not set(TARGETS).isdisjoint(clause):
                        out.update(f"{w}@" for w in clause if len(w) >= 3)
                    clause = []
    return out


def feature_rows(among: frozenset[str] | None) -> Callable:
    """(feature, n): rows whose text holds it; only features of `among`, if given."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                found = features_of(text)
                counts.update(found if among is None else found & among)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["feature", "n"])

    return rows


def copy_key(text: str | None) -> int:
    """The least hash of three words in a row: mostly the same for near copies of a text, another one for other texts."""
    words = (text or "").lower().split()
    return min(zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "replace")) for i in range(max(1, len(words) - 2)))


def holding_rows(among: frozenset[str]) -> Callable:
    """(features, copy): the features of `among` that each text holds, and its copy_key."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            found = [sorted(features_of(t) & among) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), pa.array([copy_key(t) for t in texts], pa.int64())], ["features", "copy"])

    return rows


def choose_insults(texts: list[list[str]], least: int) -> list[str]:
    """Features that together explain the toxic texts: each next one is in most of those that have none yet, `least` at least.

    Of features in the same texts a word or beginning is taken before a hint or threat, then the longest. Words that merely go with insults, as in copies of one text, explain
    nothing new and are left out here; add_own brings those in that are insults by themselves.
    """
    held: dict[str, set[int]] = {}
    for i, found in enumerate(texts):
        for f in found:
            held.setdefault(f, set()).add(i)
    chosen: list[str] = []
    while held:
        best = max(held, key=lambda f: (len(held[f]), f[-1] not in "+@", len(f), f))
        if len(held[best]) < least:
            break
        chosen.append(best)
        done = held.pop(best)
        held = {f: rest for f, of in held.items() if (rest := of - done)}
    return sorted(chosen)


def overlap(a: str, b: str) -> bool:
    """Whether one feature is a beginning of the other."""
    a, b = a.rstrip("$+@"), b.rstrip("$+@")
    return a.startswith(b) or b.startswith(a)


def add_own(chosen: list[str], held: dict[str, set[int]], enough: float) -> list[str]:
    """The chosen features and those of `held` that are in `enough` texts, whatever other insults these texts hold.

    Of overlapping beginnings a further one comes in only for `enough` texts without those that are in.
    """
    out, texts = list(chosen), {f: held.get(f, set()) for f in chosen}
    for f in sorted(held.keys() - texts.keys(), key=lambda f: (-len(held[f]), -len(f), f)):
        if len(held[f]) >= enough and len(held[f].difference(*(texts[g] for g in out if overlap(f, g)))) >= enough:
            out.append(f)
            texts[f] = held[f]
    return sorted(out)


def context_rows(lexicon: Lexicon) -> Callable:
    """(role, word, toxic, n): texts by what stands near their events.

    "near" and "far": words that stand at most SCOPE or REPORTED words before each insult or threat of the text; "around":
    words of the clause of a text's only event. The word "" counts all texts that have such events.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, counts = Grammar(lexicon), Counter()
        for batch in batches:
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                near, far, around, events = [], [], set(), 0
                for tokens, held in grammar.clauses(text or ""):
                    for i, k in held:
                        begin = i
                        while begin and not tokens[begin - 1].endswith(ENDS) and tokens[begin - 1].strip(EDGES):
                            begin -= 1
                        before = [t.strip(EDGES) for t in tokens[begin:i]]
                        if KINDS[k][0] != HINT:
                            near.append({*before[-SCOPE:]})
                            far.append({*before[-REPORTED:]})
                        around |= {*before}
                        events += 1
                for role, words in (("near", set.intersection(*near) if near else None), ("far", set.intersection(*far) if far else None), ("around", around if events == 1 else None)):
                    if words is not None:
                        counts.update((role, w, toxic) for w in words | {""})
        columns = list(zip(*(key + (n,) for key, n in counts.items()))) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64()))], ["role", "word", "toxic", "n"])

    return rows


def binomial_tail(n: int, k: int, p: float) -> float:
    """The chance of k or fewer hits in n trials of chance p."""
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1:
        return 0.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    return math.fsum(map(math.exp, log))


def choose_contexts(counts: dict[tuple[str, str], tuple[int, int]]) -> dict[str, list[str]]:
    """Words by role from (role, word) -> (clean, toxic) texts.

    near, far: words with which texts are toxic more rarely than chance explains, by half at least; around: more often.
    """
    out: dict[str, list[str]] = {"near": [], "far": [], "around": []}
    for role, chosen in out.items():
        clean, toxic = counts.get((role, ""), (0, 0))
        words = [(w, *n) for (r, w), n in counts.items() if r == role and w]
        if not words or not clean + toxic:
            continue
        usual = min(max(toxic / (clean + toxic), 0.01), 0.99)
        for w, c, t in words:
            rarely = t <= 0.5 * usual * (c + t) and binomial_tail(c + t, t, usual) * len(words) < BY_CHANCE
            often = c <= 0.5 * (1 - usual) * (c + t) and binomial_tail(c + t, c, 1 - usual) * len(words) < BY_CHANCE
            if often if role == "around" else rarely:
                chosen.append(w)
        chosen.sort()
    return out


def fit_weights(kinds: np.ndarray, toxic: np.ndarray, n: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Logistic weights of (none, each kind, each event in several words) from counts of rows by kind set and label, drawn to the prior weights."""
    name = {INSULT: "insult", THREAT: "threat", HINT: "hint"}
    prior = [PRIOR["none"]] + [PRIOR[name[e]] + t * PRIOR["target"] + g * PRIOR["negated"] + r * PRIOR["reported"] for e, t, g, r in KINDS]
    prior = np.array(prior + [PRIOR[name[e] + "s"] for e in EVENTS])
    x = np.concatenate([np.ones((len(kinds), 1)), (kinds[:, None] >> np.arange(BITS)) & 1], 1).astype(float)
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (toxic - p)) - strength * (w - prior)
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model(NamedTuple):
    lexicon: Lexicon
    weights: np.ndarray
    without: frozenset[str] = frozenset()


def kind_rows(lexicon: Lexicon, without: frozenset[str]) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon, without)
        for batch in batches:
            found = [grammar.kinds_of(t or "") for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(found, pa.int64())], ["toxic", "kinds"])

    return rows


def learn_lexicon(sample: DataFrame, *, min_texts: int, ratio: float) -> Lexicon:
    """Insults, hints and threats, then the words that change what these say, from (text, toxic)."""
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not sizes.get(1):
        return Lexicon(tuple(SEED_INSULTS))
    counted = lambda df, among: df.select("text").mapInArrow(feature_rows(among), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    toxic = {r["feature"]: r["n"] for r in counted(sample.where("toxic = 1"), None).where(F.col("n") >= min_texts).collect()}
    clean = {r["feature"]: r["n"] for r in counted(sample.where("toxic = 0"), frozenset(toxic)).collect()}
    share = lambda n, of: (n + 0.5) / (of + 1)
    likely = lambda f, n: n >= SURE * clean.get(f, 0) and share(n, sizes[1]) >= ratio * share(clean.get(f, 0), sizes.get(0, 0))
    features = frozenset(f for f, n in toxic.items() if likely(f, n))
    texts = sample.where("toxic = 1").select("text").mapInArrow(holding_rows(features), "features array<string>, copy long").collect()
    least = max(min_texts, sizes[1] // 250)
    chosen = choose_insults([r["features"] for r in texts], least)
    held: dict[str, set[int]] = {}
    for r in texts:
        for f in r["features"]:
            held.setdefault(f, set()).add(r["copy"])
    own = {f: of for f, of in held.items() if f in chosen or (f[-1] not in "+@" and clean.get(f, 0) * HARDLY <= len(of))}
    # So many texts that, drawn from all, hold no clean one hardly ever, for as many features as were counted.
    enough = math.log(len(toxic) / BY_CHANCE) / math.log1p(sizes.get(0, 0) / sizes[1]) if sizes.get(0) else math.inf
    chosen = add_own(chosen, own, max(least, enough))
    of_mark = lambda mark: tuple(f[:-1] for f in chosen if f[-1] == mark)
    insults = tuple(f for f in chosen if f[-1] not in "+@")
    lexicon = Lexicon(insults if chosen else tuple(SEED_INSULTS), of_mark("+"), (*THREATS, *of_mark("@")))
    counts: dict[tuple[str, str], tuple[int, int]] = {}
    seen = sample.mapInArrow(context_rows(lexicon), "role string, word string, toxic int, n long").groupBy("role", "word").agg(F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"))
    for r in seen.where(F.col("c") + F.col("t") >= min_texts).collect():
        counts[r["role"], r["word"]] = r["c"], r["t"]
    words = choose_contexts(counts)
    near = tuple(w for w in words["near"] if w not in TARGETS)
    far = tuple(w for w in words["far"] if w not in TARGETS and w not in near)
    around = tuple(w for w in words["around"] if w not in near + far)
    return lexicon._replace(negations=(*NEGATIONS, *near), reports=(*REPORTS, *far), targets=(*TARGETS, *around))


def fit(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 20_000, min_texts: int = 3, ratio: float = 15.0, without: frozenset[str] = frozenset()) -> Model:
    """Learn from docs (doc_id, text) whose id labels (doc_id, toxic) has; null labels and ids are left out.

    An id with several labels counts as toxic if one of them says so. Without labelled texts the seed lexicon and the prior
    weights serve. Classes named in `without` (insult, threat, hint, target, negation, report) are switched off. Other columns
    of the two tables don't matter.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").alias("__toxic"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)
    texts = docs.select(F.col("doc_id").alias("__doc"), "text")
    sample = materialize(texts.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).select("text", F.col("__toxic").cast("int").alias("toxic")))
    lexicon = learn_lexicon(sample, min_texts=min_texts, ratio=ratio)
    seen = sample.mapInArrow(kind_rows(lexicon, without), "toxic int, kinds long").groupBy("toxic", "kinds").count().collect()
    columns = [np.array([r[c] for r in seen], np.int64) for c in ("kinds", "toxic", "count")]
    return Model(lexicon, fit_weights(*columns), without)


def score_rows(model: Model, text: str, out: str) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, bits = Grammar(model.lexicon, model.without), np.arange(BITS)
        for batch in batches:
            kinds = np.array([grammar.kinds_of(t or "") for t in batch[text].to_pylist()], np.int64)
            logit = model.weights[0] + ((kinds[:, None] >> bits) & 1) @ model.weights[1:]
            yield batch.append_column(out, pa.array(1 / (1 + np.exp(-logit)), pa.float64()))

    return rows


def score_texts(docs: DataFrame, model: Model, *, text: str = "text", out: str = "score") -> DataFrame:
    """Add the column `out`, 0 to 1, to each row; only the text counts. Null and empty texts hold no clause. A column of this name is replaced."""
    docs = docs.drop(out)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(score_rows(model, text, out), f"{fields}, `{out}` double")
