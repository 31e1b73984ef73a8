"""Personal data in texts: fixed patterns, and a linear-chain conditional random field for what these miss.

The field labels tokens (runs of letters, runs of digits, single marks) by their shapes, their neighbours' shapes and a few cue
words. It is trained on a small labelled table on the driver, and tasks decode by Viterbi, many sequences at once in numpy.
Sequences are the surroundings of digits, at-signs and spelled-out ones, within a line; a text of any length is searched whole.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

KINDS = ("email", "ip", "card", "phone")
SPAN = "struct<kind: string, start: int, end: int, method: string>"
AROUND = 64  # code points of context on both sides of what could be personal data
LONGEST = 1 << 15  # code points of a sequence
AT_ONCE = 1 << 17  # tokens decoded at once

# Fixed values of the patterns that every text is searched for, and of what the field looks at.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
CARD_LIKE = re.compile("[0-9](?:[ ./_-]{0,3}[0-9])+")
PHONE_LIKE = re.compile("[+]?[(]?[0-9][ ().0-9/-]*[0-9]")
HAS_DIGIT = re.compile("[0-9]")
LOCAL_CHARS = [bool(re.match("[A-Za-z0-9._%+-]", chr(i))) for i in range(128)]
ANCHOR = re.compile("[0-9@]+")
SPELLED = re.compile(r"[0-9@]+|dot|[(\[{<] ?at ?[)\]}>]", re.IGNORECASE)
SPELLED_PARTS = ("dot", "at)", "at]", "at}", "at>", "at )", "at ]", "at }", "at >")


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def small_parts(text: str, most: int = 255) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:] or 0) <= most for p in text.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, place in KINDS) of the patterns' matches, leftmost and non-overlapping in each kind, in order."""
    out, at, after = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > after and LOCAL_CHARS[ord(text[start - 1]) & 127] and text[start - 1] < "\x80":
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        after = m.end() if m else after
        if m:
            out.append((start, after, 0))
        at = text.find("@", max(at + 1, after))
    if HAS_DIGIT.search(text):
        out += [(*m.span(), 1) for m in IP.finditer(text) if small_parts(m.group())]
        out += [(*m.span(), 2) for m in CARD.finditer(text) if len(m.group()) >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            out += [(*m.span(), 3) for m in PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def windows(text: str) -> list[tuple[int, int]]:
    """The parts of a text that are decoded: what lies AROUND digits, at-signs and spelled ones, joined where these meet in a line.

    A part begins and ends at white space or a line end where there is some. Longer parts than LONGEST are cut.
    """
    spots: list[list[int]] = []
    low = text.lower()
    for m in (SPELLED if any(p in low for p in SPELLED_PARTS) else ANCHOR).finditer(text):
        if spots and m.start() - spots[-1][1] <= 2 * AROUND and text.find("\n", spots[-1][1], m.start()) < 0:
            spots[-1][1] = m.end()
        else:
            spots.append([m.start(), m.end()])
    out = []
    for first, last in spots:
        line = text.rfind("\n", max(0, first - AROUND), first) + 1
        start, stop = line or max(0, first - AROUND), text.find("\n", last, last + AROUND)
        if not line and start:
            space = text.find(" ", start, first)
            start = space + 1 if space >= 0 else start
        if stop < 0:
            stop = min(len(text), last + AROUND)
            space = text.rfind(" ", last, stop) if stop < len(text) else -1
            stop = space if space >= 0 else stop
        while stop - start > LONGEST:
            space = text.rfind(" ", start + 1, start + LONGEST)
            cut = space if space >= 0 else start + LONGEST
            out.append((start, cut))
            start = cut
        out.append((start, stop))
    return out


TOKEN = re.compile(r"[0-9]+|[^\W0-9_]+|\S")
# Fixed words that personal data goes with, and ends of host names.
CUES = {
    "at": "at arroba",
    "dot": "dot punkt punto",
    "mail": "mail email correo courriel contact kontakt contacto write",
    "phone": "tel phone call fax mobile cell telefon telefono teléfono tél téléphone telephone handy móvil ring dial whatsapp",
    "card": "card visa mastercard amex credit karte kreditkarte carte tarjeta",
    "host": "ip ipv host server addr address login peer client",
    "tld": "com org net edu info io gov",
    "number": "order invoice isbn version page section id serial ref no nr build chapter total",
}
CUE = {word: name for name, words in CUES.items() for word in words.split()}
MARKS = set("@.+-()[]{}<>:;,/_%#=\"'*|")


def shape(token: str) -> tuple[str, str]:
    """(fine, coarse) shape of a token."""
    c = token[0]
    if "0" <= c <= "9":
        n = len(token)
        size = str(n) if n <= 6 else next(name for most, name in ((8, "7"), (10, "9"), (13, "11"), (19, "14"), (n, "20")) if n <= most)
        return f"d{size}{'b' if n == 3 and token > '255' else ''}{'z' if c == '0' and n > 1 else ''}", "d" if n <= 4 else "D"
    if c.isalpha():
        cue = CUE.get(token.lower())
        kind = "l" if token.islower() else "U" if token.isupper() else "C"
        return cue or f"{kind}{min(len(token), 3)}", cue if cue in ("at", "dot") else "w"
    mark = c if c in MARKS else "other"
    return mark, mark


class Tokens(NamedTuple):
    """The tokens of one sequence: places in it, fine and coarse shapes, whether white space comes before, group flags."""

    start: list[int]
    end: list[int]
    fine: list[str]
    coarse: list[str]
    gap: list[bool]
    flag: list[str]


def flags(words: list[str], coarse: list[str], gap: list[bool]) -> list[str]:
    """Marks what four groups of a card number, one long one, or four small numbers between dots make together."""
    out = [""] * len(words)
    numbers = [i for i, c in enumerate(coarse) if c in "dD"]
    for k, i in enumerate(numbers):
        word = words[i]
        if 14 <= len(word) <= 19 and luhn(word):
            out[i] = "card1"
        quad = numbers[k : k + 4]
        if len(quad) < 4 or quad[3] - i > 12 or out[i]:
            continue
        group = [words[j] for j in quad]
        between = [words[a + 1 : b] for a, b in zip(quad, quad[1:])]
        if [len(g) for g in group] == [4] * 4 and luhn("".join(group)) and all(len(b) <= 1 for b in between):
            for j in quad:
                out[j] = "card4" if j == i else "card4+"
        elif all(len(g) <= 3 and int(g) <= 255 for g in group) and all(b and len(b) <= 3 and any(x == "." or CUE.get(x.lower()) == "dot" for x in b) for b in between):
            for j in quad:
                out[j] = "quad" if j == i else "quad+"
    return out


def tokens(text: str) -> Tokens:
    found = [m.span() for m in TOKEN.finditer(text)]
    words = [text[a:b] for a, b in found]
    shapes = [shape(w) for w in words]
    gap = [i == 0 or found[i - 1][1] < a for i, (a, _) in enumerate(found)]
    coarse = [c for _, c in shapes]
    return Tokens([a for a, _ in found], [b for _, b in found], [f for f, _ in shapes], coarse, gap, flags(words, coarse, gap))


def features(t: Tokens) -> list[tuple[str, ...]]:
    """The features of each token: own shape and flag, neighbours' shapes, and cues among the five tokens before."""
    n = len(t.fine)
    fine = ["", "", *t.fine, "", ""]
    coarse = ["", "", *t.coarse, "", ""]
    gap = [*t.gap, True, True]
    out, last, seen = [], -9, ""
    for i in range(n):
        before, after = " _"[t.gap[i]], " _"[gap[i + 1]]
        out.append((
            "0" + fine[i + 2],
            "1" + before + fine[i + 1],
            "2" + after + fine[i + 3],
            "3" + coarse[i] + before + coarse[i + 1],
            "4" + after + coarse[i + 3] + coarse[i + 4],
            "5" + coarse[i + 1] + before + coarse[i + 2] + after + coarse[i + 3],
            "6" + t.flag[i] + fine[i + 2],
            "7" + (seen if i - last <= 5 else "") + coarse[i + 2],
        ))
        if t.fine[i] in CUES:
            last, seen = i, t.fine[i]
    return out


LABELS = ["O"] + [f"{x}-{k}" for k in KINDS for x in "BI"]
#: allowed[a, b]: label b can follow label a; the last row stands for the beginning.
ALLOWED = np.array([[not b.startswith("I") or a[1:] == b[1:] for b in LABELS] for a in [*LABELS, "start"]])


class Model(NamedTuple):
    """places: row of emit for each feature, 0 for unknown ones; emit (features, labels); follow (labels + 1, labels)."""

    places: dict[str, int]
    emit: np.ndarray
    follow: np.ndarray


def _places(model_places: dict[str, int], rows: list[tuple[str, ...]]) -> np.ndarray:
    return np.array([[model_places.get(f, 0) for f in row] for row in rows], np.int64).reshape(len(rows), -1)


def train(rows: list[tuple[str, list[tuple[int, int, str]]]], rounds: int = 100, rate: float = 0.15, penalty: float = 0.02) -> Model:
    """Maximum likelihood with a quadratic penalty, by Adam over the whole table; rows are (text, [(start, end, kind)])."""
    seqs, gold, places = [], [], {"": 0}
    for text, spans in rows:
        t = tokens(text)
        label = [0] * len(t.start)
        for start, end, kind in spans:
            inside = [i for i, (a, b) in enumerate(zip(t.start, t.end)) if a < end and b > start]
            for i in inside:
                label[i] = LABELS.index(f"{'B' if i == inside[0] else 'I'}-{kind}")
        if label:
            seqs.append(features(t))
            gold.append(label)
    for row in seqs:
        for names in row:
            for f in names:
                places.setdefault(f, len(places))
    n_labels = len(LABELS)
    emit, follow = np.zeros((len(places), n_labels)), np.zeros((n_labels + 1, n_labels))
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))  # the longest first: those at work are a prefix
    sizes = np.array([len(seqs[i]) for i in order], np.int64)
    if len(sizes):
        first = np.cumsum(sizes) - sizes
        ids = np.concatenate([_places(places, seqs[i]) for i in order])
        label = np.concatenate([gold[i] for i in order])
        before = np.concatenate([[n_labels], label[:-1]])
        before[first] = n_labels
        true = [np.zeros_like(emit), np.zeros_like(follow)]
        np.add.at(true[0], (ids, label[:, None]), 1)
        np.add.at(true[1], (before, label), 1)
        by_feature = np.argsort(ids.ravel(), kind="stable")
        used, at = np.unique(ids.ravel()[by_feature], return_index=True)
        token = by_feature // ids.shape[1]
        live = [int(n) for n in np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")]
        moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (emit, follow)]
    for turn in range(1, rounds + 1 if len(sizes) else 1):
        # Probabilities, scaled at every step, so that a step is a product of matrices.
        x = emit[ids].sum(1)
        x = np.exp(x - x.max(1, keepdims=True))
        step = np.where(ALLOWED, np.exp(follow), 0.0)
        ahead, back, scale = np.zeros_like(x), np.ones_like(x), np.ones(len(x))
        for s, n in enumerate(live):
            here = first[:n] + s
            p = (ahead[here - 1] @ step[:-1] if s else step[-1]) * x[here]
            scale[here] = p.sum(1)
            ahead[here] = p / scale[here, None]
        expected = [np.zeros_like(emit), np.zeros_like(follow)]
        for s in range(len(live) - 1, 0, -1):
            here = first[: live[s]] + s
            back[here - 1] = (back[here] * x[here] / scale[here, None]) @ step[:-1].T
            expected[1][:-1] += (ahead[here - 1].T @ (back[here] * x[here] / scale[here, None])) * step[:-1]
        share = ahead * back
        expected[1][-1] = share[first].sum(0)
        expected[0][used] = np.add.reduceat(share[token], at, axis=0)
        for w, (m, v), t, e in zip((emit, follow), moments, true, expected):
            slope = e - t + penalty * w
            m += 0.1 * (slope - m)
            v += 0.01 * (slope * slope - v)
            w -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    emit[0] = 0
    return Model(places, emit.astype(np.float32), np.where(ALLOWED, follow, -1e9).astype(np.float32))


def viterbi(model: Model, seqs: list[np.ndarray]) -> list[np.ndarray]:
    """The best labels of each sequence of feature places. Sequences go step by step together, the longest first."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    sizes = np.array([len(seqs[i]) for i in order])
    first = np.cumsum(sizes) - sizes
    emit = model.emit[np.concatenate([seqs[i] for i in order])].sum(1) if len(seqs) and sizes[0] else np.zeros((0, len(LABELS)), np.float32)
    out: list[np.ndarray] = [np.zeros(len(s), np.int64) for s in seqs]
    live = [int(n) for n in np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")]
    score, came = None, []
    ends: list[np.ndarray] = []
    for s, n in enumerate(live):
        if s == 0:
            score = emit[first[:n]] + model.follow[-1]
        else:
            paths = score[:n, :, None] + model.follow[:-1]
            came.append(paths.argmax(1).astype(np.int8))
            score = np.concatenate([paths.max(1) + emit[first[:n] + s], score[n:]])
        ends = score
    if not live:
        return out
    label, whole = ends.argmax(1), np.zeros(len(emit), np.int64)
    for s in range(len(live) - 1, -1, -1):
        n = live[s]
        whole[first[:n] + s] = label[:n]
        if s:
            label[:n] = came[s - 1][np.arange(n), label[:n]]
    for k, i in enumerate(order):
        out[i] = whole[first[k] : first[k] + sizes[k]]
    return out


def plausible(kind: int, text: str) -> bool:
    """What a span that the field finds must be: else it isn't one."""
    digits = _digits(text)
    if kind == 0:
        names = [w.lower() for w in TOKEN.findall(text)]
        return any(w == "@" or CUE.get(w) == "at" for w in names[1:]) and any(w == "." or CUE.get(w) == "dot" for w in names[2:-1])
    if kind == 1:
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return bool(CARD_LIKE.fullmatch(text)) and 14 <= len(digits) <= 19 and luhn(digits)
    return bool(PHONE_LIKE.fullmatch(text)) and 9 <= len(digits) <= 15


def spans_of(t: Tokens, labels: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, end, place in KINDS) of the labelled runs."""
    i, labels = 0, labels.tolist()
    while i < len(labels):
        kind, j = (labels[i] - 1) // 2, i + 1
        if labels[i]:
            while j < len(labels) and labels[j] == 2 * kind + 2:
                j += 1
            yield t.start[i], t.end[j - 1], kind
        i = j


def find_in_texts(texts: list[str], model: Model) -> list[list[tuple[int, int, int, str]]]:
    """(start, end, place in KINDS, method) of each text, in order; added spans don't overlap those of the patterns."""
    out = [[(*s, "base") for s in base_spans(text)] for text in texts]
    held: list[tuple[int, int, Tokens, np.ndarray]] = []
    count = 0

    def decode() -> None:
        for (row, offset, t, _), labels in zip(held, viterbi(model, [h[3] for h in held])):
            base = [s for s in out[row] if s[3] == "base"]
            for start, end, kind in spans_of(t, labels):
                start, end = start + offset, end + offset
                if plausible(kind, texts[row][start:end]) and not any(s[0] < end and s[1] > start for s in base):
                    out[row].append((start, end, kind, "crf"))
        held.clear()

    for row, text in enumerate(texts):
        for start, stop in windows(text):
            t = tokens(text[start:stop])
            if t.start:
                held.append((row, start, t, _places(model.places, features(t))))
                count += len(t.start)
            if count > AT_ONCE:
                decode()
                count = 0
    decode()
    return [sorted(spans, key=lambda s: (s[0], s[2])) for spans in out]


# Fixed forms of which the labelled table is made. 9 stands for a digit, w for a word, C for a card number, B for 0 to 255.
FORMS = {
    "email": ["w.99@w9.example.com", "w@w.org", "w_w@w.co.uk", "w.w@w.example.net", "w (at) w (dot) com", "w [at] w [dot] org", "w at w dot com", "w.w at w dot org", "w AT w DOT com", "w{at}w{dot}net", "w@w dot com", "w (at) w.com", "w.9 [at] w-w.example.com", "w @ w . com", "w.99 at w9 dot example dot com", "w(at)w.example.com", "w[at]w[dot]com", "w <at> w <dot> org"],
    "ip": ["B.B.B.B", "B.B.B.B", "B[.]B[.]B[.]B", "B(.)B(.)B(.)B", "B . B . B . B", "B dot B dot B dot B", "B [dot] B [dot] B [dot] B"],
    "card": ["C", "C", "CCCC-CCCC-CCCC-CCCC", "CCCC CCCC CCCC CCCC", "CCCC.CCCC.CCCC.CCCC", "CCCC/CCCC/CCCC/CCCC", "CCCC_CCCC_CCCC_CCCC"],
    "phone": ["+1 (999) 555-9999", "+9 (999) 999-9999", "+99 999 9999999", "+99-999-999-9999", "(999) 555-9999", "(999) 999-9999", "999-555-9999", "999-999-9999", "999.999.9999", "0099 99 9999 9999", "00 99 999 9999999", "1-999-999-9999", "+1.999.555.9999", "(0999) 999999", "+99 (0) 999 999999", "+1/999/555/9999", "1 (999) 555-9999", "0999 999 9999", "0999/9999999"],
    "": ["9999-09-19", "19.09.2099", "09/19/1999", "19:39", "9.9.9", "9.99", "$99.99", "99%", "9999", "99", "999", "99999", "999999", "9999999", "99999999", "999999999", "9999999999", "99999999999", "999999999999", "9999999999999999", "9999999999999999", "9999999999999999", "978-9-99-999999-9", "#999999", "@w", "http://w.example.com/w9", "w9", "99 w", "1999-2009", "9,999,999", "99 x 99", 'token = "9a9b99c9d99e9f9a99b"', "key = 'a99bb9c99d9e9f99'", "v9.9", "(9)", "[99]", "9.9", "999.999.99.999", "999.999.9.99", "w at w", "a w dot", "dot w", "w at 9 w", "w at 99 dot", "999 w 99", "9.", "AA999999", "9e-99", "999-99-9999x", "p. 999", "99-99", "9/9", "| 999 | 99 | 9999 |", "w dot w dot w", "look at the w dot", "(c) 1999-2009", "(9999)", "1999-2009, 99.9.9", "9999999999999999 999"],
}
BEFORE = {"email": ["mail", "write to", "contact", "E-Mail:", "from", ""], "ip": ["host", "from", "server", "IP", "", ""], "card": ["card", "visa", "paid with", "", ""], "phone": ["call", "tel.", "phone:", "fax", "Tel", "", ""], "": ["order", "page", "in", "on", "version", "no.", "", "", ""]}


def _card(rng: random.Random) -> str:
    head = str(rng.randint(3, 6)) + "".join(str(rng.randint(0, 9)) for _ in range(14))
    return next(head + str(d) for d in range(10) if luhn(head + str(d)))


def example_rows(rows: int = 900, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """A small labelled table made of FORMS by rule: invented words around one to three of the forms in each row."""
    rng = random.Random(seed)
    syllables = "the an re ti on ent ou la el ci qué ón er sch ei ü en au é ai tion ing".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    some = lambda: [rng.choice([word(), word(), word().capitalize(), word() + rng.choice(",.;:!"), "of", "and", "at", "the"]) for _ in range(rng.randint(0, 6))]
    ascii_word = lambda: "".join(rng.choice("abcdefghilmnoprstuvw") for _ in range(rng.randint(2, 9)))

    def fill(form: str, kind: str) -> str:
        card, out = iter(_card(rng)), []
        for c in form if form != "C" else "C" * 16:
            free = kind != "" or "w" in form
            out.append(str(rng.randint(0, 9)) if c == "9" else ascii_word() if c == "w" and free else str(rng.choice([rng.randint(0, 255), rng.randint(1, 99)])) if c == "B" else next(card) if c == "C" else c)
        return "".join(out)

    out = []
    kinds = ["email", "ip", "card", "phone", "", "", ""]
    for _ in range(rows):
        text, spans = " ".join(some()), []
        for _ in range(rng.choice([1, 1, 1, 2, 2, 3])):
            kind = rng.choice(kinds)
            form = rng.choice(FORMS[kind])
            value = fill(form, kind)
            if kind == "" and (base_spans(value) or (form.startswith("999999999999") and luhn(_digits(value)[:16]))):
                continue
            text = f"{text} {rng.choice(BEFORE[kind])}".strip()
            text += rng.choice([" ", " ", " ", ": ", ' "', " | ", "" if kind == "phone" else " ("]) if text else ""
            if kind:
                spans.append((len(text), len(text) + len(value), kind))
            text += value + rng.choice(["", "", "", ".", ",", ")", '"', "!!", "***", "%%%", " |", "$$$"])
            text += " " + " ".join(some()) if rng.random() < 0.8 else ""
        out.append((text, spans))
    return out


def example_table(spark: SparkSession, rows: int = 900, seed: int = 5) -> DataFrame:
    """(text, spans) of example_rows; spans is an array of (kind, start, end)."""
    made = [(text, [(k, a, b) for a, b, k in spans]) for text, spans in example_rows(rows, seed)]
    return spark.createDataFrame(made, "text string, spans array<struct<kind: string, start: int, end: int>>")


def fit(labelled: DataFrame, *, max_labelled: int = 2000, text: str = "text", spans: str = "spans") -> Model:
    """Train on at most max_labelled rows (those of the least hash), which are what reaches the driver."""
    chosen = labelled.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(spans), F.array().cast("array<struct<kind: string, start: int, end: int>>")).alias("spans"))
    rows = chosen.orderBy(F.xxhash64("text"), "text", F.to_json("spans")).limit(max_labelled).collect()
    return train([(r["text"], [(s["start"], s["end"], s["kind"]) for s in r["spans"]]) for r in rows])


def find_spans(docs: DataFrame, model: Model, *, text: str = "text", out: str = "spans") -> DataFrame:
    """docs with the spans of each whole text: array of (kind, start, end, method), by start, then kind as in KINDS.

    method is base for the fixed patterns and crf for what the field adds; these are checked (a card's sum, an address's
    numbers) and don't overlap base ones. Places count code points, the end is exclusive. A null text has no spans. Other
    columns stay, and so do repeated rows. What is broadcast is the model: a few thousand features of 9 weights.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("method", pa.string())]))
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            found = find_in_texts(texts, shared.value)
            column = [[{"kind": KINDS[k], "start": a, "end": b, "method": m} for a, b, k, m in spans] for spans in found]
            yield pa.record_batch([*batch.columns, pa.array(column, kind)], names=[*batch.schema.names, out])

    span = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("method", StringType())])
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, ArrayType(span))]))


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, with commas between."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
