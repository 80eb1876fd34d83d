"""Personal data by fixed patterns and a linear-chain conditional random field.

The patterns find e-mail addresses, IP addresses, card and phone numbers in their plain forms. The field finds disguised
ones ("jane at example dot com", "10[.]0[.]0[.]7", "0049 30 1234567") and adds them; patterns' spans stay.

The field labels words with the beginning or the inside of a kind, or as outside. Its state features are the shapes of a
word and of its two neighbours on either side; it is trained by gradient ascent on the small labelled table below, or
another one, and decoded by Viterbi for all stretches of a batch together.

Most words are plain: letters, no digit, no mark. The chain is cut where a long enough row of plain words lies
between two others. At fit time the model is asked whether the best path through such a row is outside in its
middle whatever lies at its ends; the row is made longer until this holds, so the cut loses nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import bounded_batches, read, slices
from vellum.llm.hashing import Words, words
from vellum.llm.quality import forward_backward

KINDS = ["email", "ip", "card", "phone"]
OUTSIDE = 0
LABELS = 1 + 2 * len(KINDS)

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]++")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# the look behind keeps a search from starting anew at every digit of a long number
_IP = re.compile(r"[0-9](?<![0-9]{2})[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?<![0-9]{2})(?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def is_ip(parts: list[str]) -> bool:
    return len(parts) == 4 and all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in parts)


def is_card(digits: str) -> bool:
    return 16 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and without overlap within a kind; matches that fail their check go.
    Linear in the text's length."""
    out = []
    at, low = text.find("@"), 0
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        local = _LOCAL.match(text[low:at][::-1]) if domain else None
        if local:
            out.append((0, at - local.end(), domain.end()))
        low = domain.end() if local else at + 1
        at = text.find("@", at + 1)
    out += [(1, *m.span()) for m in _IP.finditer(text) if is_ip(m.group().split("."))]
    out += [(2, *m.span()) for m in _CARD.finditer(text) if is_card("".join(_DIGITS.findall(m.group())))]
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15]
    return out


#: Words that stand for @ and for a dot, and words that announce a kind.
AT = ["at", "(at)", "[at]", "{at}", "<at>", "arroba", "(arroba)", "[arroba]", "arobase", "(arobase)", "klammeraffe", "@"]
DOT = ["dot", "(dot)", "[dot]", "{dot}", "punkt", "(punkt)", "[punkt]", "punto", "(punto)", "[punto]", "point", "(point)", "[point]", ".", "[.]", "(.)"]
NAMES = {"mail": ["mail", "email", "e-mail", "email:", "mail:", "e-mail:", "correo", "correo:", "courriel", "courriel:", "kontakt:", "contact:", "write", "schreib"],
         "net": ["ip", "ip:", "host", "host:", "server", "server:", "address", "address:", "adresse", "adresse:", "servidor"],
         "pay": ["card", "card:", "visa", "visa:", "mastercard", "karte", "karte:", "kreditkarte", "kreditkarte:", "tarjeta", "tarjeta:", "carte", "carte:", "payment"],
         "call": ["tel", "tel.", "tel:", "phone", "phone:", "call", "mobile", "mobile:", "telefon", "telefon:", "fon:", "handy", "anruf", "teléfono", "teléfono:", "móvil", "llama",
                  "téléphone", "téléphone:", "appelez", "fax", "fax:"],
         "top": ["com", "org", "net", "info", "edu", "eu", "io", "de", "es", "fr", "uk", "ch"]}
_CUE = {c: "at" for c in AT} | {c: "dot" for c in DOT} | {c: k for k, v in NAMES.items() for c in v}

#: The labelled table: sentences with their personal data in braces.
LABELLED = [
    "write to {email:jane.doe at example dot com} before noon", "my address is {email:bob (at) mail (dot) example (dot) org} thanks", "contact: {email:k.meyer [at] example [dot] de}",
    "please mail {email:anna[at]example.com} or come by", "email {email:sam(at)host.example.net} about it", "Schreib an {email:peter punkt lang at firma punkt de} bitte",
    "E-Mail: {email:info (at) beispiel.de} oder per Post", "correo: {email:ana arroba correo punto es} gracias", "mi correo {email:luis.gil [arroba] ejemplo.es} es nuevo",
    "courriel: {email:marie arobase exemple point fr} merci", "écrivez {email:jean.petit (at) exemple (point) fr} demain", "reach {email:x99 at mail7 dot example dot com} any time",
    "{email:office at example dot org} is our mailbox", "send it to {email:a.b-c [at] sub [dot] example [dot] com}, please", "mail {email:tom{at}example.com} now",
    "ask {email:lena.53 at mail2.example.com} for it", "or {email:max at example.org} if urgent", "her mail {email:eva @ example . com} bounced", "mail me: {email:joe @ example.com} ok",
    "ping {ip:10[.]0[.]0[.]7} from there", "host {ip:192[.]168[.]4[.]21} was down", "server {ip:172.16(.)8(.)9} answered", "the ip {ip:8 . 8 . 4 . 4} is public", "ip: {ip:203 dot 0 dot 113 dot 9} blocked",
    "traffic from {ip:198[.]51[.]100[.]77} and others", "adresse {ip:91(.)12(.)45(.)200} gesperrt", "{ip:77[.]88[.]99[.]10} is gone", "servidor {ip:84 punto 20 punto 3 punto 1} caído",
    "card: {card:4539.1488.0343.6467} until May", "visa {card:5105/1051/0510/5100} paid", "Kreditkarte {card:5500.0000.0000.0004} gesperrt", "my card {card:4111  1111 1111 1111} expired",
    "tarjeta {card:6011_0009_9013_9424} nueva", "carte: {card:3530.1113.3330.0000} merci", "payment with {card:4012/8888/8888/1881} failed", "{card:4222.2222.2222.2220} was charged",
    "call {phone:(555) 123-4567} after six", "phone: {phone:555-123-4567} ext", "tel. {phone:030 / 1234567} abends", "Telefon: {phone:0049 30 1234567} oder", "mobile {phone:0171-5556677} works",
    "llama al {phone:0034 612 345 678} hoy", "teléfono {phone:912 345 678} tardes", "appelez {phone:01 23 45 67 89} ce soir", "téléphone: {phone:06.12.34.56.78} merci", "fax {phone:(0221) 998877} only",
    "he said {phone:413-555-9876} was old", "name {phone:617-868-2200} street", "so {phone:913-626-2871} it is",
    "reach me on {phone:1-800-555-0199} toll free", "or {phone:0043 1 58801} in Vienna", "Handy {phone:(0160) 4455667} bitte", "her number is {phone:(212) 555-0142} now", "mit {phone:0351 4640640} verbunden",
    # nothing personal
    "the ship arrived at noon and left at dusk", "we met at the dot on the map", "at 5 dot 30 we left the house", "version 1.2.3 of the tool", "chapter 4.1.2.7.3 is long", "in 1998 about 2500 people came",
    "prices rose by 3.5 percent in 2021", "token = \"592e2677e7e6567f917b8bfcceb4e5730d6fd3bc\" is secret", "key 8ef5f278dec875d2b96fdf291615913d21aee5ca here", "order 6874314485609552 was shipped", "number 12345678901234 is large",
    "on 2024-05-17 at 10:30 we met", "am 17.05.2024 um 10:30 Uhr", "el 3 de mayo de 1999 en Madrid", "le 14 juillet 1789 à Paris", "see page 12, line 7, row 3", "sizes 10 20 30 40 50 and 60", "it costs 1,299.00 in total",
    "the point at the end of line 3", "punto de vista 7 y 8", "der Punkt at Zeile 4", "he said (at length) that it is so", "an array a[0] and f(x) = 2", "room 101 (second floor) is free", "15 of 20 were there",
    "isbn 978-3-16-148410-0 is a book", "from 1939 to 1945 and 1950", "a score of 3-2 in 90 minutes", "the answer is 42 .", "100 200 300 400 500 600 700", "word word word word word word word word",
    "it was late and nobody came back to the house that night", "lorem ipsum dolor sit amet 5 times", "about 70 % at 20 degrees", "at example 3 the text dot ends", "1 2 3 4 5 6 7 8 9", "Figure 3.14.15 shows it", "50 at 20 dot", "10.5 12.5 17.25 and 3.75",
]


def _features(word: str) -> list[str]:
    """Shape features of a word that has a mark."""
    cue = _CUE.get(word)
    digits = sum(c.isdigit() and c.isascii() for c in word)
    core = word.strip(".,;:!?\"'")
    shape = re.sub(r"(.)\1+", r"\1", "".join("d" if c.isdigit() else "a" if c.isalpha() else c for c in core[:40]))[:16]
    size = next((k for k, most in enumerate((0, 1, 2, 3, 4, 6, 9, 12, 15, 19)) if digits <= most), 10)
    out = ["shape=" + shape, f"digits={size}", "last=" + word[-1:] if word[-1:] in ".,;:!?" else "last="]
    if cue:
        out += ["cue=" + cue]
    for name, test in (("at", "@" in word or "(at)" in word or "[at]" in word or "{at}" in word or "[arroba]" in word), ("dot", "." in core), ("zero", core[:1] == "0"), ("open", core[:1] == "("),
                       ("byte", core.isdigit() and core.isascii() and len(core) < 4 and int(core) < 256), ("bracket-dot", "[.]" in word or "(.)" in word), ("number", core.isdigit())):
        if test:
            out.append(name)
    return out


_PLAIN = ["plain"]
#: Places of a word's neighbours that enter its features.
PLACES = [0, -1, 1, -2, 2]


@dataclass
class Tagger:
    """State weights per place and feature, transitions, and the rows of plain words that a cut needs on each side."""

    index: dict[str, int]
    weights: np.ndarray  # place x feature x label
    trans: np.ndarray
    margin: int = 4
    _types: dict[bytes, int] = field(default_factory=dict)
    _table: list[np.ndarray] = field(default_factory=list)

    def __getstate__(self):
        return (self.index, self.weights, self.trans, self.margin)

    def __setstate__(self, state):
        self.index, self.weights, self.trans, self.margin = state
        self._types, self._table = {}, []

    def _vector(self, features: list[str]) -> np.ndarray:
        known = [self.index[f] for f in features if f in self.index]
        return self.weights[:, known].sum(axis=1)

    def types(self, words: list[bytes]) -> np.ndarray:
        """Numbers of word types, 0 for plain; their weights stand in ``table``. Numbers are forgotten when they get many."""
        if not self._table or len(self._table) > 200_000:
            self._types, self._table = {}, [self._vector(_PLAIN)]
        out = np.zeros(len(words), np.int64)
        for k, w in enumerate(words):
            t = self._types.get(w)
            if t is None:
                t = self._types[w] = len(self._table)
                self._table.append(self._vector(_features(w.decode("utf-8", "replace"))))
            out[k] = t
        return out

    def scores(self, types: np.ndarray) -> np.ndarray:
        """State scores (words x labels) of a row of words, which has two plain ones at each end that get none."""
        table = np.array(self._table)
        n = len(types) - 4
        return sum(table[types[2 + p:2 + p + n], k] for k, p in enumerate(PLACES))

    def plain_rows_hold(self, margin: int) -> bool:
        """Whether the best path over 2 * margin plain words is outside in the middle, whatever labels are before and after."""
        own = self._vector(_PLAIN).sum(axis=0)
        step = self.trans + own[None, :]
        half = step
        for _ in range(margin - 1):
            half = (half[:, :, None] + step[None]).max(axis=1)
        whole = (half[:, :, None] + half[None]).max(axis=1)
        return bool(np.all(half[:, OUTSIDE][:, None] + half[OUTSIDE] >= whole - 1e-9))


def viterbi(score: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best labels of several chains end to end (``first``: bounds), each between two words outside. All
    chains advance together, longest first."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    back = np.zeros(score.shape, np.int8)
    best = np.zeros((len(size), score.shape[1]))
    steps = [int((size > t).sum()) for t in range(int(size[0]) if len(size) else 0)]
    for t, m in enumerate(steps):
        if t == 0:
            best[:m] = trans[OUTSIDE] + score[start[:m]]
            continue
        paths = best[:m, :, None] + trans
        back[start[:m] + t] = paths.argmax(axis=1)
        best[:m] = paths.max(axis=1) + score[start[:m] + t]
    label = (best + trans[:, OUTSIDE]).argmax(axis=1)
    out = np.zeros(len(score), np.int64)
    for t in range(len(steps) - 1, -1, -1):
        m = steps[t]
        out[start[:m] + t] = label[:m]
        if t:
            label[:m] = back[start[:m] + t, label[:m]]
    return out


def _marked(sentence: str) -> tuple[list[str], list[int]]:
    """Words and labels of a sentence of the labelled table."""
    text, spans = "", []
    at = 0
    for m in re.finditer(r"\{(email|ip|card|phone):((?:[^{}]|\{at\})*)\}", sentence):
        text += sentence[at:m.start()]
        spans.append((KINDS.index(m.group(1)), len(text), len(text) + len(m.group(2))))
        text += m.group(2)
        at = m.end()
    text += sentence[at:]
    found, labels, before = [], [], None
    for m in re.finditer(r"\S+", text):
        own = next((s for s in spans if m.start() < s[2] and s[1] < m.end()), None)
        found.append(m.group())
        labels.append(OUTSIDE if own is None else 1 + 2 * own[0] + (own == before))
        before = own
    return found, labels


def fit_tagger(sentences: Iterable[str] = LABELLED, rounds: int = 400, rate: float = 0.15, decay: float = 3e-4) -> Tagger:
    """Maximises the penalised conditional log likelihood of the labelled table by Adam. The table is small by contract: it is
    read by the driver."""
    rows = [_marked(s) for s in sentences]
    w = words(pa.array([" ".join(found) for found, _ in rows]), lower=True)
    typed = _typed(w)[1]
    features = [[_features(w.data[w.start[i]:w.end[i]].tobytes().decode()) if typed[i] else _PLAIN for i in range(a, b)]
                for a, b in zip(w.first, w.first[1:], strict=False)]
    names = sorted({f for row in features for fs in row for f in fs})
    index = {f: k for k, f in enumerate(names)}
    x = np.zeros((sum(map(len, features)), len(PLACES), len(names)))
    at = 0
    for row in features:
        for i in range(len(row)):
            for k, p in enumerate(PLACES):
                for f in row[i + p] if 0 <= i + p < len(row) else _PLAIN:
                    x[at + i, k, index[f]] = 1
        at += len(row)
    x = x.reshape(len(x), -1)
    y = np.array([label for _, labels in rows for label in labels])
    first = np.concatenate([[0], np.cumsum([len(labels) for _, labels in rows])])
    target = np.eye(LABELS)[y]
    inner = np.setdiff1d(np.arange(len(y)), first[:-1])
    seen = np.zeros((LABELS, LABELS))
    np.add.at(seen, (y[inner - 1], y[inner]), 1)
    seen[OUTSIDE, OUTSIDE] += 1
    params = np.zeros(x.shape[1] * LABELS + LABELS * LABELS)
    m, v = np.zeros_like(params), np.zeros_like(params)
    cut = x.shape[1] * LABELS
    for step in range(1, rounds + 1):
        state, t = params[:cut].reshape(-1, LABELS), params[cut:].reshape(LABELS, LABELS)
        marginal, pairs, _ = forward_backward(x @ state, first, t)
        g = np.concatenate([(x.T @ (target - marginal)).ravel(), (seen - pairs).ravel()]) / len(rows) - decay * params
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params + rate * (0.5 ** (3 * step / rounds)) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    trans = params[cut:].reshape(LABELS, LABELS).copy()
    for kind in range(len(KINDS)):  # an inside follows its own kind only
        for before in range(LABELS):
            if before not in (1 + 2 * kind, 2 + 2 * kind):
                trans[before, 2 + 2 * kind] = -1e4
    tagger = Tagger(index, params[:cut].reshape(len(PLACES), len(names), LABELS), trans)
    while not tagger.plain_rows_hold(tagger.margin):
        tagger.margin *= 2
        if tagger.margin > 64:
            raise ValueError("the labelled table does not make plain words outside: give it sentences without personal data")
    return tagger


_SIGNS = np.isin(np.arange(256), list(b"0123456789@"))
_DIGIT = np.isin(np.arange(256), list(b"0123456789"))
_OPEN = np.isin(np.arange(256), list(b"[({"))
_WORD = np.array([b > 127 or chr(b).isalnum() for b in range(256)])


def _hashes(cues: list[str]) -> np.ndarray:
    return np.sort(words(pa.array(cues), lower=True).hash)


def _is_in(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _near(mask: np.ndarray, doc: np.ndarray, before: int, after: int) -> np.ndarray:
    """Words with a marked one of the same text up to ``before`` words ahead of them or ``after`` behind."""
    out = mask.copy()
    for k in range(1, max(before, after) + 1):
        if k >= len(mask):
            break
        same = doc[k:] == doc[:-k]
        if k <= before:
            out[:-k] |= mask[k:] & same
        if k <= after:
            out[k:] |= mask[:-k] & same
    return out


_AT, _DOT, _NAMES = _hashes(AT), _hashes(DOT), _hashes([c for v in NAMES.values() for c in v])
_TRIM_LEFT, _TRIM_RIGHT = "([{<\"'`", ".,;:!?)]}>\"'`"


def _valid(kind: int, piece: str) -> bool:
    """The exact check of a span that the field found."""
    if kind == 0:
        plain = piece.lower()
        for cues, mark in ((AT, "@"), (DOT, ".")):
            plain = re.sub("|".join(rf"\s+{re.escape(c)}\s+" for c in cues), mark, plain)
            plain = re.sub("|".join(re.escape(c) for c in cues if c[0] in "([{<"), mark, plain)
        return base_spans(plain) == [(0, 0, len(plain))] and re.search(r"\.[a-z]{2,}$", plain) is not None
    digits = "".join(_DIGITS.findall(piece))
    if kind == 1:
        rest = re.sub(r"[0-9]+", "", piece.lower())
        return is_ip(_DIGITS.findall(piece)) and rest.replace("[.]", ".").replace("(.)", ".").replace("dot", ".").replace("punkt", ".").replace("punto", ".").replace("point", ".").replace(" ", "") == "..."
    if not re.fullmatch(r"[0-9+()./_ -]+", piece):
        return False
    if kind == 2:
        return is_card(digits)
    # a row of bare numbers is a phone number only if it begins like one
    return 7 <= len(digits) <= 15 and (piece[0] in "(0" or len(digits) >= (9 if re.fullmatch("[0-9 ]+", piece) else 8))


def _typed(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words are marked (digits, @, an inner bracket, words that stand for @ or a dot where
    these belong together) or else have a type of their own, as they announce a kind near a marked word; and each word's text."""
    doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    count = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    sign = count(_SIGNS[w.data])
    opened = _OPEN[w.data].copy()
    opened[1:] &= _WORD[w.data[:-1]]
    opened = count(opened)
    inner_dot = (w.data == 46)
    inner_dot[:-1] &= _WORD[w.data[1:]]
    inner_dot[1:] &= _WORD[w.data[:-1]]
    inner_dot = count(inner_dot)
    has = lambda c, from_=0: c[w.end] > c[w.start + from_]
    at, dot = _is_in(w.hash, _AT), _is_in(w.hash, _DOT)
    marked = has(sign) | (has(opened) & (w.end - w.start > 1))
    # an at-word counts before a dot, a dot-word after an at-word or between numbers
    real_at = at & _near(dot | has(inner_dot), doc, 4, 0)
    digit = count(_DIGIT[w.data])
    number = has(digit)
    marked |= real_at | (dot & (_near(real_at | marked & ~number, doc, 0, 8) | (_near(number, doc, 0, 1) & _near(number, doc, 1, 0))))
    typed = marked | (_near(marked, doc, 2, 2) & _is_in(w.hash, _NAMES))
    return marked, typed, doc


def field_spans(tagger: Tagger, col: pa.Array) -> dict[int, list[tuple[int, int, int]]]:
    """Per text of the column with any: (kind, start, end) found by the field, in code points."""
    w = words(col, lower=True)
    n = len(w.hash)
    if not n:
        return {}
    marked, typed, doc = _typed(w)
    if not marked.any():
        return {}
    reach = 4 + tagger.margin
    live = np.flatnonzero(_near(marked, doc, reach, reach))
    raw = w.data.tobytes()
    types = np.zeros(n, np.int64)
    where = np.flatnonzero(typed)
    types[where] = tagger.types([raw[a:b] for a, b in zip(w.start[where].tolist(), w.end[where].tolist(), strict=True)])
    # stretches, with two plain words between them
    new = np.ones(len(live), bool)
    new[1:] = (live[1:] != live[:-1] + 1) | (doc[live[1:]] != doc[live[:-1]])
    stretch = np.cumsum(new) - 1
    row = np.zeros(len(live) + 2 * stretch[-1] + 4, np.int64)
    place = np.arange(len(live)) + 2 * stretch + 2
    row[place] = types[live]
    score = tagger.scores(row)[place - 2]
    label = viterbi(score, np.append(np.flatnonzero(new), len(live)), tagger.trans)
    begins = np.flatnonzero(label % 2 == 1)
    out: dict[int, list[tuple[int, int, int]]] = {}
    if not len(begins):
        return out
    own, offsets = col.fill_null(""), w.doc_offsets
    for b in begins.tolist():
        e, kind = b, (int(label[b]) - 1) // 2
        while e + 1 < len(label) and label[e + 1] == 2 + 2 * kind and not new[e + 1]:
            e += 1
        d = int(doc[live[b]])
        text = own[d].as_py().encode()
        lo, hi = int(w.start[live[b]] - offsets[d]), int(w.end[live[e]] - offsets[d])
        piece, start = text[lo:hi].decode(), len(text[:lo].decode())
        trimmed = piece.lstrip(_TRIM_LEFT) if kind != 3 else piece
        start += len(piece) - len(trimmed)
        trimmed = trimmed.rstrip(_TRIM_RIGHT)
        if trimmed and _valid(kind, trimmed):
            out.setdefault(d, []).append((kind, start, start + len(trimmed)))
    return out


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def _find(tagger: Tagger, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, batch.schema.names[-1]):
            col = part.column(part.num_columns - 1)
            extra, rows = field_spans(tagger, col), []
            for d, text in enumerate(col.to_pylist()):
                base = base_spans(text) if text else []
                # a span of the field that meets another one is left out
                found = sorted((s, e) for _, s, e in base)
                more = []
                for kind, s, e in extra.get(d, []):
                    if all(e <= a or b <= s for a, b in found):
                        more.append((kind, s, e, False))
                        found.append((s, e))
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in sorted([(*x, True) for x in base] + more)])
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(rows, _SPANS)], names=[*part.schema.names[:-1], "spans"])


def find_personal_data(docs: DataFrame, tagger: Tagger | None = None, text: str = "text") -> DataFrame:
    """``docs`` without its text and with spans: array of (kind, start, end, base) in code points, end exclusive, by kind in
    the order of ``KINDS``, then start. ``base``: found by the fixed patterns; the others by the field.

    Spans of the patterns stay whatever the field says; spans of one kind do not overlap. Null and empty texts have none;
    whole texts are searched, in time linear in their length; repeated rows are treated alike, each on its own; a column named
    ``spans`` is replaced; an empty table gives none. One narrow pass.
    """
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text, "spans")]
    source = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").alias(text))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    return source.mapInArrow(partial(_find, tagger or fit_tagger()), f"{fields}spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s.base)
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.base & (s.kind == kind))).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
