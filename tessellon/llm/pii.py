"""Personal data: fixed patterns first, then spans that a linear-chain conditional random field adds.

The patterns give the kinds email, ip, card and phone. The field labels the tokens of every line with secret (keys, passwords,
tokens), contact (spelled-out addresses) and number (local telephone and identity numbers); its features are word shapes,
lengths and cue words of a token and its neighbours. It is trained by maximum likelihood on the small table that
labelled_rows() makes, and decoded by Viterbi over batches of lines in numpy. An added span never touches one of the
patterns' spans.

For speed, a token's features are numbers of what the training has met, its scores are sums of rows of small tables, and
Viterbi is left out where it is proved to give no span: against no tag, a span gains what its first token and its other
tokens score, with the best transitions; a token that lies in no span whose gain can be over 0 has no tag. What is between
such tokens is decoded on its own, with none before and after it.

Defined results: null is an empty text without spans; positions are code points; ties go by kind in the order of KINDS;
repeated rows are searched each; very long texts and lines are read in slices, and each line is decoded as a whole; other
columns are kept or not read; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellon.llm import kernels

# Fixed values.
KINDS = ["email", "ip", "card", "phone", "secret", "contact", "number"]
BASE = KINDS[:4]
CUES = "password passwd pwd secret token key apikey api auth at dot com org net call tel phone mobile fax ssn id no number ref mail email contact version license year page chapter about since = : @ ( ) [ ] - . \" ' + # $ % /".split()

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\w+|[^\w\s]")
_TOKEN_OR_END = re.compile(r"\w+|[^\w\s]|\n")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the patterns, leftmost and non-overlapping for each kind."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end(), "email"))
        free = found.end() if found else free
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m[0].split(".")):
                out.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def labelled_rows(seed: int = 11, rounds: int = 14) -> list[list[tuple[str, str]]]:
    """The small table: sentences as (token, tag), made from patterns with made-up words around them."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    some = lambda cs, n: "".join(pick(cs) for _ in range(n))
    low, up, dig, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    word = lambda: some(low, int(rng.integers(2, 11)))
    d = lambda n: some(dig, n)
    patterns = [
        lambda: ("secret", f"AKIA{some(up + dig, 16)}", "", ""),
        lambda: ("secret", f"AKIA{some(up * 4 + dig, 15)}{d(1)}", "", ""),
        lambda: ("secret", f"AKIA{some(up, 16)}", "", ""),
        lambda: ("secret", some(hexa, int(rng.integers(16, 48))), pick(["password=", "passwd=", "pwd=", "secret=", "api_key=", "token="]), ""),
        lambda: ("secret", some(low, int(rng.integers(4, 9))) + d(int(rng.integers(6, 11))) + some(low, int(rng.integers(4, 9))), pick(["password=", "pwd=", "secret=", "token="]), ""),
        lambda: ("secret", some(hexa, int(rng.integers(24, 48))), pick(['token = "', 'secret = "', 'password: "', 'key = "']), '"'),
        lambda: ("secret", some(low + up + dig, int(rng.integers(20, 44))), pick(["", "key ", "token: "]), ""),
        lambda: ("contact", f"{word()} at {word()} dot {pick(['com', 'org', 'net'])}", pick(["", "mail ", "contact: "]), ""),
        lambda: ("contact", f"{word()} at {word()} dot {pick(['com', 'org', 'net'])}", pick(["write to ", "to ", "via "]), pick([" or", " and", ""])),
        lambda: ("contact", f"{word()} AT {word()} DOT {pick(['com', 'org', 'net'])}", pick(["", "mail ", "reach me: "]), ""),
        lambda: ("contact", f"{word()}[at]{word()}[dot]{pick(['com', 'org', 'net'])}", "", ""),
        lambda: ("contact", f"{word()} (at) {word()} (dot) {pick(['com', 'org', 'net'])}", "", ""),
        lambda: ("number", f"{d(3)}-{d(3)}-{d(4)}", pick(["", "call ", "tel ", "phone: "]), ""),
        lambda: ("number", f"({d(3)}) {d(3)}-{d(4)}", pick(["", "call ", "tel "]), ""),
        lambda: ("number", f"{d(3)}-{d(2)}-{d(4)}", pick(["", "ssn ", "id: "]), ""),
        lambda: ("", f"{d(4)}", pick(["", "since ", "year "]), ""),
        lambda: ("", f"{d(1)}.{d(1)}", pick(["version ", "Version ", ""]), ""),
        lambda: ("", f"{d(2)}:{d(2)}", "", ""),
        lambda: ("", f"{d(int(rng.integers(1, 4)))} {word()}", pick(["", "page ", "chapter ", "$"]), ""),
        lambda: ("", f"{d(int(rng.integers(1, 3)))}-{d(int(rng.integers(1, 3)))}", "", ""),
        lambda: ("", word(), "", ""),
        lambda: ("", f"{word().capitalize()} {word().upper()}", "", ""),
        lambda: ("", f"{word()}, {word()}: {word()} ({word()}) - {word()}/{word()}", "", ""),
        lambda: ("", f'"{word()}" {word()}; [{word()}] {word()}!', "", ""),
        lambda: ("", f"{word()} {pick(['at', 'AT', '(at)', '[at]'])} {word()}", "", ""),
        lambda: ("", f"{word()} at {word()}. {word().capitalize()} dot {word()}", "", ""),
        lambda: ("", f"{word()} {pick(['dot', 'DOT', '(dot)'])} {pick(['com', 'org', 'net'])}", "", ""),
        lambda: ("", f"{pick(['key', 'token', 'secret', 'password', 'mail', 'call', 'id', 'phone'])} {word()}", "", ""),
        lambda: ("", f"{word()}.{pick(['com', 'org', 'net'])} {word()}", "", ""),
        lambda: ("", "-" * int(rng.integers(2, 30)), "", ""),
        lambda: ("", f"{word()}{d(1)} {up[int(rng.integers(26))]}{d(2)}", "", ""),
        lambda: ("", some(low, int(rng.integers(11, 24))), "", ""),
        lambda: ("", some(up, int(rng.integers(11, 24))), "", ""),
        lambda: ("", " ".join([pick(["at", "dot", "no", "com", "id", "AT", "DOT", "NO"])] * int(rng.integers(2, 13))), "", ""),
        lambda: ("", " ".join([word(), *["at"] * int(rng.integers(2, 9)), word()]), "", ""),
        lambda: ("", f"{word().upper()}. {pick(['AT', 'NO', 'DOT', 'ID', 'COM'])} {word().upper()} {pick(['NO', 'AT', 'ABOUT', 'DOT'])} {word().upper()}", "", ""),
        lambda: ("", f"{word()}### {pick(['at', 'no', 'dot'])}%%% {pick(['at', 'no', 'com'])}%%% {word()}", "", ""),
        lambda: ("", f"{word()} at the {word()}", "", ""),
        lambda: ("", f"{word()} dot {word()}", "", ""),
        lambda: ("", f"{word()} = {word()}", "", ""),
        lambda: ("", f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", "", ""),
        lambda: ("", f"{word()}.{d(2)}@{word()}.example.com", "", ""),
        lambda: ("", f"{d(2)}.{d(3)}.{d(2)}.{d(3)}", "", ""),
        lambda: ("", d(16), "", ""),
    ]
    rows = []
    for _ in range(rounds):
        for make in patterns:
            kind, core, before, after = make()
            words = lambda n: " ".join(word() + pick(["", "", "", ",", "."]) for _ in range(n)).capitalize()
            left, right = words(int(rng.integers(0, 7))), words(int(rng.integers(0, 6)))
            text = (left + " " if left else "") + before
            start, end = len(text), len(text) + len(core)
            text += core + after + pick(["", "", ".", ","]) + (" " + right if right else "")
            tags, inside = [], False
            for m in _TOKEN.finditer(text):
                own = bool(kind) and start <= m.start() and m.end() <= end
                tags.append((m[0], ("I-" if inside else "B-") + kind if own else "O"))
                inside = own
            rows.append(tags)
    return rows


def shape(token: str) -> str:
    """X, x and d for runs of upper case, other letters and digits; marks stay; cut where it gets long."""
    out = []
    for c in token[:64]:
        s = "d" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out[:5]) + "~" * (len(out) > 5)


def _length(n: int) -> str:
    return str(n) if n < 5 else "5-9" if n < 10 else "10-15" if n < 16 else "16+"


_PADS = [("^", "", "", ""), ("$", "", "", "")]


def _own(token: str) -> tuple[str, str, str, str]:
    """Shape, length with kinds of characters, cue and beginning of a token."""
    low = token.lower() if len(token) < 12 else ""
    kinds = "X" * (token != token.lower()) + "x" * (token != token.upper()) + "d" * bool(_DIGIT.search(token))
    return shape(token), f"{_length(len(token))}{kinds}", low if low in CUES else "", token[:4] if len(token) > 15 else ""


#: The features of a token by what they are taken from: itself, one and two tokens before, one and two tokens after it.
_OF_OWN = lambda o: (f"s0={o[0]}", f"l0={o[1]}", f"p0={o[3]}", f"sl={o[0]}|{o[1]}", f"c0={o[2]}")
_OF_LAST = lambda o: (f"s-={o[0]}|{o[1]}", f"c-={o[2]}")
_OF_SECOND_LAST = lambda o: (f"c--={o[2]}",)
_OF_NEXT = lambda o: (f"s+={o[0]}|{o[1]}", f"c+={o[2]}")
_OF_SECOND_NEXT = lambda o: (f"c++={o[2]}",)
_SHAPES = lambda a, b, c: f"ss={a}|{b}|{c}"
_CUED = lambda a, b, o: f"cc={a} {b}|{o[0]}|{o[1]}"


def features(tokens: list[str]) -> list[list[str]]:
    """A list of features for each token: its shape, length and cue, and those of its neighbours."""
    own = [_PADS[0], _PADS[0], *(_own(t) for t in tokens), _PADS[1], _PADS[1]]
    return [
        [
            *_OF_OWN(own[i]), *_OF_LAST(own[i - 1]), *_OF_SECOND_LAST(own[i - 2]), *_OF_NEXT(own[i + 1]), *_OF_SECOND_NEXT(own[i + 2]),
            _SHAPES(own[i - 1][0], own[i][0], own[i + 1][0]), _CUED(own[i - 2][2], own[i - 1][2], own[i]),
        ]
        for i in range(2, len(tokens) + 2)
    ]


class Field:
    """A linear-chain conditional random field; weights of features by tag, and of tag pairs."""

    def __init__(self, rows: list[list[tuple[str, str]]], steps: int = 120, rate: float = 0.15, decay: float = 0.02):
        kinds = KINDS[4:]
        self.tags = ["O", *(f"{p}-{k}" for k in kinds for p in "BI")]
        n = len(self.tags)
        self.allowed = np.array([[not b.startswith("I-") or a[2:] == b[2:] for b in self.tags] for a in self.tags])
        self.first = np.array([not b.startswith("I-") for b in self.tags])
        names: dict[str, int] = {}
        data = [([[names.setdefault(f, len(names)) for f in fs] for fs in features([t for t, _ in row])], [self.tags.index(y) for _, y in row]) for row in rows if row]
        self.names, slots = names, len(features(["x"])[0])
        longest = max(len(y) for _, y in data)
        x, y = np.zeros((len(data), longest, slots), int), np.zeros((len(data), longest), int)
        length = np.array([len(t) for _, t in data])
        for i, (fs, ys) in enumerate(data):
            x[i, : len(fs)], y[i, : len(ys)] = fs, ys
        on = np.arange(longest)[None] < length[:, None]
        w, t = np.zeros((len(names) + 1, n)), np.zeros((n, n))
        gold_w, gold_t = np.zeros_like(w), np.zeros_like(t)
        np.add.at(gold_w, x[on], np.eye(n)[y[on]][:, None, :])
        np.add.at(gold_t, (y[:, :-1][on[:, 1:]], y[:, 1:][on[:, 1:]]), 1)
        state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
        self.w, self.t = w, t
        for step in range(1, steps + 1):
            e = w[x].sum(2)
            tt = np.where(self.allowed, t, -1e9)
            forward, back = np.zeros_like(e), np.zeros_like(e)
            forward[:, 0] = e[:, 0] + np.where(self.first, 0, -1e9)
            sums = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
            for i in range(1, longest):
                forward[:, i] = np.where(on[:, i, None], e[:, i] + sums(forward[:, i - 1, :, None] + tt[None], 1), forward[:, i - 1])
            for i in range(longest - 2, -1, -1):
                back[:, i] = np.where(on[:, i + 1, None], sums(tt[None] + (e[:, i + 1] + back[:, i + 1])[:, None, :], 2), 0)
            z = sums(forward[:, -1], 1)
            p = np.exp(np.minimum(forward + back - z[:, None, None], 0))
            grad_w, grad_t = -gold_w + decay * w, -gold_t + decay * t
            np.add.at(grad_w, x[on], p[on][:, None, :])
            pair = forward[:, :-1, :, None] + tt[None, None] + (e + back)[:, 1:, None, :] - z[:, None, None, None]
            grad_t += (np.exp(np.minimum(pair, 0)) * on[:, 1:, None, None]).sum((0, 1)) * self.allowed
            for k, (v, g) in enumerate(((w, grad_w), (t, grad_t))):
                g = g / len(data)
                a, b = state[2 * k], state[2 * k + 1]
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                v -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        w[-1] = 0  # features not met in training
        self._tables([[_PADS[0], _PADS[0], *(_own(t) for t, _ in row), _PADS[1], _PADS[1]] for row in rows])

    def _tables(self, met: list[list[tuple[str, str, str, str]]]) -> None:
        """Numbers of what the training has met (0: nothing it has), and score tables over them. met: rows with their pads."""
        every = [o for row in met for o in row]
        number = lambda xs: {x: i for i, x in enumerate(sorted(set(xs)), 1)}
        self.shape_no, self.sl_no = number(o[0] for o in every), number(o[:2] for o in every)
        self.length_no, self.begin_no, self.cue_no = number(o[1] for o in every), number(o[3] for o in every), number([*CUES, ""])
        self.class_no: dict[tuple[int, ...], int] = {}
        self.of_token: dict[str, int] = {"\n": -1}
        self.rows: list[list[np.ndarray]] = [[] for _ in range(5)]
        self.parts: list[tuple[int, int, int]] = []  # shape, shape with length, cue of each class
        self.stacked = None
        shapes, cues, none = len(self.shape_no) + 1, len(self.cue_no) + 1, np.zeros(len(self.tags))
        self.triple, self.joint, triples, cued, joint = np.zeros((shapes, shapes, shapes), np.int32), np.zeros((cues, cues), np.int32), [none], {}, 0
        for row in met:
            for a, b, o, c in zip(row, row[1:], row[2:-1], row[3:], strict=False):
                at = tuple(self.shape_no[x[0]] for x in (b, o, c))
                if not self.triple[at]:
                    self.triple[at] = len(triples)
                    triples.append(self._weight(_SHAPES(b[0], o[0], c[0])))
                at = self.cue_no[a[2]], self.cue_no[b[2]]
                if not self.joint[at]:
                    joint += 1
                    self.joint[at] = joint
                cued[self.joint[at], self.sl_no[o[:2]]] = self._weight(_CUED(a[2], b[2], o))
        self.cued = np.zeros((joint + 1, len(self.sl_no) + 1), np.int32)
        for i, at in enumerate(cued, 1):
            self.cued[at] = i
        self.triples, self.pairs = np.array(triples, np.float32), np.array([none, *cued.values()], np.float32)
        self.first_pad, self.last_pad = (self._class(o) for o in _PADS)
        # For each kind what transitions can add to a span at its first token, at each other one, and behind it, against no tag.
        starts = [i for i, t in enumerate(self.tags) if not t.startswith("I-")]
        kinds, t = [(self.tags.index(f"B-{k}"), self.tags.index(f"I-{k}")) for k in KINDS[4:]], self.t
        self.steps = [(b, i, max(0.0, (t[:, b] - t[:, 0]).max()), max(t[b, i], t[i, i]) - t[0, 0], max(0.0, (t[[b, i]][:, starts] - t[0, starts]).max())) for b, i in kinds]

    def _weight(self, feature: str) -> np.ndarray:
        return self.w[self.names.get(feature, len(self.names))]

    def _class(self, own: tuple[str, str, str, str]) -> int:
        """The number of all tokens with the same known features."""
        key = (self.shape_no.get(own[0], 0), self.sl_no.get(own[:2], 0), self.cue_no[own[2]], self.length_no.get(own[1], 0), self.begin_no.get(own[3], 0))
        if (no := self.class_no.get(key)) is None:
            no = self.class_no[key] = len(self.parts)
            self.parts.append(key[:3])
            for rows, of in zip(self.rows, (_OF_OWN, _OF_LAST, _OF_SECOND_LAST, _OF_NEXT, _OF_SECOND_NEXT), strict=True):
                rows.append(sum(self._weight(f) for f in of(own)).astype(np.float32))
            self.stacked = None
        return no

    def classes(self, tokens: list[str]) -> list[int]:
        """The class of each token; -1 for the end of a line."""
        if len(self.of_token) > TOKENS:
            self.of_token = {"\n": -1}
        known = self.of_token
        new = {t: self._class(_own(t)) for t in set(tokens).difference(known)}
        known.update(x for x in new.items() if len(x[0]) <= 64)
        if any(len(t) > 64 for t in new):
            return [known[t] if t in known else new[t] for t in tokens]
        return list(map(known.__getitem__, tokens))

    def emissions(self, line: np.ndarray) -> np.ndarray:
        """n x tags for classes with two pads on either side of each line."""
        if self.stacked is None:
            self.stacked = [np.array(r, np.float32) for r in self.rows], np.array(self.parts, np.int64).T
        (own, last, last2, after, after2), (shapes, sl, cue) = self.stacked
        out = own[line]
        out[1:] += last[line[:-1]]
        out[2:] += last2[line[:-2]]
        out[:-1] += after[line[1:]]
        out[:-2] += after2[line[2:]]
        s, c = shapes[line], cue[line]
        out[1:-1] += self.triples[self.triple[s[:-2], s[1:-1], s[2:]]]
        out[2:] += self.pairs[self.cued[self.joint[c[:-2], c[1:-1]], sl[line[2:]]]]
        return out

    def may_be_tagged(self, emit: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Which of the real tokens (the others are pads) lie in a span that can gain (a little less than 0, for rounding)."""
        out = np.zeros(len(emit), bool)
        for begins, inside, first, other, behind in self.steps:
            one = np.where(real, emit[:, begins] - emit[:, 0] + first, -1e4)
            sums = np.cumsum(np.where(real, emit[:, inside] - emit[:, 0] + other, -1e4), dtype=np.float64)
            best_end = np.maximum.accumulate(sums[::-1])[::-1]
            best_start = np.maximum.accumulate(one - sums)
            out |= best_start + best_end + behind > -1e-2
        return out & real

    def viterbi(self, emits: list[np.ndarray], batch: int = 2048) -> list[np.ndarray]:
        """The numbers of the likeliest tags of each line, over batches of lines of like length."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(emits)
        order = sorted((i for i in range(len(emits)) if len(emits[i])), key=lambda i: len(emits[i]))
        tt = np.where(self.allowed, self.t, -1e9).astype(np.float32)
        s = 0
        while s < len(order):
            e = s + 1
            while e < len(order) and e - s < batch and len(emits[order[e]]) * (e - s + 1) < 100_000:
                e += 1
            some = order[s:e]
            length = np.array([len(emits[i]) for i in some])
            emit = np.zeros((length[-1], len(some), len(self.tags)), np.float32)
            for k, i in enumerate(some):
                emit[: length[k], k] = emits[i]
            best, came = emit[0] + np.where(self.first, 0, np.float32(-1e9)), np.zeros(emit.shape, np.int8)
            for j in range(1, len(emit)):
                step = best[:, :, None] + tt[None]
                came[j] = step.argmax(1)
                best = np.where((j < length)[:, None], step.max(1) + emit[j], best)
            tag = best.argmax(1)
            path = np.zeros((len(some), len(emit)), np.int8)
            for j in range(len(emit) - 1, -1, -1):
                path[:, j] = tag
                if j:
                    tag = np.where(j < length, came[j][np.arange(len(some)), tag], tag)
            for k, i in enumerate(some):
                out[i] = path[k, : length[k]]
            s = e
        return out

    def decode(self, lines: list[list[str]]) -> list[list[str]]:
        """The likeliest tags of each line of tokens."""
        pad = lambda x: np.array([self.first_pad] * 2 + x + [self.last_pad] * 2, np.int64)
        emits = [self.emissions(pad(self.classes(x)))[2:-2] for x in lines]
        return [[self.tags[k] for k in path] for path in self.viterbi(emits)]


#: Tokens whose class a worker remembers, and characters of a text that are split into tokens at once.
TOKENS, SLICE = 200_000, 1 << 20


_FIELD: list[Field] = []


def field() -> Field:
    """The field trained on labelled_rows(), once a process."""
    if not _FIELD:
        _FIELD.append(Field(labelled_rows()))
    return _FIELD[0]


def _classed(text: str, model: Field) -> np.ndarray:
    """Classes of the text's tokens, a slice at a time; -1 at the ends of lines."""
    if len(text) <= SLICE:
        return np.array(model.classes(_TOKEN_OR_END.findall(text)), np.int32)
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        while end < len(text) and (text[end].isalnum() or text[end] == "_"):  # not within a word
            end += 1
        out.append(np.array(model.classes(_TOKEN_OR_END.findall(text, at, end)), np.int32))
        at = end
    return np.concatenate(out)


def _lined(classed: list[np.ndarray], model: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes of all texts with pads around each line, first token of each line, index of each text's first line)."""
    flat = np.concatenate([x for c in classed for x in (c, np.array([-1], np.int32))])
    ends = np.flatnonzero(flat == -1)
    wide = np.repeat(flat.astype(np.int64), np.where(flat == -1, 4, 1))
    at = ends + 3 * np.arange(len(ends))
    for i, pad in enumerate((model.last_pad, model.last_pad, model.first_pad, model.first_pad)):
        wide[at + i] = pad
    wide = np.concatenate([np.full(2, model.first_pad, np.int64), wide[:-2]])
    n = np.array([np.count_nonzero(c == -1) + 1 for c in classed])
    return wide, np.concatenate([[2], at[:-1] + 6]), np.concatenate([[0], np.cumsum(n)])


def added_spans(texts: list[str | None], model: Field) -> list[list[Span]]:
    """(start, end, kind) of the field's spans in each text."""
    out: list[list[Span]] = [[] for _ in texts]
    wide, first, of_text = _lined([_classed(t or "", model) for t in texts], model)
    last = np.append(first[1:] - 4, len(wide) - 2)
    text, emits, where, s = np.repeat(np.arange(len(texts)), np.diff(of_text)), [], [], 0
    none = np.full(len(model.tags), -1e9, np.float32)
    none[0] = 0
    while s < len(first):  # lines of about a slice at once
        e = max(s + 1, int(np.searchsorted(first, first[s] + SLICE)))
        a, b = int(first[s]) - 2, int(last[e - 1]) + 2
        cuts = [(max(a, i - 2), i) for i in range(a, b, SLICE)]  # slices reach as far as features do
        emit = np.concatenate([model.emissions(wide[lo : min(b, i + SLICE + 2)])[i - lo :][:SLICE] for lo, i in cuts])
        real = (wide[a:b] != model.first_pad) & (wide[a:b] != model.last_pad)
        some = np.concatenate([[False], model.may_be_tagged(emit, real), [False]])
        edges = np.flatnonzero(some[1:] != some[:-1])
        for lo, hi in edges.reshape(-1, 2).tolist():
            emits.append(np.concatenate([none[None]] * bool(real[lo - 1]) + [emit[lo:hi]] + [none[None]] * bool(real[hi])))
            where.append(lo + a - bool(real[lo - 1]))
        s = e
    tagged = [(at, path) for at, path in zip(where, model.viterbi(emits), strict=True) if path.any()]
    now, starts, tokens, line = -1, [], [], -1
    for at, path in tagged:
        i = int(np.searchsorted(first, at, "right")) - 1
        if int(text[i]) != now:
            now = int(text[i])
            starts = [0, *(m.start() + 1 for m in re.finditer("\n", texts[now])), len(texts[now]) + 1]
        if i != line:
            line, n = i, i - int(of_text[now])
            tokens = [m.span() for m in _TOKEN.finditer(texts[now], starts[n], starts[n + 1] - 1)]
        k = 0
        while k < len(path):
            tag = model.tags[path[k]]
            if not tag.startswith("B-"):
                k += 1
                continue
            e = k + 1
            while e < len(path) and model.tags[path[e]] == "I-" + tag[2:]:
                e += 1
            place = at - int(first[i])
            out[now].append((tokens[place + k][0], tokens[place + e - 1][1], tag[2:]))
            k = e
    return out


def spans(texts: list[str | None], model: Field) -> list[list[tuple[int, int, str, bool]]]:
    """(start, end, kind, whether a pattern found it) in each text, in order."""
    out = []
    for text, more in zip(texts, added_spans(texts, model), strict=True):
        base = base_spans(text) if text else []
        new = [(*m, False) for m in more if all(m[1] <= s or m[0] >= t for s, t, _ in base)]
        out.append(sorted([*((*s, True) for s in base), *new], key=lambda s: (s[0], KINDS.index(s[2]))))
    return out


SPANS = "array<struct<start: bigint, end: bigint, kind: string, base: boolean>>"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every document; no shuffle."""
    model = field()
    small = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = small.schema["id"].dataType.simpleString()
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 128):
                found = spans(batch.column(1)[s : s + 128].to_pylist(), model)
                rows = [[{"start": a, "end": b, "kind": k, "base": own} for a, b, k, own in x] for x in found]
                yield pa.RecordBatch.from_arrays([batch.column(0)[s : s + 128], pa.array(rows, kind)], names=[id_col, "spans"])

    return small.mapInArrow(kernels.trimmed(run), f"`{id_col}` {id_type}, spans {SPANS}")


def joined(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: str, found: list[tuple[int, int, str, bool]]) -> str:
    """Each span replaced by its kind in angle brackets; of overlapping spans the first."""
    out, at = [], 0
    for start, end, kind, _ in found:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
            at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span in the text replaced; no shuffle."""
    model = field()
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 128):
                part = batch.slice(s, 128)
                texts = part.column(at).to_pylist()
                new = [None if t is None else redacted(t, f) for t, f in zip(texts, spans(texts, model), strict=True)]
                columns = [pa.array(new, pa.string()) if i == at else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return docs.mapInArrow(kernels.trimmed(run), docs.schema)
