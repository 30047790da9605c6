"""Personal data: patterns with checks, and a linear-chain conditional random field for what patterns do not spell out.

The patterns find e-mail addresses, IPv4 addresses, card numbers and phone numbers in linear time.  The field labels tokens
(runs of letters and digits, single marks) as begin or inside of a kind, or other, from features of their shapes and of those of two
neighbours on each side; it is trained on the driver from a small labelled table (ROWS sentences made by rules, or
the caller's own) and finds also numbers without a country code, spelled-out addresses, persons after a title and
identity numbers.  In tasks, a batch's distinct tokens are given features once, and all chains of the batch are decoded
together, position by position, by Viterbi's rule in numpy.  A chain is a stretch of tokens of which each is at most
RADIUS tokens from one that has a digit, an @, or a cue word; elsewhere every token is other.  Chains over CORE tokens are decoded in
pieces that see MARGIN tokens more on each side.  A span of the field is kept if it passes its kind's check and overlaps no pattern's span.

Odd rows: a null text is an empty one, without spans; repeated rows are scanned each; an empty table gives no rows; texts of over
PIECE characters are cut for the field only, with 2000 characters of overlap.  Other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryloom.sources.tables import spread

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "person", "id")
TAGS = ("O", *(f"{x}-{k}" for k in KINDS for x in "BI"))
RADIUS, CORE, MARGIN = 6, 192, 32
PIECE, OVERLAP = 1 << 20, 2000
#: Bytes of text that are decoded together.
BYTES = 2 << 20
#: Sentences of the labelled table, steps of training, and the weight of the squared weights.
ROWS, STEPS, RIDGE = 960, 80, 0.02
CUES = frozenset("mr mrs ms dr prof dear name call phone tel mobile fax email mail write reach card visa ssn passport iban id at dot is to ip host version page order isbn total".split())
SEEDS = frozenset("mr mrs ms dr prof dear name dot ssn passport iban".split())

# ---- patterns

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits that fails from its first digit fails from every later one
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", at + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for kind, pattern, least, most in (("card", _CARD, 16, 19), ("phone", _PHONE, 8, 15)):
        for m in pattern.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if least <= len(digits) <= most and (kind == "phone" or luhn(digits)):
                out.append((kind, m.start(), m.end()))
    return out


# ---- tokens and their features

_CLASS = np.full(256, 2, np.int8)  # marks
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
for _from, _to in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _CLASS[_from:_to] = 1


def token_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end bytes of the tokens."""
    kind = _CLASS[raw]
    before = np.append(np.int8(0), kind[:-1]) if len(kind) else kind
    after = np.append(kind[1:], np.int8(0)) if len(kind) else kind
    return np.flatnonzero((kind == 2) | ((kind == 1) & (before != 1))), np.flatnonzero((kind == 2) | ((kind == 1) & (after != 1))) + 1


_RUN = re.compile("[0-9]+|[A-Z]+|[^0-9A-Z]+")


def features(token: str) -> list[str]:
    if token.isascii() and token.isdigit():
        out = ["digits", f"d{min(len(token), 20)}"]
        if len(token) <= 3 and int(token) <= 255:
            out.append("byte")
        if len(token) == 4 and token[:2] in ("19", "20"):
            out.append("year")
        if 13 <= len(token) <= 19:
            out.append("luhn" if luhn(token) else "not luhn")
        return out
    if len(token) == 1 and not token.isalnum():
        return ["mark", f"m{token}"]
    if any(c in "0123456789" for c in token[:64]):
        shape = "".join("d" if m.group()[0] in "0123456789" else "A" if m.group()[0].isupper() else "a" for m in _RUN.finditer(token[:64]))
        return ["mixed", f"s{shape[:6]}", f"l{min(len(token), 12) // 3}"]
    low = token.lower() if len(token) <= 8 else ""
    out = ["word", "lower" if token == low or token[:1].islower() else "upper" if len(token) > 1 and token[:64].isupper() else "capital"]
    return [*out, f"w{low}"] if low in CUES else out


def is_seed(token: str) -> bool:
    return token == "@" or any(c in "0123456789" for c in token) or (len(token) <= 8 and token.lower() in SEEDS)


# ---- the field

#: Whose features count for a token's tag, and whether only where the token touches the one before.
OFFSETS = ((0, False), (-1, False), (1, False), (-2, False), (2, False), (0, True), (-1, True))
K = len(TAGS)
ALLOWED = np.array([[t[0] != "I" or (s != "O" and s[2:] == t[2:]) for t in TAGS] for s in TAGS])
NEVER = -1e9


@dataclass(frozen=True)
class Field:
    """Weights of features by offset and tag, of a token that touches the one before, of pairs of tags, and of a chain's first tag."""

    names: tuple[str, ...]
    weights: np.ndarray
    touching: np.ndarray
    pairs: np.ndarray
    first: np.ndarray

    def scores(self, kinds: list[tuple[str, ...]]) -> np.ndarray:
        """By offset, list of features and tag; a last one stands for a text's edge."""
        at = {n: k for k, n in enumerate(self.names)}
        out = np.zeros((len(OFFSETS), len(kinds) + 1, K))
        for k, kind in enumerate(kinds):
            out[:, k] = self.weights[:, [at[f] for f in kind if f in at]].sum(1)
        out[:, -1] = self.weights[:, at["edge"]] if "edge" in at else 0
        return out


def viterbi(emitted: np.ndarray, lengths: np.ndarray, pairs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best tags of each of several padded chains; of equal ones the first tags in TAGS' order, from the end."""
    n, t, k = emitted.shape
    back, best = np.zeros((n, t, k), np.int8), emitted[:, 0] + first
    last = best.copy()
    for at in range(1, t):
        step = best[:, :, None] + pairs
        back[:, at] = step.argmax(1)
        best = step.max(1) + emitted[:, at]
        last = np.where((lengths > at)[:, None], best, last)
    out = np.zeros((n, t), np.int64)
    tag = last.argmax(1)
    rows = np.arange(n)
    for at in range(t - 1, -1, -1):
        inside = at < lengths
        out[:, at] = np.where(inside, tag, 0)
        tag = np.where(inside, back[rows, at, tag], tag)
    return out


def _tokens(text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, whether each touches the one before, and first and end code points."""
    data = text.encode("utf-8", "replace")
    raw = np.frombuffer(data, np.uint8)
    start, end = token_bounds(raw)
    place = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
    touch = np.append(False, start[1:] == end[:-1]) if len(start) else np.zeros(0, bool)
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(start, end, strict=True)], touch, place[start], place[end]


def train(labelled: list[tuple[str, list[tuple[str, int, int]]]], *, steps: int = STEPS) -> Field:
    """Maximum likelihood with squared weights, over texts with their (kind, start, end); the table must fit the driver."""
    chains = []
    for text, spans in labelled:
        words, touch, start, end = _tokens(text)
        tags = np.zeros(len(words), np.int64)
        for kind, a, b in spans:
            here = np.flatnonzero((start >= a) & (end <= b))
            tags[here] = TAGS.index(f"I-{kind}")
            tags[here[:1]] = TAGS.index(f"B-{kind}")
        if words:
            chains.append((words, touch, tags))
    known = sorted({w for words, _, _ in chains for w in words})
    names = ("edge", *sorted({f for w in known for f in features(w)}))
    at, number = {n: k for k, n in enumerate(names)}, {w: k for k, w in enumerate(known)}
    has = np.zeros((len(known) + 1, len(names)))
    for k, w in enumerate(known):
        has[k, [at[f] for f in features(w)]] = 1
    has[-1, 0] = 1
    n, t = len(chains), max((len(c[0]) for c in chains), default=1)
    lengths = np.array([len(c[0]) for c in chains])
    ids, touching, gold = np.full((n, t + 4), len(known)), np.zeros((n, t)), np.zeros((n, t), np.int64)
    for k, (words, touch, tags) in enumerate(chains):
        ids[k, 2 : 2 + len(words)] = [number[w] for w in words]
        touching[k, : len(words)], gold[k, : len(words)] = touch, tags
    inside = np.arange(t)[None, :] < lengths[:, None]
    seen = [ids[:, 2 + o : 2 + o + t] for o, _ in OFFSETS]
    counts = [touching[:, :, None] if only else np.ones((n, t, 1)) for _, only in OFFSETS]
    one = np.eye(K)[gold] * inside[:, :, None]
    pair_gold = np.einsum("ntk,ntl->kl", one[:, :-1], one[:, 1:])
    theta = {"w": np.zeros((len(OFFSETS), len(names), K)), "t": np.zeros(K), "p": np.zeros((K, K)), "f": np.zeros(K)}
    moment, power = ({k: np.zeros_like(v) for k, v in theta.items()} for _ in range(2))
    barred, barred_first = np.where(ALLOWED, 0, NEVER), np.where([x[0] == "I" for x in TAGS], NEVER, 0)
    for step in range(1, steps + 1):
        scores = [has @ theta["w"][o] for o in range(len(OFFSETS))]
        emitted = sum(s[i] * c for s, i, c in zip(scores, seen, counts, strict=True)) + touching[:, :, None] * theta["t"]
        pairs, first = theta["p"] + barred, theta["f"] + barred_first
        # forward and backward in shares of each position's sum
        top = emitted.max(2, keepdims=True)
        e, p = np.exp(emitted - top), np.exp(pairs)
        ahead, behind, total = np.zeros((n, t, K)), np.ones((n, t, K)), np.ones((n, t, 1))
        for k in range(t):
            x = e[:, k] * (np.exp(first) if k == 0 else ahead[:, k - 1] @ p)
            total[:, k] = np.where(inside[:, k, None], x.sum(1, keepdims=True), 1)
            ahead[:, k] = np.where(inside[:, k, None], x / total[:, k], 0)
        for k in range(t - 2, -1, -1):
            behind[:, k] = np.where(inside[:, k + 1, None], (e[:, k + 1] * behind[:, k + 1] / total[:, k + 1]) @ p.T, 1)
        wrong = one - ahead * behind
        expected = p * np.einsum("ntk,ntl->kl", ahead[:, :-1], (e * behind / total * inside[:, :, None])[:, 1:], optimize=True)
        slope = {"t": (wrong * touching[:, :, None]).sum((0, 1)), "p": pair_gold - expected, "f": wrong[:, 0].sum(0), "w": np.zeros_like(theta["w"])}
        for o, i in enumerate(seen):
            by_token = np.zeros((len(known) + 1, K))
            np.add.at(by_token, i.ravel(), (wrong * counts[o]).reshape(-1, K))
            slope["w"][o] = has.T @ by_token
        for k in theta:
            g = slope[k] - RIDGE * theta[k]
            moment[k] = 0.9 * moment[k] + 0.1 * g
            power[k] = 0.99 * power[k] + 0.01 * g * g
            theta[k] = theta[k] + 0.15 * (moment[k] / (1 - 0.9**step)) / (np.sqrt(power[k] / (1 - 0.99**step)) + 1e-6)
    return Field(names, theta["w"], theta["t"], theta["p"] + barred, theta["f"] + barred_first)


def labelled_table(rows: int = ROWS, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts with their spans, made by rules: each kind in its usual spellings, and numbers and names that are none of them."""
    rng = random.Random(seed)
    r, pick = rng.randint, rng.choice
    digits = lambda n: "".join(str(r(0, 9)) for _ in range(n))
    word = lambda: "".join(pick("the an re on er ti st en de la ch un sh in ou".split()) for _ in range(r(1, 4)))
    name = lambda: word().capitalize()
    host = lambda: f"{word()}{pick(['', digits(1)])}.{pick(['com', 'org', 'net', 'example.com', 'de'])}"

    def checked(n: int, good: bool = True) -> str:
        head = str(r(3, 6)) + digits(n - 2)
        last = next(str(d) for d in range(10) if luhn(head + str(d)))
        return head + (last if good else str((int(last) + r(1, 9)) % 10))

    def groups(number: str, sizes: tuple[int, ...], between: str) -> str:
        out, at = [], 0
        for s in sizes:
            out.append(number[at : at + s])
            at += s
        return between.join(out)

    area = lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"
    spelled = lambda: pick([f"{word()} at {word()} dot {pick(['com', 'org', 'net'])}", f"{word()} (at) {word()} (dot) {pick(['com', 'org'])}", f"{word()} [at] {word()} [dot] com"])
    made = [
        lambda: [("email", f"{word()}{pick(['', '.' + digits(2), '_' + word()])}@{host()}")],
        lambda: [pick(["email ", "mail: ", "write to ", ""]), ("email", spelled())],
        lambda: [pick(["ip ", "host ", ""]), ("ip", ".".join(str(r(0, 255)) for _ in range(4)))],
        lambda: [pick(["card ", "visa: ", ""]), ("card", pick([checked(16), groups(checked(16), (4, 4, 4, 4), pick(" -.")), groups(checked(15), (4, 6, 5), pick(" -"))]))],
        lambda: [pick(["", "phone ", "tel. "]), ("phone", f"+{r(1, 99)} {pick([area(), digits(2) + ' ' + digits(7), digits(3) + '-' + digits(3) + '-' + digits(4)])}")],
        lambda: [pick(["", "call ", "phone: "]), ("phone", pick([area(), groups(digits(10), (3, 3, 4), pick("-.")), area()]))],
        lambda: [pick(["call ", "phone: ", "tel ", "tel: ", "mobile "]), ("phone", pick([digits(3) + "-" + digits(4), "0" + digits(3) + " " + digits(7), digits(10)]))],
        lambda: [pick(["Mr. ", "Mrs. ", "Ms. ", "Dr. ", "Mr ", "Prof. ", "Dear ", "name: ", "name is "]), ("person", pick([name(), f"{name()} {name()}"]))],
        lambda: [pick(["SSN ", "ssn: ", "SSN is ", ""]), ("id", f"{digits(3)}-{digits(2)}-{digits(4)}")],
        lambda: [pick(["passport ", "Passport: "]), ("id", f"{pick('CFGXL')}{digits(2)}{pick('XTK')}{digits(5)}")],
        lambda: ["IBAN ", ("id", f"{pick(['DE', 'FR', 'ES'])}{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}")],
    ]
    other = [
        lambda: [f"{r(1, 31)}.{r(1, 12)}.{r(1950, 2030)}"], lambda: [f"{r(1950, 2030)}-{r(10, 12)}-{r(10, 31)}"], lambda: [f"{r(1, 23)}:{r(10, 59)}"], lambda: [f"version {r(1, 9)}.{r(0, 20)}.{r(0, 9)}"],
        lambda: [f"${r(1, 900)}.{digits(2)}"], lambda: [f"{r(1, 999)},{digits(3)} {word()}"], lambda: [checked(16, good=False)], lambda: [f"order {digits(r(5, 9))}"], lambda: [f"isbn {groups(digits(13), (3, 1, 5, 3, 1), '-')}"],
        lambda: [f"token = \"{''.join(pick('0123456789abcdef') for _ in range(40))}\""], lambda: [f"page {r(1, 900)}-{r(901, 999)}"], lambda: [f"{name()} {name()} {word()}"], lambda: [f"the Apache License, Version {r(1, 3)}.0."],
        lambda: [f"name {word()}"], lambda: [f"call {word()} at {word()}"], lambda: [f"password: {word()}{digits(4)}{name()}"], lambda: [digits(r(17, 24))], lambda: [f"{digits(2)}% of {digits(r(1, 6))}"], lambda: [f"dot {word()}"], lambda: [f"AKIA{digits(4)}{word().upper()}{digits(3)}"],
        lambda: [f"{r(256, 999)}.{digits(3)}.{digits(3)}.{digits(3)}"], lambda: [f"{word()} {word()}. {name()} {word()}, {word()}"], lambda: [f"{r(1, 99)}/{r(1, 99)} ({r(1950, 2030)})"], lambda: [digits(r(5, 12))], lambda: [f"the GNU General Public License, version {r(1, 3)}."],
        lambda: [f"{name()}. {name()}. {name()}. {word()} {digits(2)}"], lambda: [f"{name()} {name()} {name()}, {digits(3)} {word()}"], lambda: [f"{word()}.\n{name()}. {name()}, {word()} the {digits(1)}"],
    ]
    out = []
    for k in range(rows):
        text, spans = "", []
        for part in [" ".join(word() for _ in range(r(0, 5))) + " ", *(made[(k // 2) % len(made)]() if k % 2 == 0 else other[(k // 2) % len(other)]()), pick([" ", ". ", ", ", "&&& ", "%%% ", "!! "]), " ".join(word() for _ in range(r(0, 4)))]:
            if isinstance(part, tuple):
                spans.append((part[0], len(text), len(text) + len(part[1])))
                part = part[1]
            text += part
        out.append((text, spans))
    return out


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_table())


# ---- decoding

_TITLE = re.compile(r"(?i)(?<![a-z])(?:mr|mrs|ms|dr|prof|dear|name|name is)[.:]?[ ]{0,2}$")
_AT_DOT = re.compile(r"@|\bat\b", re.I), re.compile(r"\.|\bdot\b", re.I)


def plausible(kind: str, text: str, before: str = "") -> bool:
    """Whether a span of the field, with the dozen characters before it, is what its kind says."""
    digits = _NOT_DIGIT.sub("", text)
    if kind == "email":
        return len(text) <= 320 and all(p.search(text) for p in _AT_DOT) and text[-1].isalnum()
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and _small(p) for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15 and not re.search("[A-Za-z]", text)
    if kind == "id":
        return 7 <= len(digits) <= 30
    return len(text) > 1 and bool(_TITLE.search(before))


def _chains(seed: np.ndarray, edge: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(first, end, first kept, end kept) of the pieces that are decoded."""
    change = np.zeros(len(seed) + 1, np.int64)
    at = np.flatnonzero(seed)
    np.add.at(change, np.maximum(at - RADIUS, 0), 1)
    np.add.at(change, np.minimum(at + RADIUS + 1, len(seed)), -1)
    near = np.append(False, np.append((np.cumsum(change[:-1]) > 0) & ~edge, False))
    turns = np.flatnonzero(near[1:] != near[:-1])
    return [(max(a, k - MARGIN), min(b, k + CORE + MARGIN), k, min(b, k + CORE)) for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True) for k in range(a, b, CORE)]


_CUES, _PLAIN = frozenset(c.encode() for c in CUES), ("word", "lower")


class Decoder:
    """A field and what it knows of tokens it has met (at most `most` of them): tokens with the same features share their scores."""

    def __init__(self, field: Field, most: int = 200_000):
        self.field, self.most, self.known, self.kinds = field, most, {}, {}
        self.scores, self.seeds = field.scores([]).astype(np.float32), np.zeros(0, bool)

    def numbers(self, tokens: list[bytes]) -> np.ndarray:
        """The number of each token's features; the last row of scores is a text's edge."""
        if len(self.known) + len(tokens) > self.most:
            self.known = {}
        fresh = []
        for t in tokens:
            if t not in self.known:
                plain = t.isalpha() and t.islower() and t not in _CUES
                word = "lower" if plain else t.decode("utf-8", "replace")
                kind = _PLAIN if plain else tuple(features(word))
                if kind not in self.kinds:
                    self.kinds[kind] = len(self.kinds)
                    fresh.append((kind, is_seed(word)))
                self.known[t] = self.kinds[kind]
        if fresh:
            self.scores = np.concatenate((self.scores[:, :-1], self.field.scores([k for k, _ in fresh]).astype(np.float32)), 1)
            self.seeds = np.append(self.seeds, [s for _, s in fresh])
        return np.array([self.known[t] for t in tokens], np.int64)

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) by text, of code points, as the field has them."""
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        data = [t.encode("utf-8", "replace") for t in texts]
        raw = np.frombuffer(b"\n".join(data), np.uint8)
        start, end = token_bounds(raw)
        if not len(start):
            return out
        # the gaps are left out of an array of tokens and gaps
        bounds = pa.py_buffer(np.append(0, np.stack((start, end), 1).ravel()).astype(np.int64))
        every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(start), [None, bounds, pa.py_buffer(raw)])
        coded = every.take(pa.array(np.arange(1, 2 * len(start), 2))).dictionary_encode()
        known = self.numbers(coded.dictionary.to_pylist())
        first = np.cumsum([0, *(len(d) + 1 for d in data)])
        text = np.searchsorted(first, start, "right") - 1
        # two edges between texts, so that neighbours are never of another one
        token = known[coded.indices.to_numpy(zero_copy_only=False)]
        place = np.arange(len(start)) + 2 * (text + 1)
        ids = np.full(len(start) + 2 * (len(texts) + 1), self.scores.shape[1] - 1)
        ids[place] = token
        of = np.full(len(ids), -1)
        of[place] = np.arange(len(start))
        seed = np.append(self.seeds, False)[ids]
        chains = _chains(seed, of < 0)
        if not chains:
            return out
        touch = np.append(False, start[1:] == end[:-1]) & (np.append(-1, text[:-1]) == text)
        chains.sort(key=lambda c: c[1] - c[0])
        tags = np.zeros(len(ids), np.int64)
        for k in range(0, len(chains), 512):
            some = chains[k : k + 512]
            lengths = np.array([c[1] - c[0] for c in some])
            at = np.array([c[0] for c in some])[:, None] + np.arange(lengths.max())[None, :]
            at = np.minimum(at, len(ids) - 3)
            touches = (touch[np.maximum(of[at], 0)] & (of[at] >= 0))[:, :, None]
            emitted = touches * self.field.touching
            for o, (shift, only) in enumerate(OFFSETS):
                own = self.scores[o][ids[np.clip(at + shift, 0, len(ids) - 1)]]
                emitted = emitted + (own * touches if only else own)
            found = viterbi(emitted, lengths, self.field.pairs, self.field.first)
            for row, (a, _, keep, upto) in zip(found, some, strict=True):
                tags[keep:upto] = row[keep - a : upto - a]
        begins = np.flatnonzero(tags % 2 == 1)
        if not len(begins):
            return out
        points = np.cumsum((raw & 0xC0) != 0x80)
        for b in begins.tolist():
            e = b + 1
            while e < len(tags) and tags[e] == tags[b] + 1:
                e += 1
            x, y = of[b], of[e - 1]
            doc = int(text[x])
            shift = int(points[first[doc] - 1]) if first[doc] else 0
            out[doc].append((KINDS[(tags[b] - 1) // 2], int(points[start[x]]) - 1 - shift, int(points[end[y] - 1]) - shift))
        return out

    def added(self, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
        """What the field finds besides the base spans, by kind, then start."""
        pieces, whose = [], []
        for k, t in enumerate(texts):
            for a in range(0, max(1, len(t)), PIECE):
                low = max(0, a - OVERLAP)
                pieces.append(t[low : a + PIECE + OVERLAP])
                whose.append((k, low, a))
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        for (k, low, a), found in zip(whose, self.spans(pieces), strict=True):
            taken = sorted((s, e) for _, s, e in base[k])
            for kind, s, e in ((x[0], x[1] + low, x[2] + low) for x in found):
                if a <= s < a + PIECE and plausible(kind, texts[k][s:e], texts[k][max(0, s - 12) : s]) and not any(s < v and u < e for u, v in taken):
                    out[k].append((kind, s, e))
        return [sorted(x, key=lambda v: (KINDS.index(v[0]), v[1])) for x in out]


def _scan(field: Field):
    def said(spans: list[tuple[str, int, int]]) -> str:
        return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(field)
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, "right")))
                piece = batch.slice(at, to - at)
                at = to
                texts = [t or "" for t in piece.column("text").to_pylist()]
                base = [base_spans(t) for t in texts]
                more = decoder.added(texts, base)
                every = [sorted(b + m, key=lambda v: (KINDS.index(v[0]), v[1])) for b, m in zip(base, more, strict=True)]
                counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in BASE]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *counts, pa.array(list(map(said, base)), pa.string()), pa.array(list(map(said, every)), pa.string())], ["doc_id", *(f"n_{k}" for k in BASE), "base", "spans"])

    return run


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Columns: doc_id, n_email, n_ip, n_card, n_phone, base, spans (kind:start:end of code points, by kind, then start)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(field or default_field()), f"doc_id long, {', '.join(f'n_{k} long' for k in BASE)}, base string, spans string")


def op12_personal(spark, sf_dir: str) -> DataFrame:
    """All documents."""
    found = scan(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    return found.select("doc_id", *(f"n_{k}" for k in BASE), F.sha2("base", 256).alias("base_sha256"), "spans")
