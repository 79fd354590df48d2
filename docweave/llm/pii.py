"""Personal data by fixed patterns and a semi-Markov conditional random field.

Base spans come from four patterns with their checks (``base_spans``) and always
stay.  The field looks for further spans in the rest of the text, such as mail
addresses that are spelled out, telephone numbers without a plus, card numbers with
other separators and IPv6 addresses.

A text is a sequence of tokens (words, numbers, single signs); a segmentation cuts
it into single tokens of type "none" and longer or shorter entities.  A candidate is
any run of up to ``LONGEST`` tokens whose signs and sizes its type allows (``number``,
``hexadecimal``, ``spelled``); a run of digits may be of several types.  Features look
at the whole span (digit count, group sizes, separators, checksum), at the
signs beside it and at the words before and behind it, in four languages.
A Viterbi pass over (last token, type) chooses boundaries and types jointly.  "None"
scores zero and tokens far from any digit, "@", "::" or spelled "at" begin no candidate,
so that decoding the neighbourhoods of those is exact for the whole text.  Tokens of base
spans are fixed: no candidate holds one, those beside them are scored as others are.

The weights are fitted in the driver by gradient ascent on the conditional
likelihood of ``examples()``, made-up lines of a fixed number and seed in English,
German, French and Spanish.  No table row is read, so the model is the same for every
input.  ``examples(held_out=True)`` writes other formats with other words; precision
and recall on them are in the README and held by a test.

Null and empty texts have no spans.  Rows are independent, so repeated rows and
empty tables need no care; a text costs time in proportion to its length.  Other
columns pass through; ``spans`` is replaced.
"""

from __future__ import annotations

import random
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import exp, log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: patterns of the base spans: fixed values
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
Span = tuple[str, int, int]


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[Span]:
    """Four groups at a time, from the left of each dotted run."""
    for run in DOTTED.finditer(text):
        at = run.start()
        parts = run[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            own = parts[k : k + 4]
            end = at + sum(map(len, own)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in own):
                yield "ip", at, end
            at = end + 1


def base_spans(text: str | None) -> list[Span]:
    """By kind as in KINDS, then start; code points, end exclusive."""
    if not text:
        return []
    out = list(_emails(text)) + list(_ips(text))
    for m in NUMBER.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in PLUS.finditer(text):
        if 9 <= len(digits_of(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
#: near these a candidate may lie
TRIGGER = re.compile(
    r"[0-9]+|@|::|[\[({<]\x20?(?:at|\u00e4t|arroba|arobase|klammeraffe)\x20?[\])}>]|(?<![^\W_])(?P<said>at|\u00e4t|arroba|arobase|klammeraffe)(?![^\W_])", re.IGNORECASE
)
#: characters that are looked through at first for the tokens beside a trigger
AROUND = 64
#: tokens of a candidate at most
LONGEST = 19
HEX = re.compile(r"[0-9A-Fa-f]{1,4}\Z")
AT = frozenset("at \u00e4t arroba arobase klammeraffe @".split())
DOT = frozenset("dot punkt punto point .".split())
#: words before a noun, which begin no domain: fixed values
SMALL = frozenset("the a an this that these those der die das den dem ein eine le la les un une el los las una".split())
OPEN, CLOSE = frozenset("([{<"), frozenset(")]}>")
SIGNS = frozenset("()-./_\u00b7\u2013")
ENDINGS = frozenset("com org net edu gov info io de fr es eu uk".split())
CUES = {
    word: kind
    for kind, words in {
        "phone": "phone tel telephone call mobile cell fax dial number telefon handy rufnummer nummer anruf durchwahl mobil t\u00e9l\u00e9phone t\u00e9l portable appelez num\u00e9ro fixe tel\u00e9fono m\u00f3vil llame n\u00famero fijo celular",
        "card": "card visa credit mastercard debit pan amex karte kreditkarte kartennummer carte bancaire cb tarjeta cr\u00e9dito d\u00e9bito",
        "ip": "ip ipv6 host server addr gateway dns router rechner knoten serveur h\u00f4te passerelle servidor nodo",
        "email": "mail email contact write reach kontakt schreib schreiben courriel contactez \u00e9crivez correo escriba contacto",
        "other": "mac version date datum fecha isbn order bestellung pedido commande time uhr heure hora page seite p\u00e1gina invoice rechnung facture factura token serial article id lot room flat suite zimmer wohnung chambre habitación gps lat lon latitude longitude coordinates koordinaten position ticket case year jahr a\u00f1o euro eur usd price preis prix precio iban",
    }.items()
    for word in words.split()
}
LABELS = ("none", *KINDS)
#: first and last token, and label
Segment = tuple[int, int, str]
Weights = dict[str, float]


def _side(c: str) -> str:
    return "edge" if not c else "space" if c.isspace() else "word" if c.isalnum() or c == "_" else c


class Zone:
    """Tokens of a part of a text; ``start`` passes the candidates that begin with a token to ``take``."""

    def __init__(self, text: str, begin: int, end: int, taken: list[tuple[int, int]], take: Callable[[int, int, str, tuple[str, ...]], None]):
        self.text, self.take = text, take
        self.tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text, begin, end)]
        self.words = [text[a:b] for a, b in self.tokens]
        n = len(self.tokens)
        self.fixed = [False] * n
        k = 0
        for i, (a, b) in enumerate(self.tokens):
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            whole = not (a and self.words[i][0].isalnum() and text[a - 1].isalnum()) and not (self.words[i][0].isalnum() and text[b : b + 1].isalnum())
            self.fixed[i] = not whole or any(x < b and a < y for x, y in taken[k : k + 3])
        self.cues = [CUES.get(w.lower()) for w in self.words]

    def start(self, i: int) -> None:
        if self.fixed[i]:
            return
        w = self.words[i]
        if w.isdecimal() or w in "(+" and i + 1 < len(self.words) and self.words[i + 1].isdecimal() and self.tokens[i + 1][0] == self.tokens[i][1]:
            self.number(i)
        if HEX.match(w) or w == ":":
            self.hexadecimal(i)
        if w[0].isalnum():
            self.spelled(i)

    def gap(self, j: int) -> str:
        """What stands between token j and the one before."""
        return self.text[self.tokens[j - 1][1] : self.tokens[j][0]]

    def add(self, i: int, j: int, label: str, features: list[str]) -> None:
        a, b = self.tokens[i][0], self.tokens[j][1]
        near = {c for c in self.cues[max(0, i - 5) : i] if c}
        features = [*features, f"left {_side(self.text[a - 1 : a])}", f"right {_side(self.text[b : b + 1])}", f"after {self.cues[j + 1] if j + 1 < len(self.cues) else None}"]
        features += [f"cue {c}" for c in near] or ["no cue"]
        for step, k in (("before", i - 1), ("behind", j + 1)):  # does the run of numbers go on?
            if 0 <= k < len(self.words) and self.words[k].isdecimal():
                features.append(f"number {step}")
        self.take(i, j, label, tuple([f"{label}:{f}" for f in ("any", *features)]))

    def number(self, i: int) -> None:
        digits, sizes, signs, j = "", [], set(), i
        while j < len(self.words) and j - i < LONGEST and not self.fixed[j]:
            w = self.words[j]
            gap = self.gap(j) if j > i else ""
            if gap not in ("", " ", "\u00a0", "  "):
                return
            if gap:
                signs.add(" ")
            if w.isdecimal():
                digits += w
                sizes.append(min(len(w), 9))
                if len(digits) > 19 or not w.isascii():
                    return
                shape = ["digits %d" % len(digits), "sizes " + "-".join(map(str, sizes[:6])), "groups %d" % len(sizes), "signs " + "".join(sorted(signs)), "first %s" % (digits[0] == "0")]
                even = len(set(sizes)) == 1 or len(set(sizes[1:])) == 1
                shape.append(f"even {even} short {min(sizes) == 1} last {sizes[-1]}")
                if 6 <= len(digits) <= 15:
                    year = len(sizes) == 3 and any(1900 <= int(x) <= 2099 for x in (digits[:4], digits[-4:]))
                    self.add(i, j, "phone", [*shape, f"year {year}", f"bracket {'(' in signs}"])
                if 13 <= len(digits) <= 19:
                    good = luhn(digits)
                    self.add(i, j, "card", [*shape, f"luhn {good}", f"fours {good and set(sizes[:-1]) == {4}}"])
            elif w in SIGNS or w == "+" and j == i:
                signs.add(w)
            else:
                return
            j += 1

    def hexadecimal(self, i: int) -> None:
        colons, groups, j = 0, [], i
        while j < len(self.words) and j - i < LONGEST and not self.fixed[j] and (j == i or not self.gap(j)):
            w = self.words[j]
            if w == ":":
                colons += 1
            elif HEX.match(w):
                groups.append(len(w))
            else:
                return
            if colons >= 2 and groups and (w != ":" or self.words[j - 1] == ":"):
                span = self.text[self.tokens[i][0] : self.tokens[j][1]]
                more = j + 1 < len(self.words) and not self.gap(j + 1) and (self.words[j + 1] == ":" or self.words[j + 1].isalnum())
                before = i > 0 and not self.gap(i) and (self.words[i - 1] == ":" or self.words[i - 1].isalnum())
                pairs = set(groups) == {2}
                shape = [f"groups {len(groups)}", f"double {span.count('::')}", f"letters {any(c.isalpha() for c in span)}", f"pairs {pairs}", f"cut {more or before}"]
                shape.append(f"whole {len(groups) == 8 and '::' not in span} {'::' in span and ':::' not in span}")
                self.add(i, j, "ip", shape)
            j += 1

    def spelled(self, i: int) -> None:
        """word (. - _ + dot word)* at word (dot word)+, where "at" and "dot" may stand in brackets."""
        said = lambda k: self.words[k].lower() in DOT and self.words[k] != "."
        if said(i):
            return
        at, j = i, i
        while at < len(self.words) and at - i < 10 and self.words[at].lower() not in AT:
            if at > i and self.gap(at) and self.words[at] not in OPEN and not (said(at) or said(at - 1)):
                return
            at += 1
        if at == i or at >= len(self.words) or self.words[at].lower() not in AT:
            return
        last = at - 1 - (self.words[at - 1] in OPEN)
        if last < i or not self.words[last][0].isalnum() or any(not (w[0].isalnum() or w in ".-_+%") for w in self.words[i : last + 1]):
            return
        boxed, dots, names, spoken = self.words[at - 1] in OPEN, 0, 0, 0
        local = [f"local dots {sum(map(said, range(i, last + 1)))} dot ahead {i > 1 and said(i - 1) and bool(self.gap(i))}", f"local small {self.words[last].lower() in SMALL}"]
        if said(last):
            return
        j, state = at + 1, "at"
        while j < len(self.words) and j - i < LONGEST and not self.fixed[j] and "\n" not in self.gap(j):
            w = self.words[j]
            if w in CLOSE or w in OPEN:
                pass
            elif w.lower() in DOT and state == "name":
                if w == "." and self.gap(j):
                    return
                state, dots, spoken = "dot", dots + 1, spoken + (w != ".")
            elif w == "-" and state == "name":
                state = "dash"
            elif w[0].isalnum() and state in ("at", "dot", "dash") and not (w == w.lower() and w in DOT):
                if self.words[j - 1] == "." and self.gap(j):
                    return
                state, names = "name", names + 1
                if dots:
                    known = w.lower() in ENDINGS
                    shape = [f"boxed {boxed}", f"dots {min(dots, 4)}", f"spoken {min(spoken, 2)}", f"ending {known}", f"boxed {boxed} spoken {min(spoken, 1)} ending {known}"]
                    first = next((x for x in self.words[at + 1 : j] if x[0].isalnum()), "")
                    shape += [*local, f"small {first.lower() in SMALL}"]
                    nxt = self.words[j + 1].lower() if j + 1 < len(self.words) else ""
                    shape += [f"goes on {nxt in DOT and nxt != '.' or nxt in OPEN}", f"starts whole {i == 0 or bool(self.gap(i))}", f"sign {self.words[at] == '@'}"]
                    if not any(self.fixed[i : j + 1]):
                        self.add(i, j, "email", shape)
            else:
                return
            j += 1


def score(weights: Weights, features: tuple[str, ...], label: str, previous: str) -> float:
    return sum(weights.get(f, 0.0) for f in features) + weights.get(f"{previous}>{label}", 0.0)


def decode(text: str, begin: int, end: int, taken: list[tuple[int, int]], weights: Weights) -> list[Span]:
    """The best segmentation of a part of a text: Viterbi over (last token, label).

    A candidate is scored when its first token is reached and forgotten at its last;
    what stays for each token are two small numbers for each label.
    """
    waiting: dict[int, list[tuple[int, int, float]]] = {}

    def take(i: int, j: int, label: str, features: tuple[str, ...]) -> None:
        waiting.setdefault(j, []).append((i, LABELS.index(label), sum([weights.get(f, 0.0) for f in features])))

    zone = Zone(text, begin, end, taken, take)
    n, m, never = len(zone.tokens), len(LABELS), float("-inf")
    moves = [[weights.get(f"{p}>{label}", 0.0) for p in LABELS] for label in LABELS]
    recent = {0: [0.0] + [never] * (m - 1)}  # best totals of the last LONGEST tokens
    first, before = array("i", [0]) * (m * (n + 1)), array("b", [0]) * (m * (n + 1))
    for j in range(n):
        zone.start(j)
        here = [never] * m
        for i, label, own in [(j, 0, 0.0), *waiting.pop(j, ())]:
            totals = [a + b for a, b in zip(recent[i], moves[label], strict=True)]
            value = max(totals)
            if value + own > here[label]:
                here[label] = value + own
                first[m * (j + 1) + label], before[m * (j + 1) + label] = i, totals.index(value)
        recent[j + 1] = here
        recent.pop(j - LONGEST, None)
    out: list[Span] = []
    label, at = recent[n].index(max(recent[n])), n
    while at:
        i, previous = first[m * at + label], before[m * at + label]
        if label:
            out.append((LABELS[label], zone.tokens[i][0], zone.tokens[at - 1][1]))
        at, label = i, previous
    return out[::-1]


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + log(sum(exp(v - top) for v in values))


#: for each token the candidates that end with it: first token, label, features
Ends = list[list[tuple[int, str, tuple[str, ...]]]]


def candidates(text: str) -> tuple[Zone, Ends]:
    ends: Ends = []
    zone = Zone(text, 0, len(text), [], lambda i, j, label, features: ends[j].append((i, label, features)))
    ends += [[] for _ in zone.tokens]
    for i in range(len(ends)):
        zone.start(i)
    return zone, ends


def gradient(ends: Ends, gold: list[Segment], weights: Weights) -> dict[str, float]:
    """Features of the true segmentation less those expected (forward and backward sums)."""
    n = len(ends)
    arcs: list[list[tuple[int, str, tuple[str, ...], str, float]]] = []
    forward: list[dict[str, float]] = [{"none": 0.0}]
    for j, ending in enumerate(ends):
        own, sums = [], {}
        for i, label, features in [(j, "none", ()), *ending]:
            for previous, total in forward[i].items():
                s = score(weights, features, label, previous)
                own.append((i, label, features, previous, s))
                sums.setdefault(label, []).append(total + s)
        arcs.append(own)
        forward.append({label: _log_sum(v) for label, v in sums.items()})
    backward: list[dict[str, list[float]]] = [{} for _ in range(n + 1)]
    backward[n] = {label: [0.0] for label in forward[n]}
    whole = _log_sum(list(forward[n].values()))
    wanted = {(i, j, label) for i, j, label in gold}
    inside = {k for i, j, _ in gold for k in range(i, j + 1)}
    out: dict[str, float] = {}
    labels = ["none"] * (n + 1)  # of the segment that ends before each token
    for _, j, label in gold:
        labels[j + 1] = label
    for j in reversed(range(n)):
        rest = {label: _log_sum(v) for label, v in backward[j + 1].items()}
        for i, label, features, previous, s in arcs[j]:
            if label not in rest:
                continue
            true = previous == labels[i] and ((i, j, label) in wanted if label != "none" else j not in inside)
            by = true - exp(forward[i][previous] + s + rest[label] - whole)
            if abs(by) > 1e-6:
                for f in (*features, f"{previous}>{label}"):
                    out[f] = out.get(f, 0.0) + by
            backward[i].setdefault(previous, []).append(s + rest[label])
    return out


def examples(n: int = 1200, seed: int = 5, held_out: bool = False) -> list[tuple[str, list[Span]]]:
    """Made-up lines with the spans that the field should find; held_out: other formats and words."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    two = lambda: r.choice("123456789") + num(1)
    word = lambda: "".join(r.choice(("th", "en", "ou", "re", "ion", "sch", "ad", "o", "le", "ti", "\u00e9", "\u00fc", "an")) for _ in range(r.randint(1, 4)))
    name = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9)))
    hexed = lambda k, w=4: ":".join(f"{r.randrange(16**w):x}" for _ in range(k))
    ends = lambda: r.choice(("com", "org", "net", "de", "fr", "es"))

    def card(good: bool = True) -> str:
        body = r.choice("45") + num(14)
        right = next(c for c in "0123456789" if luhn(body + c))
        return body + (right if good else str((int(right) + r.randint(1, 9)) % 10))

    fours = lambda c, s: s.join(c[k : k + 4] for k in range(0, 16, 4))
    cues = {
        False: {
            "phone": "phone tel call mobile fax Telefon Handy Nummer Rufnummer t\u00e9l\u00e9phone num\u00e9ro portable tel\u00e9fono m\u00f3vil n\u00famero",
            "card": "card visa credit Karte Kreditkarte carte bancaire tarjeta cr\u00e9dito",
            "ip": "ip host server Rechner serveur servidor",
            "email": "mail email contact Kontakt courriel correo",
            None: "version date Datum fecha order Bestellung commande pedido time page Seite invoice MAC token id price Preis prix precio room Zimmer GPS ticket",
        },
        True: {
            "phone": "telephone cell dial Durchwahl mobil appelez fixe llame celular",
            "card": "mastercard debit Kartennummer cb d\u00e9bito",
            "ip": "ipv6 gateway router Knoten passerelle nodo",
            "email": "write reach schreiben \u00e9crivez escriba",
            None: "isbn Rechnung facture factura serial lot Uhr heure hora p\u00e1gina Jahr a\u00f1o",
        },
    }[held_out]
    train = [
        ("phone", lambda: f"({num(3)}) {num(3)}-{num(4)}"),
        ("phone", lambda: f"{two()}{num(1)}-{num(3)}-{num(4)}"),
        ("phone", lambda: f"{two()}{num(1)}.{num(3)}.{num(4)}"),
        ("phone", lambda: f"0{two()} {num(7)}"),
        ("phone", lambda: f"0{two()}{num(1)}/{num(6)}"),
        ("phone", lambda: f"0{two()[0]} {num(2)} {num(2)} {num(2)} {num(2)}"),
        ("phone", lambda: f"{r.choice('69')}{num(2)} {num(3)} {num(3)}"),
        ("card", lambda: fours(card(), r.choice("./_"))),
        ("card", lambda: fours(card(), " - ")),
        ("ip", lambda: hexed(8)),
        ("ip", lambda: f"fe80::{hexed(r.randint(2, 4))}"),
        ("ip", lambda: f"2001:db8::{hexed(r.randint(1, 2))}"),
        ("email", lambda: f"{name()} {(b := r.choice(('()', '[]')))[0]}at{b[1]} {name()} {b[0]}dot{b[1]} {ends()}"),
        ("email", lambda: f"{name()}.{name()} at {name()} dot {ends()}"),
        ("email", lambda: f"{name()} [at] {name()}.{ends()}"),
        ("email", lambda: f"{name()} arroba {name()} punto {ends()}"),
        ("email", lambda: f"{name()} @ {name()}.{ends()}"),
        (None, lambda: f"20{num(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}"),
        (None, lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.20{num(2)}"),
        (None, lambda: f"{num(1)}.{num(1)}.{num(2)}"),
        (None, lambda: f"{two()[0]} {num(3)} {num(3)}"),
        (None, lambda: f"19{num(2)}-20{num(2)}"),
        (None, lambda: f"{two()}/{num(2)}/20{num(2)}"),
        (None, lambda: f"{num(4)}-{num(4)}"),
        (None, lambda: f"{two()}{num(1)} {num(2)} {num(4)} {num(1)}"),
        (None, lambda: fours(card(False), r.choice("./_ -"))),
        (None, lambda: f"{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}"),
        (None, lambda: ":".join(f"{r.randrange(256):02x}" for _ in range(6))),
        (None, lambda: f"{two()}.{num(3)},{num(2)} \u20ac"),
        (None, lambda: num(r.randint(6, 12))),
        (None, lambda: card(False)),
        (None, lambda: f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}"),
        (None, lambda: f"meet {name()} at {name()}.{name()}"),
        (None, lambda: f"{name()} at {name()}. {name()}"),
        (None, lambda: f"{name()} at the point of {name()}"),
        (None, lambda: f"std::{name()}"),
        (None, lambda: " ".join(num(r.randint(1, 3)) for _ in range(6))),
    ]
    #: told by the words around them alone, so one always stands ahead
    cued = [
        ("phone", lambda: f"{two()}{num(1)}-{num(4)}"),
        ("phone", lambda: f"1-{two()}{num(1)}-{num(3)}-{num(4)}"),
        ("phone", lambda: f"1 ({two()}{num(1)}) {num(3)}-{num(4)}"),
        ("email", lambda: f"{name()} dot {name()} at {name()} dot {ends()}"),
        (None, lambda: f"{two()}{num(1)}-{num(4)}"),
        (None, lambda: f"{two()}{num(1)} {num(3)} {num(4)}"),
        (None, lambda: f"{two()}{num(1)}-{num(3)}-{num(4)}"),
        (None, lambda: f"{two()}.{num(4)} -{two()}.{num(4)}"),
        (None, lambda: f"{two()}.{num(r.randint(3, 6))}, {two()[0]}.{num(r.randint(3, 6))}"),
        (None, lambda: f"-{two()}.{num(5)} {num(3)}.{num(5)}"),
    ]
    free = [
        ("phone", lambda: f"1-{two()}{num(1)}-{num(3)}-{num(4)}"),
        ("email", lambda: f"{name()} dot {name()} at {name()} dot {ends()}"),
        (None, lambda: f"{two()}{num(1)}-{num(4)}"),
        (None, lambda: f"{two()}.{num(4)} -{two()}.{num(4)}"),
        (None, lambda: f"{name()} at {r.choice(('the', 'a', 'this', 'der', 'la'))} dot {ends()}"),
        (None, lambda: f"{name()} at {r.choice(('the', 'a', 'that', 'die', 'les'))} {name()} dot {name()}"),
        (None, lambda: f"{name()} at {name()} dot by dot {name()}"),
    ]
    other = [
        ("phone", lambda: f"{two()}{num(1)} {num(3)}-{num(4)}"),
        ("phone", lambda: f"0{two()}{num(1)}-{num(7)}"),
        ("phone", lambda: f"0{two()[0]}.{num(2)}.{num(2)}.{num(2)}.{num(2)}"),
        ("phone", lambda: f"{r.choice('69')}{num(2)}-{num(3)}-{num(3)}"),
        ("phone", lambda: f"(0{two()}) {num(7)}"),
        ("card", lambda: fours(card(), " / ")),
        ("card", lambda: fours(card(), "\u00b7")),
        ("ip", lambda: f"fe80::{r.randrange(1, 65536):x}"),
        ("ip", lambda: f"2a02:{hexed(3)}::{hexed(2)}"),
        ("ip", lambda: f"ff02::{hexed(1, 1)}:{hexed(1, 1)}"),
        ("email", lambda: f"{name()} AT {name()} DOT {ends()}"),
        ("email", lambda: f"{name()} {{at}} {name()} {{dot}} {ends()}"),
        ("email", lambda: f"{name()} (\u00e4t) {name()} (punkt) {ends()}"),
        ("email", lambda: f"{name()}.{name()} arobase {name()} point {ends()}"),
        (None, lambda: f"{r.randint(1, 28)}/{r.randint(1, 12)}/{num(2)}"),
        (None, lambda: f"20{num(2)}.{r.randint(10, 12)}.{r.randint(10, 28)}"),
        (None, lambda: f"{r.randint(10, 23)}:{r.randint(10, 59)}"),
        (None, lambda: "-".join(f"{r.randrange(256):02X}" for _ in range(6))),
        (None, lambda: ":".join(f"{r.randrange(256):02X}" for _ in range(6))),
        (None, lambda: f"978 {num(1)} {num(4)} {num(4)} {num(1)}"),
        (None, lambda: f"{two()} {num(3)},{num(2)}"),
        (None, lambda: fours(card(False), " / ")),
        (None, lambda: f"{name()} at {name()} dotted {name()}"),
        (None, lambda: f"v{num(1)}.{two()}.{num(3)}"),
    ]
    make = other if held_out else [*train, *free, *cued]
    out = []
    for k in range(n):
        kind, value = make[k % len(make)]
        always = not held_out and k % len(make) >= len(train) + len(free)
        filler = [word() for _ in range(r.randint(0, 3))]
        cue = r.choice(cues[kind].split()) if always or r.random() < 0.7 else word()
        text = " ".join([*filler, cue]) + r.choice((" ", " ", ": "))
        made = value()
        if not base_spans(made):
            spans = [(kind, len(text), len(text) + len(made))] if kind else []
            out.append((f"{text}{made}{r.choice((' ', ' ', '. ', ', '))}{word()} {word()}", spans))
    return out


@lru_cache(1)
def trained(rounds: int = 8, rate: float = 0.3, decay: float = 0.003) -> Weights:
    weights: Weights = {}
    data = []
    for text, spans in examples():
        zone, ends = candidates(text)
        first, last = [a for a, _ in zone.tokens], [b for _, b in zone.tokens]
        gold = [(first.index(a), last.index(b), k) for k, a, b in spans]
        gold = [g for g in gold if any((i, label) == (g[0], g[2]) for i, label, _ in ends[g[1]])]
        if any(ends):
            data.append((ends, gold))
    for k in range(rounds):
        for ends, gold in data:
            for f, g in gradient(ends, gold, weights).items():
                old = weights.get(f, 0.0)
                weights[f] = old + rate / (1 + k / 3) * (g - decay * old)
    return weights


def before(text: str, at: int) -> int:
    """Where the LONGEST-th whole token ahead of a place begins."""
    size = AROUND
    while True:
        begin = max(0, at - size)
        starts = [m.start() for m in TOKEN.finditer(text, begin, at)]
        if not begin and len(starts) <= LONGEST:
            return 0
        if len(starts) > LONGEST:  # the first one may be cut
            return starts[-LONGEST]
        size *= 2


def after(text: str, at: int) -> int:
    """Where the LONGEST-th whole token from a place on ends."""
    size = AROUND
    while True:
        end = min(len(text), at + size)
        ends = [m.end() for m in TOKEN.finditer(text, at, end)]
        if end == len(text) and len(ends) <= LONGEST:
            return end
        if len(ends) > LONGEST:  # the last one may be cut
            return ends[LONGEST - 1]
        size *= 2


def zones(text: str) -> Iterator[tuple[int, int]]:
    """Neighbourhoods of the triggers, those that meet as one: no candidate reaches out of them.

    A spoken "at" counts where a spoken dot is among the tokens of its candidates.
    """
    begin = end = last = -1
    for m in TRIGGER.finditer(text):
        if m["said"] and not any(t.lower() in DOT for t in TOKEN.findall(text, m.end(), after(text, m.end()))):
            continue
        if end >= 0 and m.start() - last > AROUND // 4:  # nearer ones lie within one zone in any case
            end = max(end, after(text, last))
            if before(text, m.start()) > end:
                yield begin, end
                end = -1
        if end < 0:
            begin = before(text, m.start())
        last = m.end()
        end = max(end, last)
    if end >= 0:
        yield begin, max(end, after(text, last))


def added_spans(text: str, base: list[Span], weights: Weights) -> list[Span]:
    """The field's spans, none of which touches a base span."""
    out: list[Span] = []
    taken = sorted((a, b) for _, a, b in base)
    for begin, end in zones(text):
        out += decode(text, begin, end, taken, weights)
    return out


def all_spans(text: str | None, weights: Weights) -> tuple[list[Span], list[Span]]:
    """Base spans, and all of them with those added, both by kind and start."""
    if not text:
        return [], []
    base = base_spans(text)
    both = base + added_spans(text, base, weights)
    return base, sorted(both, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


SPAN = "array<struct<kind: string, start: bigint, `end`: bigint, base: boolean>>"


def find(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with spans: kind, start, end, and whether a base pattern found it."""
    weights = trained()

    @F.pandas_udf(SPAN)
    def run(texts: pd.Series) -> pd.Series:
        def own(text: str | None) -> list[dict]:
            base, both = all_spans(text, weights)
            known = set(base)
            return [{"kind": k, "start": a, "end": b, "base": (k, a, b) in known} for k, a, b in both]

        return texts.map(own)

    return df.withColumn("spans", run(text_col))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with each span of its text replaced by its kind in brackets; overlapping ones as one."""
    weights = trained()

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def own(text: str | None) -> str | None:
            if text is None:
                return None
            out, end = [], 0
            for kind, a, b in sorted(all_spans(text, weights)[1], key=lambda s: (s[1], -s[2])):
                if a >= end:
                    out += [text[end:a], f"[{kind.upper()}]"]
                end = max(end, b)
            return "".join([*out, text[end:]])

        return texts.map(own)

    return df.withColumn(text_col, run(text_col))
