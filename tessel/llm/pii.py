"""Personal information inside free text (problem 3), by weak supervision.

1. Broad patterns propose candidate spans of each kind, decoys included.
2. Labelers vote on each candidate: its form, a gazetteer of people, a few words that name the kind, and the words around
   it; any may abstain. Which words speak for or against a kind isn't given but learned: expectation-maximisation over
   the votes of the other labelers says how probable each candidate is, and the words next to probable and improbable
   candidates, counted over all of them, vote from then on.
3. A second expectation-maximisation over the counts of all vote patterns estimates how reliable each labeler is and gives
   each pattern the probability of being right.
4. A span classifier over votes, context words, shapes and name parts is trained on these probabilities and decides.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.plans.shared import materialize

KINDS = ("email", "phone", "id_number", "address", "name")
DIMS = 1 << 15
#: Most candidates the classifier is fitted on (the ones with the least hashes); everything else covers all rows.
FIT_ROWS = 40_000
#: How often a street name must be seen to be learned, and the most names there may be: each task gets their 8-byte
#: hashes. More raise.
LEAST_SEEN, MOST_STREETS = 2, 4_000_000
#: Context words are counted in so many places (by hash), whatever the number of words; those seen less often abstain.
CONTEXT_SLOTS, LEAST_CONTEXT = 1 << 16, 5
#: A context word votes if it shifts the log-odds of a candidate by so much.
_LEAN = 0.7
#: Most people a gazetteer may hold, since each task gets the whole of it.
MOST_PEOPLE = 200_000

_S = "[ .\\-/   ‐-―]"
_SP = "[    ]"
_DOT = r"(?:\.|\s?\(dot\)\s?|\s?\[dot\]\s?|\s+dot\s+)"
_WORD = r"[^\W\d_]+(?:[̀-ͯ][^\W\d_]*)*"


def _p(x: str, flags: int = re.I) -> re.Pattern:
    return re.compile(x, flags)


EMAIL = _p(rf"(?<![\w.+%-])\w[\w+-]*(?:{_DOT}\w[\w+-]*)*?(?P<at>\s?(?:@|＠|%40|\[at\]|\(at\))\s?|\s+at\s+)[a-z0-9][\w-]*(?P<dots>(?:{_DOT}[\w-]*\w)+)")
PHONE = _p(
    rf"(?<![\w+.@/])(?<!\d[-])(?:\+1{_S}?\(?\d{{3}}\)?{_S}?\d{{3}}{_S}?\d{{4}}"
    rf"|(?:\+|00)49{_S}?(?:\(0\){_S}?)?\d{{2}}{_S}?\d{{5}}{_S}?\d{{3}}|(?:\+|00)44{_S}?(?:\(0\){_S}?)?\d{{4}}{_S}?\d{{3}}{_S}?\d{{3}}|(?:\+|00)33{_S}?(?:\(0\){_S}?)?\d(?:{_S}?\d\d){{4}}"
    rf"|(?:\+|00){_S}?[2-9]\d{{0,2}}{_S}?(?:\(0\){_S}?)?\d{{1,5}}(?:{_S}?\d{{2,8}}){{1,4}}"
    rf"|\(\d{{3}}\){_S}?\d{{3}}{_S}\d{{4}}|\d{{3}}({_S})\d{{3}}\1\d{{4}}|\d{{10}}"
    rf"|\(?0\d{{4}}\)?{_S}\d{{3}}{_S}?\d{{3}}|0\d{{2}}{_S}\d{{5}}{_S}?\d{{3}}|0\d(?:{_S}\d\d){{4}})(?![\w]|[-.]\d)"
)
ID = _p(
    rf"(?<![\w+.@/-])(?:\d{{3}}({_S})\d{{2}}\1\d{{3,4}}|[a-z]{{2}}{_SP}?\d\d{_SP}?\d\d{_SP}?\d\d{_SP}?[a-d]"
    rf"|[12]{_SP}?\d\d{_SP}?\d\d{_SP}?\d\d{_SP}?\d{{3}}{_SP}?\d{{3}}(?:{_SP}?\d\d)?|\d{{2}}{_SP}\d{{3}}{_SP}\d{{3}}{_SP}\d{{3}}"
    rf"|\d{{8}}-?[a-z]|[xyz]\d{{7}}[a-z]|[a-z]\d{{7,8}})(?![\w]|[-.]\d)"
)
_NO = r"\d{1,5}"
_ENGLISH = r"street|road|avenue|lane|drive|court|boulevard|way|terrace|close|crescent|square|place|row|walk|gardens|hill|grove|mews|(?:st|rd|ave|ln|dr|ct|blvd|pl|sq|ter|cres)\b\.?"
_GERMAN = r"(?:stra(?:ß|ss)e|str\.|weg|gasse|platz|allee|ring|damm|ufer|steig|pfad)"
# by where they begin: at a house number, or at a street's name, which is looked for only where its word stands
_DIGIT = re.compile(r"\d")
_LONG = re.compile(r"\d(?:\D{0,4}\d){5}")  # no shorter number is looked at
_NUMBER = re.compile(r"(?<![\w.#/-])\d")
#: What a word must be, or for the last two hold, for a pattern to be tried on its text.
_NAME, _STREET, _STREET_DE, _STREET_ES, _AT = 1, 2, 4, 8, 16
_STREETS = frozenset(_ENGLISH.replace("(?:", "").replace(r")\b\.?", "").split("|")) | frozenset("rue impasse quai chemin allée allee cours passage route".split())
_PARTS = {
    _STREET_DE: ("stra", "str.", "weg", "gasse", "platz", "allee", "ring", "damm", "ufer", "steig", "pfad"),
    _STREET_ES: ("calle", "c/", "avenida", "avda", "av.", "plaza", "pza", "paseo", "camino", "ronda"),
    _AT: ("@", "＠", "%40", "[at]", "(at)"),
}
ADDRESSES = (
    (
        _STREET,
        _p(
            rf"(?<![\w.#/-])(?:(?P<fr>{_NO}(?:{_SP}?(?:bis|ter)\b|[a-f]\b)?,?{_SP}+(?:rue|avenue|boulevard|impasse|quai|chemin|all[ée]e|place|cours|passage|square|route)\b{_SP}+(?:de{_SP}la{_SP}+|de{_SP}l['’]|du{_SP}+|des{_SP}+|de{_SP}+|d['’])?{_WORD}(?:{_SP}{_WORD})?)"
            rf"|(?P<en>{_NO}(?:{_SP}?[a-f]\b)?{_SP}+(?!bis\b|ter\b)(?:(?:north|south|east|west|old|new)\s)?(?:[^\W\d_][\w'’-]{{2,}}{_SP}+){{1,2}}(?:{_ENGLISH})(?![\w-])))"
        ),
    ),
    (
        _STREET_DE,
        _p(rf"(?<![\w.#/-])(?P<de>(?:[^\W\d_]+{_SP})?[^\W\d_][\w-]*{_GERMAN}{_SP}+{_NO}(?:{_SP}?[a-f]\b)?(?!\w))")),
    (
        _STREET_ES,
        _p(rf"(?<![\w.#/-])(?P<es>(?:calle|c/|avenida|avda\.?|av\.|plaza|pza\.?|paseo|camino|ronda){_SP}*(?:de{_SP}(?:la|los|las|el){_SP}+|del{_SP}+|de{_SP}+)?{_WORD}(?:{_SP}{_WORD}){{0,2}},?{_SP}+{_NO}(?:{_SP}?[a-f]\b)?(?!\w))")),
)
_FRENCH_STREET = r"\d{1,5}(?: ?(?:bis|ter)\b|[a-f]\b)?,? +(?:rue|avenue|boulevard|impasse|quai|chemin|all[ée]e|place|cours|passage|square|route) +((?:de la |de l['’]|du |des |de |d['’])?\p{L}+(?: \p{L}+)?)(?=,|;|\"| \(|  |\s*\n|\s*$)"
_PARTICLES = "van|von|de|der|den|di|da|del|della|la|le|du|dos|bin|ben|al|el|af|zu|ter|ten"
_TOKEN = _p(rf"{_WORD}(?:[-'’]{_WORD})*")

#: Words that name a kind, in English, German, French and Spanish; of names the titles. Nothing here is about the texts
#: at hand: what else speaks for or against a candidate is learned from them.
LABELS = {
    "email": "email mail mailto correo courriel",
    "phone": "phone telephone tel telefon téléphone teléfono fax mobile móvil handy cell whatsapp sms",
    "id_number": "ssn social insurance passport reisepass passeport pasaporte tax steuer dni nie nino insee identity ausweis",
    "address": "address adresse anschrift dirección",
    "name": "mr mrs ms miss dr prof herr frau mme mlle sr sra señor señora",
}
_LABELS = {k: frozenset(v.split()) for k, v in LABELS.items()}
_COMMON = frozenset("the a an and or for of to in on at is was are be this that it you your my me i we with from by as not no please done thanks noted here context remind show what why how can could will would if le la les un une des du de et el los las una y der die das und ist ein eine".split())


def _fold(word: str) -> str:
    return unicodedata.normalize("NFC", word).casefold()


class Gazetteer:
    """Given and family names of known people, and the parts such names are made of."""

    def __init__(self, given: Iterable[str], family: Iterable[str], company: Iterable[str] = ()) -> None:
        self.given, self.family = self._names(given), self._names(family)
        self.parts = {"g": self._split(self.given), "f": self._split(self.family)}
        last = Counter(_fold(c.split()[-1]) for c in company if c and len(c.split()) > 1)
        self.trades = frozenset(w for w in last if w not in self.given | self.family)

    @staticmethod
    def _names(values: Iterable[str]) -> frozenset[str]:
        return frozenset(_fold(w) for v in values if v for w in _TOKEN.findall(v) if len(w) > 1)

    @staticmethod
    def _split(names: frozenset[str]) -> tuple[frozenset[str], frozenset[str]]:
        """Beginnings shared by two names and ends shared by three."""
        heads = Counter(n[:i] for n in names for i in range(2, len(n) - 1))
        tails = Counter(n[i:] for n in names for i in range(2, len(n) - 1))
        return frozenset(h for h, k in heads.items() if k > 1), frozenset(t for t, k in tails.items() if k > 2)

    def grade(self, word: str, role: str) -> int:
        """2: a known name; 1: made of parts of known names; 0: neither. Of a hyphenated name the least part counts."""
        known, (heads, tails) = (self.given if role == "g" else self.family), self.parts[role]
        grades = []
        for w in re.split(r"[-'’]", _fold(word)):
            if w in known:
                grades.append(2)
            else:
                grades.append(int(any(w[:i] in heads and w[i:] in tails for i in range(2, len(w) - 1))))
        return min(grades)


@dataclass
class Candidate:
    kind: int
    start: int
    end: int
    votes: tuple[int, ...]
    context: list[int]  # places of the two words on the left (together and the nearer one) and on the right
    features: list[int]


class _Hints(dict):
    """Which patterns a word (lower case, between white space) gives reason to try, remembered."""

    def __init__(self, roles) -> None:
        self.roles = roles

    def __missing__(self, chunk: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        hint = 0
        for w in _TOKEN.findall(chunk):
            if w in _LABELS["name"] or len(w) > 2 and max(self.roles(w)) > 0:
                hint |= _NAME
            if w in _STREETS:
                hint |= _STREET
        for bit, parts in _PARTS.items():
            if any(p in chunk for p in parts):
                hint |= bit
        self[chunk] = hint
        return hint


class Streets:
    """Names of streets as sorted hashes."""

    def __init__(self, hashes: np.ndarray = np.zeros(0, np.int64)) -> None:
        self.hashes = hashes

    def __contains__(self, name: str) -> bool:
        h = street_hash(name)
        i = int(np.searchsorted(self.hashes, h))
        return i < len(self.hashes) and int(self.hashes[i]) == h


def street_hash(name: str) -> int:
    return int.from_bytes(blake2b(_fold(name).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Proposer:
    """Candidates of a text with the votes of form, gazetteer and labels, their context and features."""

    def __init__(self, gazetteer: Gazetteer, streets: Streets | None = None) -> None:
        self.gazetteer, self.streets = gazetteer, streets or Streets()
        self.roles = lru_cache(1 << 17)(lambda w: (gazetteer.grade(w, "g"), gazetteer.grade(w, "f")))
        self.hints = _Hints(self.roles)

    def __call__(self, text: str | None) -> list[Candidate]:
        if not text:
            return []
        out: list[Candidate] = []
        low = text.lower()
        hints = 0
        for h in set(map(self.hints.__getitem__, low.split())):
            hints |= h
        if hints & _AT or "dot" in low and "at" in low:
            self._emails(text, out)
        if _DIGIT.search(text):
            if _LONG.search(text):
                for m in PHONE.finditer(text):
                    self._phone(text, m, out)
                for m in ID.finditer(text):
                    self._id(text, m, out)
            for m in self._addresses(text, hints):
                self._address(text, m, out)
        if hints & _NAME:
            self._names(text, out)
        return out

    def _add(self, out: list[Candidate], text: str, kind: str, a: int, b: int, votes: list[int], extra: list[str]) -> None:
        before, after = text[max(0, a - 40) : a], text[b : b + 30]
        left, right = _TOKEN.findall(before.lower())[-3:], _TOKEN.findall(after.lower())[:2]
        votes.append(1 if not _LABELS[kind].isdisjoint(left) else 0)
        span = text[a:b]
        context = [f"l{left[-1] if left else ''}", f"ll{' '.join(left[-2:])}", f"r{right[0] if right else ''}", f"rr{' '.join(right)}"]
        names = [f"v{i}{v}" for i, v in enumerate(votes)] + context + [f"p{before[-1:]}", f"n{after[:1]}"]
        names += ["s" + re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"\d", "9", span)))[:24], *extra, "bias"]
        place = lambda n, size: crc32(f"{kind} {n}".encode("utf-8", "surrogatepass")) % size
        out.append(Candidate(KINDS.index(kind), a, b, tuple(votes), [place(n, CONTEXT_SLOTS) for n in context], [place(n, DIMS) for n in names]))

    def _emails(self, text: str, out: list[Candidate]) -> None:
        for m in EMAIL.finditer(text):
            bare, dots = m["at"].strip().lower() == "at", m["dots"].lower()
            if bare and "dot" not in dots:
                continue
            top = re.split(r"[.\s)\]]", m[0])[-1]
            known = any(max(self.roles(w)) for w in _TOKEN.findall(m[0][: m.start("at") - m.start()]))
            votes = [1 if top.isalpha() and len(top) > 1 else -1, -1 if re.search(r"\.\d", dots) else 0, 1 if known else 0]
            self._add(out, text, "email", *m.span(), votes, ["t" + top.lower()])

    def _phone(self, text: str, m: re.Match, out: list[Candidate]) -> None:
        s = m[0]
        n = sum(c.isdigit() for c in s)
        if not 9 <= n <= 15:
            return
        plain, digits = s.isdigit(), re.sub(r"\D", "", s)
        # a number of the North American plan begins neither its area nor its exchange with 0 or 1
        american = len(digits) == 10 and digits[0] in "23456789" and digits[3] in "23456789"
        moment = plain and n == 10 and s[0] == "1"  # as well a count of seconds since 1970
        votes = [1 if s[0] in "+(" or s.startswith("0") else 0, 0 if plain else 1, 1 if american else -1 if moment else 0]
        self._add(out, text, "phone", *m.span(), votes, [f"d{n}", f"i{s[:2]}"])

    def _id(self, text: str, m: re.Match, out: list[Candidate]) -> None:
        s = m[0]
        shape = re.sub(r"[^\W\d]", "A", re.sub(r"\d", "9", re.sub(_S, "-", s)))
        digits = re.sub(r"\D", "", s)
        form = 0
        if shape == "999-99-9999":
            form = -1 if digits[:3] == "000" or digits[3:5] == "00" or digits[5:] == "0000" else 1
        elif shape.startswith("AA") or len(digits) >= 13 or shape == "99-999-999-999":
            form = 1
        elif re.fullmatch(r"9{8}-?A|[XYZ]9{7}[A-Z]", re.sub("^[xyz]", lambda x: x[0].upper(), shape if shape[0] == "9" else s[0] + shape[1:])) or re.fullmatch("A9{8}", shape):
            form = 1  # Spanish identity numbers; passports of a letter and eight digits
        elif shape == "999-99-999":
            form = -1
        control = bool(re.fullmatch(r"9{8}-?A", shape)) and "TRWAGMYFPDXBNJZSQVHLCKE"[int(digits) % 23] == s[-1].upper()
        self._add(out, text, "id_number", *m.span(), [form, 1 if len(digits) >= 9 and form >= 0 or control else 0], [f"f{shape}", f"i{s[:1].upper()}"])

    def _addresses(self, text: str, hints: int) -> Iterator[re.Match]:
        (by_number, numbered), *named = ADDRESSES
        done = 0
        for n in _NUMBER.finditer(text) if hints & by_number else ():
            if n.start() >= done and (m := numbered.match(text, n.start())):
                done = m.end()
                yield m
        for hint, pattern in named:
            if hints & hint:
                yield from pattern.finditer(text)

    def _address(self, text: str, m: re.Match, out: list[Candidate]) -> None:
        a, b, form = m.start(), m.end(), m.lastgroup
        if form == "fr":
            b = a + len(self._french(m[0], text[b : b + 2]))
        elif form == "de":  # a word before the street belongs to it only where it is a known beginning
            head, _, rest = m[0].partition(" ")
            if re.match(rf"[^\W\d_][\w-]*{_GERMAN}\s", rest, re.I) and _fold(head) not in ("am", "an", "alte", "neue", "große", "kleine", "obere", "untere", "zur", "zum"):
                a += len(head) + 1
        span = text[a:b]
        words = [w for w in _TOKEN.findall(span) if len(w) > 1]
        caps = sum(w[0].isupper() for w in words)
        votes = [1 if caps == len(words) or form in ("de", "es") else 0, -1 if caps == 0 and any(_fold(w) in _COMMON for w in words[:1]) else 0, 1 if form in ("fr", "de", "es") else 0]
        self._add(out, text, "address", a, b, votes, [f"f{form}", *[f"w{_fold(w)}" for w in words[:3]]])

    def _french(self, s: str, after: str) -> str:
        """Without the last word unless it belongs to the street: known with it, or ended by punctuation in same case."""
        short, _, last = s.rpartition(" ")
        street = re.sub(rf"^{_NO}(?:\s?(?:bis|ter)\b|[a-f]\b)?,?\s+\w+\s+", "", s, flags=re.I)
        words = street.split()
        lone = len(words) == 1 or _fold(words[0]) in ("de", "du", "des", "d'") and len(words) == 2 or [_fold(w) for w in words[:2]] == ["de", "la"] and len(words) == 3
        if lone:
            return s
        if street in self.streets:
            return s
        if street.rpartition(" ")[0] in self.streets:
            return short
        return s if last[:1].isupper() and (not after.strip() or after[:1] in ",;\n\"(") or after[:2] == " (" and last[:1].isupper() else short

    def _names(self, text: str, out: list[Candidate]) -> None:
        roles = self.roles
        tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]
        graded = [(0, 0) if len(t[2]) < 3 else roles(t[2]) for t in tokens]
        i = 0
        while i < len(tokens) - 1:
            used = 1
            if max(graded[i]) or tokens[i][2][0].isupper() and i and tokens[i - 1][2].lower() in _LABELS["name"]:
                used = self._name_at(text, tokens, graded, i, out)
            i += used

    def _name_at(self, text, tokens, graded, i, out) -> int:
        a, e, first = tokens[i]
        j = i + 1
        comma = False
        if text[e : tokens[j][0]] == ", ":
            comma = True
        elif text[e : tokens[j][0]] not in (" ", " "):
            return 1
        middle = 0
        while not comma and middle < 2 and j + 1 < len(tokens):
            w, gap = tokens[j][2], text[tokens[j][1] : tokens[j + 1][0]]
            if len(w) == 1 and gap in (". ", " ") or re.fullmatch(_PARTICLES, w, re.I) and gap == " ":
                j += 1
                middle += 1
            else:
                break
        b, last = tokens[j][1], tokens[j][2]
        if len(first) < 2 or len(last) < 2:
            return 1
        g1, f1 = graded[i]
        g2, f2 = graded[j]
        if comma:
            given, family = g2, f1
        else:
            given, family = max((g1, f2), (g2, f1), key=lambda x: (min(x), sum(x)))
        if comma and not (given and family):
            return 1
        if not (given or family):
            if comma or not i or tokens[i - 1][2].lower() not in _LABELS["name"] or text[tokens[i - 1][1] : a] not in (" ", ". ") or not (first[0].isupper() and last[0].isupper()) or _fold(last) in _COMMON:
                return 1
        trade = _fold(last) in self.gazetteer.trades or j + 1 < len(tokens) and text[b : tokens[j + 1][0]] == " " and _fold(tokens[j + 1][2]) in self.gazetteer.trades
        votes = [1 if given == 2 and family == 2 else 0, 1 if given and family else -1, 1 if given == 2 or family == 2 else 0, -1 if trade else 0, -1 if _fold(first) in _COMMON or _fold(last) in _COMMON else 0]
        x, y = _fold(first), _fold(last)
        extra = [f"g{given}", f"f{family}", f"gf{given}{family}", f"m{middle}", f"c{comma}", f"a{x[:3]}", f"b{x[-3:]}", f"c{y[:3]}", f"d{y[-3:]}", f"case{first[0].isupper()}{last[0].isupper()}"]
        self._add(out, text, "name", a, b, votes, extra)
        return j - i + 1 if given and family else 1


def reliabilities(patterns: Counter, rounds: int = 60) -> dict[tuple[int, ...], float]:
    """Probability that a vote pattern belongs to a right candidate, by expectation-maximisation.

    ``patterns``: how often each tuple of votes (-1, 0 = abstains, 1) occurs. Each labeler has a distribution of its
    votes for right and for wrong candidates, given which labelers are independent; a prior of a few votes keeps the
    classes from changing places and labelers that hardly vote near indifference.
    """
    keys = sorted(patterns)
    if not keys:
        return {}
    votes, count = np.array(keys), np.array([patterns[k] for k in keys], float)
    onehot = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)  # pattern, labeler, vote
    right = 1 / (1 + np.exp(-1.5 * votes.sum(1)))
    weight = max(1.0, 0.02 * count.sum())
    for _ in range(rounds):
        prior = (count @ right + 1) / (count.sum() + 2)
        table = []
        for w, lean in ((right, (0.1, 0.45, 0.45)), (1 - right, (0.45, 0.45, 0.1))):
            t = np.einsum("p,plv->lv", count * w, onehot) + weight * np.array(lean)
            table.append(np.log(t / t.sum(1, keepdims=True)))
        score = np.log(prior) - np.log(1 - prior) + np.einsum("plv,lv->p", onehot, table[0] - table[1])
        right = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return dict(zip(keys, right.tolist()))


def fit(rows: list[list[int]], target: np.ndarray, *, steps: int = 300, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression on hashed features with probabilities as targets."""
    w = np.zeros(DIMS)
    if not rows:
        return w
    width = max(map(len, rows))
    at = np.zeros((len(rows), width), np.int64)
    on = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        at[i, : len(r)] = r
        on[i, : len(r)] = 1
    m, v = np.zeros(DIMS), np.zeros(DIMS)
    for k in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip((w[at] * on).sum(1), -30, 30)))
        g = np.bincount(at.ravel(), ((p - target)[:, None] * on).ravel(), DIMS) / len(rows) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def chosen(candidates: Iterable[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Kind, start and end of the candidates to keep: probable ones, where they overlap the more probable, then longer."""
    out: list[tuple[int, int, int]] = []
    for k, a, b, p in sorted(candidates, key=lambda c: (-round(c[3], 1), c[1] - c[2], c[1], c[0])):
        if p >= 0.5 and all(b <= x or a >= y for _, x, y in out):
            out.append((k, a, b))
    return sorted(out, key=lambda c: c[1])


_ONE = "struct<kind:int,start:int,end:int,span:string,votes:string,context:array<int>,features:array<int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("span", pa.string()), ("votes", pa.string()), ("context", pa.list_(pa.int32())), ("features", pa.list_(pa.int32()))]))


def context_votes(leans: np.ndarray, context: np.ndarray) -> np.ndarray:
    """What the words on the left and on the right of each candidate say, of the nearer word and of both the one that leans
    more: two votes for each row of places."""
    lean = leans[np.asarray(context, np.int64).reshape(-1, 4)].reshape(-1, 2, 2)
    more = np.where(np.abs(lean[:, :, 0]) > np.abs(lean[:, :, 1]), lean[:, :, 0], lean[:, :, 1])
    return (more > _LEAN).astype(np.int64) - (more < -_LEAN)


def leaning(count: np.ndarray, mass: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """By how much the log-odds of candidates at each place differ from those of their kind (``prior``)."""
    logit = lambda p: np.log(p) - np.log1p(-p)
    prior = np.clip(prior, 1e-3, 1 - 1e-3)
    here = np.clip((mass + 2 * prior) / (count + 2), 1e-3, 1 - 1e-3)
    return np.where(count >= LEAST_CONTEXT, logit(here) - logit(prior), 0.0)


class PersonalInformation:
    """Finds and replaces personal information in a text column.

    What reaches the driver is bounded whatever the number of rows: vote patterns (3 to the number of labelers a kind), the
    counts of ``CONTEXT_SLOTS`` places, ``fit_rows`` candidates, hashes of street names (more than ``MOST_STREETS``
    raise) and the gazetteer (more than ``MOST_PEOPLE`` raise).

    Defined cases: null and empty texts hold none and come out unchanged; a text of any length is read whole; repeated
    rows are handled alike; the gazetteer may be empty or hold nulls; other columns are ignored.
    """

    def __init__(self, messages: DataFrame, people: DataFrame, key: str = "id", text: str = "content", *, fit_rows: int = FIT_ROWS) -> None:
        self.rows = messages.select(F.col(key).alias("key"), F.col(text).alias("text"))
        self.kind = self.rows.schema["key"].dataType.simpleString()
        known = people.select("first_name", "last_name", "company").distinct().limit(MOST_PEOPLE + 1).collect()
        if len(known) > MOST_PEOPLE:
            raise ValueError(f"a gazetteer of more than {MOST_PEOPLE} people")
        self.gazetteer = Gazetteer(*([r[i] for r in known] for i in range(3)))
        self.streets = self._streets()
        self.candidates = materialize(self.rows.mapInArrow(self._propose(), f"key {self.kind}, found array<{_ONE}>"), "candidates")
        self.leans = self._learn_context()
        self.weights = self._train(fit_rows)

    def _streets(self) -> Streets:
        """Street names whose end the punctuation shows, where such a name may have one word or two."""
        names = F.regexp_extract_all(F.lower("text"), F.lit("(?i)" + _FRENCH_STREET), F.lit(1))
        seen = self.rows.select(F.explode(names).alias("n")).groupBy("n").count().filter(F.col("count") >= LEAST_SEEN)
        seen = materialize(seen, "streets")
        # a word that now and then follows a frequent name isn't part of it
        short = seen.select(F.col("n").alias("_s"), F.col("count").alias("_more"))
        kept = seen.join(short, F.regexp_replace("n", " [^ ]*$", "") == F.col("_s"), "left").filter((F.col("n") == F.col("_s")) | F.col("_more").isNull() | (F.col("_more") < F.col("count"))).select("n")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([street_hash(n) for n in b.column(0).to_pylist()], pa.int64())], names=["h"])

        found = kept.mapInArrow(run, "h long").limit(MOST_STREETS + 1).toArrow()["h"].to_numpy()
        if len(found) > MOST_STREETS:
            raise ValueError(f"more than {MOST_STREETS} street names")
        return Streets(np.unique(found))

    def _propose(self):
        gazetteer, streets = self.gazetteer, self.streets

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Proposer(gazetteer, streets)
            for b in batches:
                at, found = [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    if c := own(t):
                        at.append(i)
                        found.append([{"kind": x.kind, "start": x.start, "end": x.end, "span": t[x.start : x.end], "votes": " ".join(map(str, x.votes)), "context": x.context, "features": x.features} for x in c])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(found, _ARROW)], names=["key", "found"])

        return run

    def _learn_context(self) -> np.ndarray:
        """How much the words at each place lean, from all candidates and what the other labelers say of them."""
        c = self.candidates.select(F.explode("found").alias("c"))
        counts = [(r.kind, r.votes, r["count"]) for r in c.groupBy("c.kind", "c.votes").count().collect()]
        right = estimated(counts)
        prior = {k: sum(right[a, v] * n for a, v, n in counts if a == k) / max(1, sum(n for a, _, n in counts if a == k)) for k in range(len(KINDS))}
        count, mass, base = np.zeros(CONTEXT_SLOTS), np.zeros(CONTEXT_SLOTS), np.full(CONTEXT_SLOTS, 0.5)
        if right:
            table = F.create_map(*[x for (k, v), p in right.items() for x in (F.lit(f"{k} {v}"), F.lit(float(p)))])
            places = c.select("c.kind", F.element_at(table, F.concat_ws(" ", "c.kind", "c.votes")).alias("p"), F.explode("c.context").alias("at"))
            for r in places.groupBy("at").agg(F.count("*").alias("n"), F.sum("p").alias("m"), F.min("kind").alias("kind")).toArrow().to_pylist():
                count[r["at"]], mass[r["at"]], base[r["at"]] = r["n"], r["m"], prior[r["kind"]]
        return leaning(count, mass, base)

    def _train(self, fit_rows: int) -> np.ndarray:
        c = self.candidates.select("key", F.explode("found").alias("c")).select("key", "c.kind", "c.start", "c.votes", "c.context", "c.features")
        leans = self.leans

        def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for b in batches:
                around = context_votes(leans, b.column(2).flatten().to_numpy())
                total.update(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), *around.T.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, *_ in total], pa.int32()), pa.array([f"{v} {x} {y}" for _, v, x, y in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["kind", "votes", "n"])

        counts = c.select("kind", "votes", "context").mapInArrow(patterns, "kind int, votes string, n long").groupBy("kind", "votes").agg(F.sum("n")).collect()
        self.reliability = right = estimated(counts)
        sample = c.orderBy(F.xxhash64("key", "start", "kind"), "key", "start", "kind").limit(fit_rows).select("kind", "votes", "context", "features").collect()
        votes = context_votes(leans, [r.context for r in sample]).tolist()
        return fit([[*r.features, *_voted(r.kind, v)] for r, v in zip(sample, votes)], np.array([right[r.kind, f"{r.votes} {x} {y}"] for r, (x, y) in zip(sample, votes)]))

    def spans(self) -> DataFrame:
        """``key, kind, start, end, span`` of everything found; ``start`` counts from 0."""
        w, leans = self.weights, self.leans

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["key", "kind", "start", "end", "span"]
            for b in batches:
                cs, rows = b.column(1).flatten(), pc.list_parent_indices(b.column(1)).to_numpy()
                kind, start, end = (cs.field(i).to_numpy() for i in range(3))
                p = probabilities(w, leans, kind, cs.field(5).flatten().to_numpy(), cs.field(6))
                kept: list[int] = []
                for i, j in itertools.pairwise(np.flatnonzero(np.diff(rows, prepend=-1, append=-1)).tolist()):
                    if j - i > 1:
                        where = {(k, x, y): n for n, k, x, y in zip(range(i, j), *(c[i:j].tolist() for c in (kind, start, end)))}
                        kept += [where[c] for c in chosen((*c, q) for c, q in zip(where, p[i:j].tolist()))]
                    elif p[i] >= 0.5:
                        kept.append(i)
                at = pa.array(kept, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[kept], pa.int64())), pa.array(KINDS).take(cs.field(0).take(at)), *(cs.field(i).take(at) for i in (1, 2, 3))], names=names)

        return self.candidates.mapInArrow(run, f"key {self.kind}, kind string, start int, end int, span string")

    def found(self) -> DataFrame:
        """Distinct ``key, kind, span``."""
        return self.spans().select("key", "kind", "span").distinct()

    def redacted(self) -> DataFrame:
        """``key, text`` with ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]`` and ``[NAME]`` for what was found; one row per input row."""
        w, leans, gazetteer, streets = self.weights, self.leans, self.gazetteer, self.streets

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Proposer(gazetteer, streets)
            for b in batches:
                out = []
                for t in b.column(1).to_pylist():
                    for k, s, e in reversed(judged(w, leans, own(t))):
                        t = f"{t[:s]}[{KINDS[k].upper()}]{t[e:]}"
                    out.append(t)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["key", "text"])

        return self.rows.mapInArrow(run, f"key {self.kind}, text string")


def estimated(counts: Iterable[tuple[int, str, int]]) -> dict[tuple[int, str], float]:
    """``reliabilities`` of each kind, from ``kind, votes, count``."""
    by: dict[int, Counter] = {}
    for kind, votes, n in counts:
        by.setdefault(kind, Counter())[tuple(map(int, votes.split()))] += n
    return {(k, " ".join(map(str, v))): x for k, p in by.items() for v, x in reliabilities(p).items()}


def _voted(kind: int, votes: Sequence[int]) -> list[int]:
    return [crc32(f"{KINDS[kind]} c{i}{v}".encode()) % DIMS for i, v in enumerate(votes)]


#: Places of the context votes by kind, side and vote.
_SIDES = np.array([[[_voted(k, (v, v))[i] for v in (-1, 0, 1)] for i in (0, 1)] for k in range(len(KINDS))])


def probabilities(w: np.ndarray, leans: np.ndarray, kind: np.ndarray, context: np.ndarray, features: pa.Array) -> np.ndarray:
    """What the classifier says of each candidate; ``features`` is an array of lists, none of them empty."""
    if not len(kind):
        return np.zeros(0)
    votes = context_votes(leans, context)
    ends = np.cumsum(pc.list_value_length(features).to_numpy())
    s = np.add.reduceat(w[features.flatten().to_numpy()], np.concatenate(([0], ends[:-1])))
    for i in (0, 1):
        s = s + w[_SIDES[kind, i, votes[:, i] + 1]]
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def judged(w: np.ndarray, leans: np.ndarray, candidates: list[Candidate]) -> list[tuple[int, int, int]]:
    """Kind, start and end of the candidates of one text that are right."""
    if not candidates:
        return []
    p = probabilities(w, leans, np.array([c.kind for c in candidates]), np.array([c.context for c in candidates]), pa.array([c.features for c in candidates], pa.list_(pa.int32())))
    return chosen((c.kind, c.start, c.end, q) for c, q in zip(candidates, p.tolist()))
