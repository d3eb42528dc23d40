import random
from collections import Counter

import numpy as np
import pytest

from tessel.llm import pii
from tessel.llm.pii import Gazetteer, PersonalInformation, Proposer, chosen, context_votes, fit, reliabilities

GIVEN = [a + b for a in ("Mar", "Tor", "Bel", "Osk", "Lin", "Gud", "Per", "Sol", "Ed", "Vil") for b in ("en", "ita", "ovan", "ürn")]
FAMILY = [a + b for a in ("Hask", "Fenn", "Stav", "Drumm", "Kell", "Borg", "Lund", "Nor", "Quist", "Ask") for b in ("berg", "wick", "ström", "ley")]


def write(rnd):
    """A message with the spans it holds. The phrases are the tests' own: the library knows none of them."""
    g, f = rnd.choice(GIVEN), rnd.choice(FAMILY)
    d = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    ten = f"{rnd.choice('23456789')}{d(2)}{rnd.choice('23456789')}{d(6)}"
    name = rnd.choice([f"{g} {f}", f"{f.upper()}, {g}", f"{g} van {f}", f"{g} K. {f}", f"{g} {f}-{rnd.choice(FAMILY)}", f"{g} {f}".lower()])
    email = rnd.choice([f"{g}.{f}@mail.corp.example", f"{g[0]}{f}[at]corp.test", f"{g} dot {f} at corp dot example", f"{g}-x (at) corp (dot) example", f"{f}12%40corp.test"]).lower()
    phone = rnd.choice([f"{d(3)}-555-01{d(2)}", f"+1 {d(3)} 555 01{d(2)}", f"(01632) 960-{d(3)}", f"+49 (0)30 23125-{d(3)}", f"01 99 00 {d(2)} {d(2)}", ten])
    ident = rnd.choice([f"9{d(2)}-{1}{d(1)}-1{d(3)}", f"QQ {d(2)} {d(2)} {d(2)} B", f"1 {d(2)} 07 99 {d(3)} {d(3)}", f"H{d(8)}"])
    street = rnd.choice([f"{d(2)}A Elm Hollow Rd.", f"{d(3)} willow lane", f"Amselweg {d(2)}b", "4, rue des Ajoncs", f"Calle de la Noria {d(2)}"])
    kind, span, text = rnd.choice([
        ("name", name, f"minutes were taken by {name} again"), ("name", name, f"{name} joined after the break"), ("name", name, f"Herr {name} wartet unten"),
        ("email", email, f"reach me under {email} tonight"), ("email", email, f"the list bounced <{email}>"), ("email", email, f"{email} is out of office"),
        ("phone", phone, f"try {phone} after six"), ("phone", phone, f"missed ring from {phone}"), ("phone", phone, f"her number: {phone}"),
        ("id_number", ident, f"his papers say {ident} clearly"), ("id_number", ident, f"(insee {ident})"),
        ("address", street, f"parcels go to {street}, rear door"), ("address", street, f"we meet near {street} (blue gate)"),
        (None, None, f"batch 1{d(9)} finished"), (None, None, f"batch 1{d(9)} restarted"), (None, None, f"batch {ten} finished" if rnd.random() < 0.2 else f"batch 1{d(9)} finished"),
        (None, None, f"invoice {d(3)}-{d(2)}-{d(3)} unpaid"), (None, None, f"needs lib@2.{d(2)}.1 or newer"), (None, None, f"sha K{d(7)} reverted"), (None, None, f"{f} Bakery raised prices"),
        (None, None, f"in the {f} file"), (None, None, f"hello {g}, one more thing"), (None, None, f"{d(2)} Street View tiles were cut"),
    ])
    return text, ({(kind, span)} if kind else set())


@pytest.fixture(scope="module")
def people(spark):
    rnd = random.Random(1)  # half of the names, so that others are known by their parts only
    rows = [(g, f, f"{f} Bakery", "clash") for g, f in zip(rnd.sample(GIVEN, 25), rnd.sample(FAMILY, 25))] + [(None, None, None, None), ("Maren", "Haskberg", None, None)]
    return spark.createDataFrame(rows, "first_name string, last_name string, company string, content string")


def test_found_and_redacted(spark, people):
    rnd = random.Random(4)
    texts = [write(rnd) for _ in range(3000)]
    rows = [(i, f"so {t} ok" if i % 3 else t, "x") for i, (t, _) in enumerate(texts)] + [(9001, None, "x"), (9002, "", "x"), (9003, "word " * 50_000 + "try 212-555-0101", "x")]
    p = PersonalInformation(spark.createDataFrame(rows, "id long, content string, span string").repartition(3), people)
    got = {(r.key, r.kind, r.span) for r in p.found().collect()}
    want = {(i, k, s) for i, (_, x) in enumerate(texts) for k, s in x} | {(9003, "phone", "212-555-0101")}
    assert len(got & want) >= 0.98 * len(want), sorted(want - got)[:9]
    assert len(got & want) >= 0.98 * len(got), sorted(got - want)[:9]
    out = {r.key: r.text for r in p.redacted().collect()}
    assert len(out) == len(rows) and out[9001] is None and out[9002] == "" and out[9003].endswith("try [PHONE]")
    spans = {}
    for r in p.spans().collect():
        spans.setdefault(r.key, []).append(r)
    for i, t, _ in rows[:300]:
        for r in sorted(spans.get(i, []), key=lambda r: -r.start):
            assert t[r.start : r.end] == r.span
            t = t[: r.start] + f"[{r.kind.upper()}]" + t[r.end :]
        assert out[i] == t


def test_what_learning_adds():
    """Errors on phrases never seen: of the plain sum of votes, of the labelers weighed by EM, and of the classifier."""
    rnd = random.Random(6)
    texts = [write(rnd) for _ in range(4000)]
    own = Proposer(Gazetteer(rnd.sample(GIVEN, 25), rnd.sample(FAMILY, 25), ["Haskberg Bakery"]))
    found = [own(t) for t, _ in texts]
    every = [c for cs in found for c in cs]
    said = lambda *v: " ".join(map(str, v))
    first = pii.estimated([(k, v, n) for (k, v), n in Counter((c.kind, said(*c.votes)) for c in every).items()])
    count, mass, prior = np.zeros(pii.CONTEXT_SLOTS), np.zeros(pii.CONTEXT_SLOTS), np.full(pii.CONTEXT_SLOTS, 0.5)
    mean = {k: np.mean([first[k, said(*c.votes)] for c in every if c.kind == k]) for k in range(5)}
    for c in every:
        for at in c.context:
            count[at], mass[at], prior[at] = count[at] + 1, mass[at] + first[c.kind, said(*c.votes)], mean[c.kind]
    leans = pii.leaning(count, mass, prior)
    around = context_votes(leans, [c.context for c in every]).tolist()
    both = pii.estimated([(k, v, n) for (k, v), n in Counter((c.kind, said(*c.votes, *x)) for c, x in zip(every, around)).items()])
    w = fit([[*c.features, *pii._voted(c.kind, x)] for c, x in zip(every, around)], np.array([both[c.kind, said(*c.votes, *x)] for c, x in zip(every, around)]))

    def errors(decide):
        return sum(len({(pii.KINDS[k], t[a:b]) for k, a, b in decide(cs)} ^ want) for (t, want), cs in zip(texts, found))

    by = lambda p: lambda cs: chosen((c.kind, c.start, c.end, p(c)) for c in cs)
    summed = errors(by(lambda c: 1 / (1 + np.exp(0.5 - sum(c.votes)))))
    weighed = errors(by(lambda c: first[c.kind, said(*c.votes)]))
    with_context = errors(by(lambda c: both[c.kind, said(*c.votes, *context_votes(leans, c.context)[0])]))
    learned = errors(lambda cs: pii.judged(w, leans, cs))
    print(summed, weighed, with_context, learned)
    assert learned <= with_context < min(summed, weighed) and learned < 0.02 * len(texts)


def test_empty_tables(spark, people):
    none = spark.createDataFrame([], "id string, content string")
    assert PersonalInformation(none, people.limit(0)).found().count() == 0
    streets = spark.createDataFrame([(i, f"12 rue des {w}, ici") for i, w in enumerate(["Ajoncs", "Ajoncs", "Lilas", "Lilas"])], "id long, content string")
    assert len(PersonalInformation(streets, people.limit(0)).streets.hashes) == 2
    pii.MOST_STREETS, most = 1, pii.MOST_STREETS
    try:
        with pytest.raises(ValueError, match="street"):
            PersonalInformation(streets, people)
    finally:
        pii.MOST_STREETS = most
    with pytest.raises(ValueError):
        most, pii.MOST_PEOPLE = pii.MOST_PEOPLE, 3
        try:
            PersonalInformation(none, people)
        finally:
            pii.MOST_PEOPLE = most


def test_gazetteer_parts():
    g = Gazetteer([*GIVEN, None, " BELITA "], FAMILY, ["Haskberg Bakery", None, ""])
    assert g.grade("Maren", "g") == 2 and g.grade("TORÜRN", "g") == 2 and g.grade("Haskley-Stavwick", "f") == 2
    assert Gazetteer([x for x in GIVEN if x != "Belovan"], FAMILY).grade("Belovan", "g") == 1
    assert g.grade("bakery", "f") == 0 and "bakery" in g.trades


def test_em_finds_the_reliable_labelers():
    rnd = np.random.default_rng(3)
    truth = rnd.random(5000) < 0.3
    votes = []
    for t in truth:
        v = [(1 if (t if rnd.random() < a else not t) else -1) if rnd.random() < c else 0 for a, c in ((0.95, 0.9), (0.9, 0.8), (0.55, 0.9), (0.97, 0.5))]
        votes.append(tuple(v))
    p = reliabilities(Counter(votes))
    guess = np.array([p[v] > 0.5 for v in votes])
    assert (guess == truth).mean() > 0.95
    assert reliabilities(Counter()) == {}


def test_fit_and_overlaps():
    w = fit([[1, 2], [1, 3]] * 20, np.array([1.0, 0.0] * 20))
    assert w[2] > 0 > w[3] and not fit([], np.array([])).any()
    assert chosen([(0, 0, 5, 0.9), (1, 3, 9, 0.99), (2, 10, 12, 0.4), (3, 20, 25, 0.8), (4, 18, 25, 0.8)]) == [(1, 3, 9), (4, 18, 25)]


@pytest.mark.parametrize("text", ["", "@", "12 rue ", "a" * 5000 + "@" + "b" * 5000, "1 " * 4000, "at dot at dot " * 2000, "Ab " * 3000, "++++1 1 1 1", "A1" * 4000])
def test_proposer_survives(text):
    Proposer(Gazetteer(GIVEN, FAMILY))(text)
