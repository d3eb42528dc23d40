import random

import numpy as np
import pytest

from tessel.llm import spans


def brute(docs, length):
    where = {}
    for i, t in docs:
        if i is not None and t:
            for k in range(len(t) - length + 1):
                where.setdefault(t[k : k + length], {}).setdefault(i, set()).add(k)
    pairs, cover = set(), {}
    for w, at in where.items():
        if len(at) > 1:
            ids = sorted(at)
            pairs |= {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :]}
            for i, ks in at.items():
                for k in ks:
                    cover.setdefault(i, set()).update(range(k, k + length))
    return pairs, {i: len(c) for i, c in cover.items()}


def check(spark, docs, length=200, parts=3):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, symbol string, rep long").repartition(parts)
    s = spans.SharedSpans(df, length=length)
    pairs, cover = brute(docs, length)
    got = [tuple(r) for r in s.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    long = {i: t for i, t in docs if i is not None and t and len(t) >= length}
    of = {i: min(j for j, u in long.items() if u == t) for i, t in long.items()}
    links = {tuple(sorted((of[a], of[b]))) for a, b in pairs if of[a] != of[b]}
    assert sorted(tuple(r) for r in s.classes().collect()) == sorted((i, c, sum(c in x for x in links)) for i, c in of.items())
    assert {(r.doc, r.shared_chars) for r in s.coverage().collect()} == {(i, cover.get(i, 0)) for i, _ in docs if i is not None}


def noise(rnd, n, alphabet="abcdefghij klmnop\nqrstuvwxyzäß漢🧠"):
    return "".join(rnd.choice(alphabet) for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_planted_passages(spark, seed):
    rnd = random.Random(seed)
    docs, shared = [], [noise(rnd, n) for n in (199, 200, 200, 201, 260, 900, 120)]
    for i in range(60):
        t = noise(rnd, rnd.randrange(0, 700))
        for _ in range(rnd.choice([0, 0, 1, 1, 2])):
            t += rnd.choice(shared) + noise(rnd, rnd.randrange(0, 90), rnd.choice(["ab", "abcdefgh "]))
        docs.append((i, t))
    docs += [(900, None), (901, ""), (902, docs[3][1]), (903, docs[3][1]), (904, docs[10][1] + "x")]
    check(spark, docs)


def test_periodic_texts(spark):
    rnd = random.Random(5)
    docs = [(i, noise(rnd, 60) + unit * (n // len(unit)) + noise(rnd, 60)) for i, (unit, n) in enumerate([("-", 300), ("-", 450), ("ab", 260), ("ba", 300), ("abc", 420), ("cab", 199), ("hello, world ", 400), ("world hello, ", 500), ("-", 150), ("abcdefghijkl", 300), ("labcdefghijk", 300), (noise(rnd, 45), 450)])]
    docs += [(100, docs[-1][1][100:400]), (101, "=" * 199 + "-" * 199), (102, "=" * 200)]
    check(spark, docs)


def test_many_occurrences(spark):
    """More documents than are compared pair by pair share a passage, or only part of one."""
    rnd = random.Random(6)
    head, body = noise(rnd, 150), noise(rnd, 230)
    docs = [(i, noise(rnd, 80) + head + noise(rnd, 150)) for i in range(25)]
    docs += [(100 + i, noise(rnd, 40) + body + noise(rnd, 40)) for i in range(22)]
    docs += [(200 + i, body[i % 3 :] + noise(rnd, 70)) for i in range(20)]
    docs += [(300, body), (301, body), (302, "-" * 3000), (303, "-" * 2500 + "x")]
    check(spark, docs)


def test_other_length_and_empty(spark):
    rnd = random.Random(7)
    x = noise(rnd, 130)
    check(spark, [(1, "a" + x), (2, x + "b"), (None, x), (3, "zz")], length=120)
    s = spans.SharedSpans(spark.createDataFrame([], "doc_id string, text string"))
    assert s.pairs().count() == 0 and s.coverage().count() == 0
    with pytest.raises(ValueError):
        spans.SharedSpans(spark.createDataFrame([], "doc_id string, text string"), length=50)


def test_parts_of_a_long_text_give_the_same_symbols(monkeypatch):
    rnd = random.Random(8)
    text = noise(rnd, 6000) + "=" * 2000 + noise(rnd, 3000, "ab") + "xyz" * 700 + noise(rnd, 2000)
    whole = {(int(p), int(n)) for _, at, name in spans.symbols([text]) for p, n in zip(at, name)}
    monkeypatch.setattr(spans, "_CHARS", 1000)
    cut = [(int(p), int(n)) for _, at, name in spans.symbols(["short", text]) for p, n in zip(at, name)]
    assert set(cut) == whole and len(cut) == len(whole)


def test_boundaries_depend_on_near_text_only():
    rnd = random.Random(9)
    sep = np.uint64(1)
    for _ in range(200):
        core = noise(rnd, 300, rnd.choice(["ab", "a", "abc", "abcdefghijklm "])) if rnd.random() < 0.8 else noise(rnd, 3) * 100
        found = []
        for _ in range(2):
            pre, post = noise(rnd, rnd.randrange(50), "abx"), noise(rnd, rnd.randrange(50), "aby")
            chars = np.array([ord(c) for c in pre + core + post], np.uint64)
            names = np.append(spans._mix(chars + np.uint64(77)), sep)
            at, low = spans.recompressed(names.copy(), np.array([len(chars)]))
            ok = at[(at - len(pre) >= spans.CONTEXT) & (at - len(pre) <= len(core) - spans.CONTEXT)]
            name = spans._named(chars.astype(np.uint32), ok, *low, *spans._power(len(names) + 1))
            found.append((set((at[(at - len(pre) >= spans.reach()) & (at - len(pre) <= len(core) - spans.reach())] - len(pre)).tolist()), dict(zip((ok - len(pre)).tolist(), name.tolist()))))
        assert found[0] == found[1]
        gaps = np.diff(sorted(found[0][0]))
        assert found[0][0] and gaps.max() <= 2 * (spans.WIDTHS[-1] + 1)
