import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessel.llm.pieces import LEVELS, cuts, level_of, split, split_column


def longest(text, level):
    """The longest stretch between the boundaries up to a level."""
    a, b = map(list, cuts(text, level))
    return max(y - x for x, y in zip([0, *b], [*a, len(text)]))


def walk(text, limit, overlap):
    """The greedy walk, one piece after the other."""
    level = next((k for k in range(4) if longest(text, k) <= limit), 4)
    found = list(zip(*map(list, cuts(text, 3))))
    s = found[0][1] if found and found[0][0] == 0 else 0
    n = found[-1][0] if found and found[-1][1] == len(text) else len(text)
    if s >= n:
        return level, [(0, 0)]
    begins = [b for _, b in found if s < b < n]
    out = []
    while True:
        e = s + limit
        for k in range(min(level, 3), 4):
            trimmed = [next(a for a, b in found if a <= x <= b) for x in cuts(text, k)[0].tolist() if s < x < n]
            legal = [x for x in [*trimmed, n] if x <= s + limit and (x > s + overlap or x == n)]
            if legal:
                e = legal[-1]
                break
        out.append((s, e))
        if e >= n:
            return level, out
        s = next((b for b in begins if e - overlap <= b < e), e - overlap)


ALPHABET = st.sampled_from(list("abcdef gh  ..!?\n\r\t") + ["。", "\n\n", "\r\n", "漢", "🧠", "longword", ". ", "\n \n"])


@settings(max_examples=400, deadline=None)
@given(st.lists(ALPHABET, max_size=160).map("".join), st.integers(8, 40), st.integers(1, 4))
def test_same_as_the_greedy_walk(text, limit, overlap):
    level, spans = split(text, limit, overlap)
    if len(text) <= limit:
        assert (level, spans) == (None, [(0, len(text))])
        return
    assert (level, spans) == walk(text, limit, overlap)
    assert not (text[: spans[0][0]] + text[spans[-1][1] :]).strip(" \t\r\n")
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert b - a <= limit and a < c < b < d and b - c <= overlap  # nothing is left out, and every joint overlaps
    assert spans[-1][1] - spans[-1][0] <= limit


@pytest.mark.parametrize("text, level", [
    ("a" * 1201, "hard"), ("ab " * 600, "word"), ("Ab cd. " * 300, "sentence"), ("漢字。" * 500, "sentence"), ("line of text\n" * 200, "line"),
    ("par\r\n \t\r\ngraph\n\n" * 200, "paragraph"), ("x" * 1200 + "\n\n" + "y" * 1200, "paragraph"), ("x" * 1200 + " \n" + "y" * 5, "word"),
    ("x" * 1201 + "\n\n" + "y", "hard"), ("a.b." * 400, "hard"), ("x" * 700 + "\r" + "y" * 700, "hard"),
])
def test_levels(text, level):
    assert LEVELS[level_of(text)] == level


def test_overlap_opens_the_next_piece():
    rnd = random.Random(2)
    text = " ".join("".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(2, 9))) for _ in range(2000))
    _, spans = split(text)
    for (_, b), (c, _) in zip(spans, spans[1:]):
        assert 130 < b - c <= 150 and text[c - 1] == " "
    _, spans = split("x" * 5000)
    assert spans == [(0, 1200), (1050, 2250), (2100, 3300), (3150, 4350), (4200, 5000)]
    _, spans = split("word " * 400_000)
    assert all(b - a <= 1200 for a, b in spans)


def test_column(spark):
    rows = [(1, "short"), (2, None), (3, ""), (3, ""), (4, "One two. " * 400), (None, "z" * 3000)]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "id long, content string, start int")
    got = split_column(df, "id", "content").collect()
    assert sorted(r.content or "-" for r in got if r.id in (1, 2, 3)) == ["-", "-", "-", "short"]
    assert {r.boundary for r in got if r.id == 4} == {"sentence"} and {r.boundary for r in got if r.id is None} == {"hard"}
    assert [r.piece_no for r in sorted((r for r in got if r.id == 4), key=lambda r: r.start)] == list(range(sum(r.id == 4 for r in got)))
    assert re.match("One|two", sorted((r.start, r.content) for r in got if r.id == 4)[1][1])
    assert split_column(df.limit(0), "id", "content").count() == 0
    assert {r.seq for r in split_column(df.withColumnRenamed("start", "seq"), "id", "content", keep=["seq"]).collect()} == {7}
    with pytest.raises(ValueError):
        split_column(df, "id", "content", limit=10, overlap=6)
