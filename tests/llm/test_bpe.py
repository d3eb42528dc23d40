import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessel.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(f"{bpe.TOKENIZERS}/{bpe.BYTE_BPE}"), reason="no vocabulary file")


@pytest.fixture(scope="module")
def t():
    return bpe.transducer()


@pytest.fixture(scope="module")
def public():
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZERS}/{bpe.BYTE_BPE}")
    tok.encode_special_tokens = True
    return lambda x: tok.encode(x, add_special_tokens=False).ids


def naive(m, data):
    ids = [m.of_byte[b] for b in data]
    while True:
        ranks = [(m.rule[k], i) for i in range(len(ids) - 1) if (k := ids[i] << 32 | ids[i + 1]) in m.rule]
        if not ranks:
            return ids
        k, i = min(ranks)
        ids[i : i + 2] = [m.made[k]]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("aeinrst .'\t\n-=_09")), st.characters(exclude_categories=["Cs"])), max_size=200))
def test_same_as_public_tokenizer(t, public, text):
    assert t.encode(text) == public(text)
    assert "".join(bpe.decode(t.merges, t.encode(text))) == text


@pytest.mark.parametrize("text", ["", " ", "\n\n  x", "<|endoftext|>", "it's We'LL 'S", " x 　y\x1c\x1dz\x85", "é‍👍🏽", "  " * 9000, "a" * 9000, "日本語" * 5000, "-" * 5001 + "=" * 3000])
def test_fixed_texts(t, public, text):
    assert t.encode(text) == public(text)


@pytest.mark.parametrize("seed", range(6))
def test_blocks_of_the_least_size(t, seed):
    """Emission after the computed lookahead never differs from merging the whole piece."""
    rnd = random.Random(seed)
    m = t.merges
    small = bpe.Transducer(m, block=1)
    assert small.block == 2 * m.lookahead
    tokens = [b for b in m.bytes_of.values() if len(b) > 1]
    for _ in range(40):
        kind = rnd.randrange(4)
        if kind == 0:
            data = bytes(rnd.choice(b"abcdeinrst") for _ in range(1500))
        elif kind == 1:
            data = b"".join(rnd.choice(tokens) for _ in range(250))
        elif kind == 2:
            data = (rnd.choice(tokens) + rnd.choice(tokens)) * 150
        else:
            x = rnd.choice(tokens)
            data = b"".join(x[: rnd.randrange(1, len(x) + 1)] for _ in range(400))
        parts = [data[i : i + 7] for i in range(0, len(data), 7)]
        assert [i for out in small.stream(parts) for i in out] == m.merge(data)


def test_heap_and_plain_merge_agree(t):
    rnd = random.Random(9)
    for _ in range(60):
        data = bytes(rnd.choice(b"the and ing tion 00  ") for _ in range(rnd.randrange(1, 120)))
        ids = [t.merges.of_byte[b] for b in data]
        assert t.merges._few(list(ids)) == t.merges._many(list(ids)) == naive(t.merges, data)


def test_column(spark, public):
    rows = [(1, "Hello  world"), (2, None), (3, ""), (3, ""), (4, "x" * 100_000), (None, "a")]
    df = spark.createDataFrame([(a, b, "clash") for a, b in rows], "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, r.ids) for r in bpe.encode_column(df, "doc_id", "text").collect()), key=str)
    assert got == sorted(((a, public(b or "")) for a, b in rows), key=str)
    back = bpe.decode_column(bpe.encode_column(df, "doc_id", "text"), "doc_id", "ids")
    assert sorted((r.text for r in back.collect())) == sorted(b or "" for _, b in rows)
    counts = {(r.doc_id, r.n) for r in bpe.encode_column(df, "doc_id", "text", out="n", counts=True).collect()}
    assert counts == {(a, len(public(b or ""))) for a, b in rows}
    assert bpe.encode_column(df.limit(0), "doc_id", "text").count() == 0
