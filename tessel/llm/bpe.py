"""Byte-level BPE encoding of a corpus as a bounded-lookahead streaming transducer (problem 6).

A merge list decides each boundary between two tokens from the text before it and a bounded number of bytes after
it. ``MergeList.lookahead`` is that number, computed from the list. The transducer reads a piece in blocks, emits the
tokens whose end lies at least the lookahead before the end of what it has read, and keeps only the rest, so its
memory doesn't grow with the piece. Decoding is an incremental state machine from bytes to text.
"""

from __future__ import annotations

import codecs
import json
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"

# The published pre-tokenisation of this vocabulary, and the same for texts of ASCII only.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: printable bytes themselves, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class MergeList:
    """Merges in order of priority. ``rule[(left << 32) | right]`` is the place of a rule, ``made[place]`` its token."""

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        letters = byte_letters()
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        self.of_byte = [0] * 256
        for c, b in letters.items():
            self.of_byte[b] = vocab[c]
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
        self.sides = [(vocab[a], vocab[b]) for a, b in pairs]
        self.made = [vocab[a + b] for a, b in pairs]
        self.rule = {a << 32 | b: k for k, (a, b) in enumerate(self.sides)}
        self.lookahead = self._sufficient_lookahead()

    @classmethod
    def load(cls, path: str) -> MergeList:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        return cls(model["vocab"], model["merges"])

    def _sufficient_lookahead(self) -> int:
        """Bytes after a boundary that decide it, whatever follows.

        Rule (u, v) closes a boundary unless a symbol on the right spine of v was taken before by a rule of higher
        priority whose left side it is; whether that one applied depends in the same way on its own right side. Such
        chains run through falling places in the list, and each step reaches at most its right side's bytes further.
        """
        maker = {t: k for k, t in reversed(list(enumerate(self.made)))}
        by_left: dict[int, tuple[list[int], list[int]]] = {}  # left side: places of its rules, greatest reach so far
        most = 0
        for k, (left, right) in enumerate(self.sides):
            reach, s, before = 0, right, k
            while True:
                places, top = by_left.get(s, ((), ()))
                if (n := bisect_left(places, before)) and top[n - 1] > reach:
                    reach = top[n - 1]
                if s not in maker:
                    break
                before = min(before, maker[s])
                s = self.sides[maker[s]][1]
            reach += len(self.bytes_of[right])
            places, top = by_left.setdefault(left, ([], []))
            places.append(k)
            top.append(max(reach, top[-1] if top else 0))
            most = max(most, reach)
        return most

    def merge(self, data: bytes) -> list[int]:
        """The tokens of one block: always the rule of the lowest place, leftmost first."""
        of_byte = self.of_byte
        ids = [of_byte[b] for b in data]
        return self._few(ids) if len(ids) < 48 else self._many(ids)

    def _few(self, ids: list[int]) -> list[int]:
        get, made, none = self.rule.get, self.made, len(self.made)
        ranks = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            k = min(ranks)
            if k == none:
                break
            i = ranks.index(k)
            ids[i] = made[k]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | ids[i], none)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 32 | ids[i + 1], none)
        return ids

    def _many(self, ids: list[int]) -> list[int]:
        get, made, n = self.rule.get, self.made, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(k, i) for i in range(n - 1) if (k := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            k, i = heappop(heap)
            j = after[i]
            if j >= n or ids[i] < 0 or get(ids[i] << 32 | ids[j]) != k:
                continue
            ids[i], ids[j] = made[k], -1
            after[i] = nxt = after[j]
            if nxt < n:
                before[nxt] = i
                if (r := get(ids[i] << 32 | ids[nxt])) is not None:
                    heappush(heap, (r, i))
            if (p := before[i]) >= 0 and (r := get(ids[p] << 32 | ids[i])) is not None:
                heappush(heap, (r, p))
        return [t for t in ids if t >= 0]


class Transducer:
    """Text to ids. Pieces seen before come from a table of bounded size; ``block`` bounds what is merged at once."""

    def __init__(self, merges: MergeList, *, block: int = 2048, table: int = 1 << 18) -> None:
        self.merges = merges
        self.block = max(block, 2 * merges.lookahead)
        self.limit = table
        self.pieces = regex.compile(PIECES)
        self.ascii_pieces = re.compile(ASCII_PIECES)
        self.seen = _Seen(self)

    def stream(self, data: Iterable[bytes]) -> Iterator[list[int]]:
        """The tokens of one piece that arrives in parts, each as soon as no later byte can change it."""
        held, size, m = b"", self.merges.bytes_of, self.merges
        for part in data:
            held += part
            if len(held) < self.block:
                continue
            stable, out, at = len(held) - m.lookahead, [], 0
            for t in m.merge(held):
                if at + len(size[t]) > stable:
                    break
                at += len(size[t])
                out.append(t)
            held = held[at:]
            yield out
        if held:
            yield m.merge(held)

    def piece(self, text: str) -> list[int]:
        data = text.encode("utf-8", "replace")
        if len(data) <= self.block:
            return self.merges.merge(data)
        step = self.block // 2
        return list(chain.from_iterable(self.stream(data[i : i + step] for i in range(0, len(data), step))))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; null and empty texts have none."""
        if not text:
            return []
        if len(self.seen) > self.limit:
            self.seen.clear()
        pattern = self.ascii_pieces if text.isascii() else self.pieces
        if len(text) < 1 << 20:
            return list(chain.from_iterable(map(self.seen.__getitem__, pattern.findall(text))))
        return list(chain.from_iterable(self.seen[m[0]] for m in pattern.finditer(text)))

    def count(self, text: str | None) -> int:
        return len(self.encode(text))


class _Seen(dict):
    """Ids by piece; long pieces aren't kept."""

    def __init__(self, transducer: Transducer) -> None:
        self.transducer = transducer

    def __missing__(self, piece: str) -> list[int]:
        ids = self.transducer.piece(piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids


def decode(merges: MergeList, ids: Iterable[int]) -> Iterator[str]:
    """Text as far as it is complete after each token; bytes that are no UTF-8 come out as U+FFFD."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    for i in ids:
        yield machine.decode(merges.bytes_of[i])
    yield machine.decode(b"", True)


_loaded: dict[str, Transducer] = {}


def transducer(tokenizers: str = TOKENIZERS, file: str = BYTE_BPE) -> Transducer:
    """The transducer of a vocabulary file, loaded once a worker."""
    path = f"{tokenizers}/{file}"
    if path not in _loaded:
        _loaded[path] = Transducer(MergeList.load(path))
    return _loaded[path]


def _texts(column: pa.Array) -> list[str | None]:
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def encode_column(df: DataFrame, key: str, text: str, *, out: str = "ids", counts: bool = False, tokenizers: str = TOKENIZERS) -> DataFrame:
    """``key`` and the ids (``array<int>``, or with ``counts`` their number) of ``text``, one row per input row.

    One pass without a shuffle: each task streams its rows through the transducer. Null and empty texts have no ids
    (an empty list, 0); repeated rows stay; other columns are dropped, so their names cannot clash.
    """
    kind = "long" if counts else "array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(tokenizers)
        for b in batches:
            if counts:
                col = pa.array([t.count(x) for x in _texts(b.column(1))], pa.int64())
            else:
                col = pa.array([t.encode(x) for x in _texts(b.column(1))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), col], names=[key, out])

    rows = df.select(F.col(key), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, `{out}` {kind}")


def decode_column(df: DataFrame, key: str, ids: str, *, out: str = "text", tokenizers: str = TOKENIZERS) -> DataFrame:
    """``key`` and the text of each list of ids; a null list gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = transducer(tokenizers).merges
        for b in batches:
            col = pa.array(["".join(decode(m, x or ())) for x in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), col], names=[key, out])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, `{out}` string")
