"""Splitting oversized items at natural boundaries (problem 2), by pointer doubling.

Every place where a piece may begin is joined to the farthest legal end of a piece from there and, the overlap
included, to the beginning of the next piece. Squaring this successor table again and again gives the table of 2, 4, 8
... steps; what the tables reach from the beginning of the text are the cuts of the greedy walk, found in as many
rounds as the number of pieces has binary digits. The level of a text comes out the same way: it is the first one whose
boundaries alone, followed without overlap, lead from the beginning to the end. Beginnings and ends are sorted, so the
joins are merges of sorted columns, and all tables of a text stay within its row: no exchange is needed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1200
OVERLAP = 150
LEVELS = ("paragraph", "line", "sentence", "word", "hard")

#: Fixed by the statement of the problem: what is a boundary, coarsest first; each also ends what the finer ones do.
_PARAGRAPH = r"\r?\n(?:[ \t]*\r?\n)+"
_LINE = r"\r?\n"
_SENTENCE = r"(?<=[.!?])[ \t]+|(?<=[。！？])"
_WORD = r"[ \t]+"
_AT = [re.compile("|".join(p)) for p in ([_PARAGRAPH], [_PARAGRAPH, _LINE], [_PARAGRAPH, _LINE, _SENTENCE], [_PARAGRAPH, _LINE, _SENTENCE, _WORD])]


def cuts(text: str, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries up to a level: where their white space begins and where it ends; touching ones are one."""
    found = np.array([m.span() for m in _AT[level].finditer(text)], np.int64).reshape(-1, 2)
    apart = found[1:, 0] > found[:-1, 1]
    return found[np.concatenate(([True], apart))[: len(found)], 0], found[np.concatenate((apart, [True]))[: len(found)], 1]


def _doubled(step: np.ndarray) -> np.ndarray:
    """The states that following ``step`` (state to state, the last one to itself) from state 0 visits."""
    seen = np.zeros(1, np.int64)
    while True:
        more = np.union1d(seen, step[seen])
        if len(more) == len(seen):
            return seen
        seen, step = more, step[step]


def _inner(text: str, level: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Where a text begins and ends without the boundaries at its edges, and those between."""
    end, after = cuts(text, level)
    first = int(after[0]) if len(end) and end[0] == 0 else 0
    last = int(end[-1]) if len(end) and after[-1] == len(text) else len(text)
    keep = (end > first) & (after < last)
    return first, last, end[keep], after[keep]


def level_of(text: str, limit: int = LIMIT) -> int:
    """The first level at which no stretch between boundaries is longer than the limit: from each boundary to the farthest
    one within the limit, the walk gets to the end of the text and isn't stuck before a longer stretch."""
    for level in range(4):
        first, last, end, after = _inner(text, level)
        begins, ends = np.concatenate(([first], after)), np.append(end, last)
        far = np.searchsorted(ends, begins + limit, "right")  # state i stands before end i; the last state is the end of the text
        if first >= last or len(ends) in _doubled(np.append(np.maximum(far, np.arange(len(begins))), len(ends))):
            return level
    return 4


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[int | None, list[tuple[int, int]]]:
    """Level of a text and the spans of its pieces; a text within the limit is one piece and has no level."""
    if len(text) <= limit:
        return None, [(0, len(text))]
    level = level_of(text, limit)
    first, n, end, after = _inner(text, 3)
    if first >= n:
        return level, [(0, 0)]
    # a piece begins at a boundary, where the overlap begins that no boundary shortens, or inside a stretch too long to
    # be got over: there anywhere
    natural, ends = np.concatenate(([first], after)), np.append(end, n)
    bare = ends - overlap
    bare = bare[(bare > first) & (np.searchsorted(natural, bare) == np.searchsorted(natural, ends))]
    edges = np.concatenate(([first], ends))
    long = np.flatnonzero(np.diff(edges) > limit - overlap)
    begins = np.unique(np.concatenate([natural, bare, *[np.arange(edges[i], edges[i + 1]) for i in long]]))
    # its farthest end: of the text's level, or of a finer one where that gets no farther than the overlap
    stop = np.zeros(len(begins), np.int64)
    for k in range(min(level, 3), 4):
        at = cuts(text, k)[0]  # of a coarser boundary the white space before it goes as well
        at = np.unique(np.append(end[np.searchsorted(after, at[(at > first) & (at < n)])], n)) if k < 3 else ends
        far = at[np.maximum(np.searchsorted(at, begins + limit, "right") - 1, 0)]
        legal = (stop == 0) & (far <= begins + limit) & ((far > begins + overlap) | (far == n))
        stop[legal] = far[legal]
    stop = np.where(stop == 0, begins + limit, stop)  # no end there: cut hard
    # the next beginning: the first boundary among the last characters of the piece, else all of these
    j = np.minimum(np.searchsorted(natural, stop - overlap), len(natural) - 1)
    nxt = np.where((natural[j] >= stop - overlap) & (natural[j] < stop), natural[j], stop - overlap)
    step = np.where(stop >= n, np.arange(len(begins)), np.minimum(np.searchsorted(begins, nxt), len(begins) - 1))
    visited = _doubled(step)
    return level, list(zip(begins[visited].tolist(), stop[visited].tolist()))


def split_column(df: DataFrame, key: str, text: str, *, limit: int = LIMIT, overlap: int = OVERLAP, keep: Sequence[str] = ()) -> DataFrame:
    """``key, piece_no`` (from 0)``, start, end, content, boundary`` and the columns in ``keep``: the pieces of each text, at
    most ``limit`` long.

    Each piece after the first opens with the last ``overlap`` characters of the one before, or with fewer to begin at
    a boundary; where the next boundary of the text's level lies too far for that, the piece is cut at a finer one. White
    space at a cut belongs to neither piece. ``boundary`` is the level of an oversized text, null for others. Defined
    cases: null, empty and short texts are one piece, unchanged; of an oversized text without anything but white space one
    empty piece is left; repeated rows are split alike; other columns are ignored.
    """
    if not 0 < overlap <= limit // 2:
        raise ValueError("the overlap must be at least 1 and at most half of the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, *keep, "piece_no", "start", "end", "content", "boundary"]
        for b in batches:
            at, no, start, end, content, level = [], [], [], [], [], []
            for i, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                lv, spans = (None, [(0, 0)]) if t is None else split(t, limit, overlap)
                for k, (x, y) in enumerate(spans):
                    for col, v in zip((at, no, start, end, content, level), (i, k, x, y, None if t is None else t[x:y], None if lv is None else LEVELS[lv])):
                        col.append(v)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in b.columns[:-1]), pa.array(no, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(content, pa.string()), pa.array(level, pa.string())], names=names)

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return df.select(key, *keep, F.col(text).alias("_text")).mapInArrow(run, f"{kinds}, piece_no long, start long, end long, content string, boundary string")
