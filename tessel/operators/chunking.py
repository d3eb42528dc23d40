"""Long documents as rows of chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CHARS = 1200
#: What parts sentences and paragraphs.
_SENTENCE_END, _PARAGRAPH_END = r"(?<=[.!?])\s+|\n+", r"\n\s*\n"


def _sentences(paragraph: str) -> list[str]:
    return [t for s in re.split(_SENTENCE_END, paragraph) if (t := s.strip())]


def _units(text: str, size: int) -> Iterator[tuple[str, str]]:
    """Sentences, none longer than ``size``, each with what would join it to the one before."""
    glue = ""
    for paragraph in re.split(_PARAGRAPH_END, text):
        for s in _sentences(paragraph):
            for at in range(0, len(s), size):
                yield glue, s[at : at + size]
                glue = " "
        glue = "\n\n"


def chunks(text: str | None, size: int = MAX_CHARS, overlap: bool = True) -> list[str]:
    """Whole sentences packed up to ``size`` characters, paragraphs kept apart by an empty line.

    With overlap a chunk opens with the last sentence of the one before, unless it begins with it anyway, and may
    thereby exceed the size. Sentences longer than the size are cut. Null and blank texts have no chunks.
    """
    if size <= 0:
        raise ValueError("size must be positive")
    packed: list[str] = []
    for glue, unit in _units(text or "", size):
        if packed and len(packed[-1]) + len(glue) + len(unit) <= size:
            packed[-1] += glue + unit
        else:
            packed.append(unit)
    if not overlap:
        return packed
    lead = ["", *((_sentences(c) or [c])[-1] for c in packed[:-1])]
    return [c if not p or c.startswith(p) else f"{p} {c}" for p, c in zip(lead, packed)]


def chunk_array(text: Column, size: int = MAX_CHARS, overlap: bool = True) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunks(t if isinstance(t, str) else None, size, overlap))

    return run(text)


def chunk_rows(df: DataFrame, key: str, text: str, size: int = MAX_CHARS, overlap: bool = True) -> DataFrame:
    """``doc_id, chunk_seq`` (from 0)``, content``: one row per chunk; texts without chunks give none."""
    at = F.posexplode(chunk_array(F.col(text), size, overlap))
    return df.select(F.col(key).alias("doc_id"), at.alias("chunk_seq", "content"))
