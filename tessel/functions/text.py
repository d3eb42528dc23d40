"""Text functions: tokens of keyword search, sentences and paragraphs."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Accented Latin letters and what they fold to, from their decompositions."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x250)]
    pairs = [(a, b[0]) for a, b in pairs if len(b) > 1 and b[0].isalpha() and a == a.lower()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def folded(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}+", ""), ACCENTED, PLAIN)


def tokens(text: Column) -> Column:
    """Runs of letters and digits of the folded text, in order; null and empty texts have none."""
    parts = F.split(folded(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda t: t != "")


def plain_query(query: Column) -> Column:
    """A keyword query as terms joined by `` OR ``: what is neither letter, number nor underscore parts them."""
    words = F.filter(F.split(query, r"[^\p{L}\p{N}_]+"), lambda t: t != "")
    return F.array_join(words, " OR ")


def paragraphs(text: Column) -> Column:
    return _stripped(F.split(text, r"\n\s*\n"))


def sentences(text: Column) -> Column:
    """Sentences by final punctuation before white space, and lines."""
    return _stripped(F.split(text, r"(?<=[.!?])\s+|\n+"))


def _stripped(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def fixed_pieces(text: Column, size: int) -> Column:
    """Consecutive substrings of ``size`` characters; an empty text has none."""
    starts = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))
    cut = F.transform(starts, lambda i: F.substring(text, i * size + 1, F.lit(size)))
    return F.when(F.length(text) > 0, cut).otherwise(F.array().cast("array<string>"))
