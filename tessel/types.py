"""Logical column types, modes and errors."""

from __future__ import annotations

import re
from enum import Enum
from typing import NamedTuple

from pyspark.sql import types as T

TEXT, LONGTEXT, INTEGER, REAL, BOOLEAN, JSON = "TEXT", "LONGTEXT", "INTEGER", "REAL", "BOOLEAN", "JSON"

_SPARK = {INTEGER: T.LongType(), REAL: T.DoubleType(), BOOLEAN: T.BooleanType()}


class SearchMode(Enum):
    KEYWORD = "keyword"
    SEMANTIC = "semantic"
    HYBRID = "hybrid"


KEYWORD, SEMANTIC, HYBRID = SearchMode.KEYWORD, SearchMode.SEMANTIC, SearchMode.HYBRID


class Column(NamedTuple):
    """What ``create_table`` takes instead of text: the logical type and, if any, constraints such as ``PRIMARY KEY``."""

    type: str
    constraints: str = ""

    def __str__(self) -> str:
        return " ".join(filter(None, self))


class EmbeddingModelError(Exception):
    """The table was embedded by another model."""


class IntegrityError(ValueError):
    """A row or edge refers to something that isn't there, or a key is repeated."""


def spark_type(logical: str) -> T.DataType:
    """Storage of a logical type; anything unknown is text under its own name."""
    return _SPARK.get(logical.upper(), T.StringType())


def is_text(logical: str) -> bool:
    return logical in (TEXT, LONGTEXT)


def identifier(name: str, kind: str = "identifier") -> str:
    """A name of letters, digits and underscores that doesn't begin with a digit."""
    if not isinstance(name, str) or not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"invalid {kind}: {name!r}")
    return name


def table_name(name: str) -> str:
    identifier(name, "table name")
    if "_fts_" in name or name.endswith("__history"):
        raise ValueError(f"reserved table name: {name!r}")
    return name


def search_mode(mode: SearchMode | str) -> SearchMode:
    if isinstance(mode, SearchMode):
        return mode
    try:
        return SearchMode(str(mode).lower())
    except ValueError:
        raise ValueError(f"unknown search mode: {mode!r}") from None


def ordering(order_by: str) -> list[tuple[str, bool]]:
    """``col [ASC|DESC], ...`` as names and whether descending."""
    out = []
    for part in filter(str.strip, (order_by or "").split(",")):
        m = re.fullmatch(r"\s*([A-Za-z_]\w*)(?:\s+(asc|desc))?\s*", part, re.I)
        if not m:
            raise ValueError(f"invalid ORDER BY: {order_by!r}")
        out.append((m[1], (m[2] or "").lower() == "desc"))
    return out
