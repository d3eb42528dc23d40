"""Metadata filters as pushable column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def metadata_filter(where: Mapping[str, Any] | None, columns: Sequence[str]) -> Column:
    """Equality or ``{operator: value}`` per key, AND across keys; ``$and`` and ``$or`` take lists of filters.

    Operators: ``$eq $ne $gt $gte $lt $lte $in $nin``. An unknown key or operator matches nothing. Null equals only
    null, ``$ne`` and ``$nin`` match null, comparisons don't. The result is never null.
    """
    parts: list[Column] = []
    for key, value in (where or {}).items():
        if key in ("$and", "$or"):
            subs = [metadata_filter(w, columns) for w in value]
            parts.append(_all(subs) if key == "$and" else reduce(lambda a, b: a | b, subs, F.lit(False)))
        elif key not in columns:
            parts.append(F.lit(False))
        elif isinstance(value, Mapping):
            parts += [_one(F.col(key), op, v) for op, v in value.items()]
        else:
            parts.append(_one(F.col(key), "$eq", value))
    return _all(parts)


def _one(c: Column, op: str, v: Any) -> Column:
    compare = {"$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}
    if op in compare:
        return F.lit(False) if v is None else F.coalesce(getattr(c, compare[op])(v), F.lit(False))
    if op == "$eq":
        return c.isNull() if v is None else c.isNotNull() & (c == v)
    if op == "$ne":
        return c.isNotNull() if v is None else c.isNull() | (c != v)
    if op in ("$in", "$nin"):
        known = [x for x in v if x is not None]
        hit = (c.isNotNull() & c.isin(known) if known else F.lit(False)) | (c.isNull() if None in v else F.lit(False))
        return hit if op == "$in" else ~hit
    return F.lit(False)


def like(c: Column, text: str) -> Column:
    """Whether the text occurs, letter case aside; ``%``, ``_`` and the escape in it stand for themselves."""
    plain = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return c.ilike(f"%{plain}%")


def optional(df: DataFrame, limit: int = 0, order: str | None = "created_at", **wanted: Any) -> DataFrame:
    """Rows with each given value (``min_x``: at least); None asks nothing; newest first; ``limit`` of 0 or less: all."""
    for name, v in wanted.items():
        if v is not None:
            df = df.filter(F.col(name[4:]) >= v if name.startswith("min_") else F.col(name) == v)
    if order and order in df.columns:
        df = df.orderBy(F.desc(order))
    return df.limit(limit) if limit > 0 else df
