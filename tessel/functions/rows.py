"""Rows as JSON, labels and hashes."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(columns: Sequence[str]) -> Column:
    """The row as JSON with its columns in order of name and nulls kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def metadata(schema: Mapping[str, str]) -> Column:
    """The scalar columns of a row (all but long texts and JSON) without nulls, as JSON in order of name."""
    keep = sorted(c for c, t in schema.items() if t.split()[0] not in ("LONGTEXT", "JSON"))
    return F.to_json(F.struct(*[F.col(c) for c in keep]))


def label(template: str, columns: Sequence[str]) -> Column:
    """``{column}`` replaced by its value; a null or unknown column gives nothing."""
    parts: list[Column] = []
    for text, name in re.findall(r"([^{]*)(?:\{(\w+)\})?", template):
        parts += [F.lit(text)] if text else []
        parts += [F.coalesce(F.col(name).cast("string"), F.lit(""))] if name in columns else []
    return F.concat(*parts) if parts else F.lit("")


def event_hash(prev: Column, op: Column, pk: Column, row: Column) -> Column:
    """SHA-256 of the four parts with a bar between."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.sha2(F.concat_ws("|", part(prev), part(op), part(pk), part(row)), 256)


def merged_properties(old: Column, new: Column) -> Column:
    """Shallow merge of two JSON objects; values keep their JSON types, the new one's stand. What isn't an object is empty."""
    kind = "map<string,variant>"
    a, b = (F.coalesce(F.from_json(c, kind), F.create_map().cast(kind)) for c in (old, new))
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b))


def as_key(value: Column, declared: str) -> Column:
    """A key from text, in the type it was declared with; null where it isn't one."""
    return value.try_cast("long") if declared.upper().startswith("INTEGER") else value.cast("string")
