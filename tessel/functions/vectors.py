"""Vectors as arrays: the hash embedding and distances."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIM = 384
#: The white space that parts words, in the notation of both Java's and RE2's patterns.
SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def hash_slot(word: Column, dim: int = DIM) -> Column:
    """``md5(word) mod dim`` from the 128-bit value in three parts that fit a long."""
    h = F.md5(word)
    part = lambda a, n: F.conv(F.substring(h, a, n), 16, 10).cast("long")
    mod = F.lit(0).cast("long")
    for a, n in ((1, 12), (13, 10), (23, 10)):
        mod = F.pmod(mod * F.lit(pow(16, n, dim)) + part(a, n) % dim, F.lit(dim))
    return mod.cast("int")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")


def hash_embedding_rows(df: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """The hash embedding as rows ``key, slot, value`` of the components that aren't zero, inside the JVM.

    Words are counted by slot before the shuffle. Texts without words have no rows."""
    w = df.select(key, F.explode(words(F.col(text))).alias("_w")).select(key, hash_slot(F.col("_w"), dim).alias("slot"))
    c = w.groupBy(key, "slot").agg(F.count("*").cast("double").alias("_c"))
    norm = F.sqrt(F.sum(F.col("_c") * F.col("_c")).over(Window.partitionBy(key)))  # at most dim rows a key
    return c.select(key, "slot", (F.col("_c") / norm).alias("value"))


_slots: dict[tuple[str, int], int] = {}


def _slot(word: str, dim: int) -> int:
    if (at := _slots.get((word, dim))) is None:
        if len(_slots) > 200_000:
            _slots.clear()
        at = _slots[word, dim] = int(hashlib.md5(word.encode("utf-8", "replace")).hexdigest(), 16) % dim
    return at


def hash_slots(text: str | None, dim: int = DIM) -> dict[int, float]:
    """The components of ``embed_hash`` that aren't zero."""
    counts: dict[int, int] = {}
    for w in (text or "").lower().split():
        s = _slot(w, dim)
        counts[s] = counts.get(s, 0) + 1
    norm = sum(n * n for n in counts.values()) ** 0.5
    return {s: n / norm for s, n in counts.items()}


def embed_hash(text: str | None, dim: int = DIM) -> list[float]:
    """Counts of words by ``md5(word) mod dim``, scaled to length 1; zeros for null, empty and blank texts."""
    v = [0.0] * dim
    for s, x in hash_slots(text, dim).items():
        v[s] = x
    return v


def hash_distance(text: Column, query: str, dim: int = DIM) -> Column:
    """Squared distance between the hash embeddings of a column and of one text, without building the vectors: 2 - 2 cos,
    1 if one of the two has no words."""
    wanted = hash_slots(query, dim)

    def one(t: str | None) -> float:
        has = hash_slots(t if isinstance(t, str) else None, dim)
        return bool(wanted) + bool(has) - 2 * sum(x * has.get(s, 0.0) for s, x in wanted.items())

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one).astype(float)

    return run(text)


def hash_embedding(text: Column, dim: int = DIM) -> Column:
    """``embed_hash`` of a column, in Arrow batches: filling 384 places by lambdas costs the words times 384."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: embed_hash(t if isinstance(t, str) else None, dim))

    return run(text)


def vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _sum(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str = "l2sq") -> Column:
    """``l2sq`` squared Euclidean, ``cosine`` 1 - cos, ``ip`` 1 - inner product; null if a vector or component is."""
    if metric == "l2sq":
        return _sum(a, b, lambda x, y: (x - y) * (x - y))
    dot = _sum(a, b, lambda x, y: x * y)
    if metric == "ip":
        return 1 - dot
    if metric == "cosine":
        norms = F.sqrt(_sum(a, a, lambda x, y: x * y)) * F.sqrt(_sum(b, b, lambda x, y: x * y))
        return 1 - F.when(norms > 0, dot / norms).otherwise(0.0)
    raise ValueError(f"unknown metric: {metric!r}")


def similarity(dist: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - dist)
