"""Differences between two copies of a table (problem 1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLANKS = '[ \\t\\r\\n"]+'


def normal_table_name(c: Column) -> Column:
    """Lower case, without surrounding blanks and double quotes and without one leading ``main.``."""
    strip = lambda x: F.regexp_replace(x, f"^{_BLANKS}|{_BLANKS}$", "")
    return strip(F.regexp_replace(strip(F.lower(c)), r'^main[ \t"]*\.', ""))


def latest_by(df: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str]) -> DataFrame:
    """One row per key: the one with the highest ``order``. A null order is lowest; of rows equal in it the one
    with the greatest fields counts, so that the choice is the same in every run. Pre-aggregates before the shuffle,
    so a key holding much of the table costs one row per task."""
    best = F.max(F.struct(F.col(order).alias("_o"), *[F.col(f) for f in fields])).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{f}").alias(f) for f in fields])


def table_diff(
    live: DataFrame,
    replica: DataFrame,
    keys: Sequence[str],
    fields: Sequence[str],
    *,
    only_left: str = "only_live",
    only_right: str = "only_replica",
) -> DataFrame:
    """Rows ``(*keys, diff, left_value, right_value)`` in which the two copies disagree.

    EXCEPT ALL in both directions leaves two residues; a full join of these by key tells one-sided keys from
    keys whose fields differ, one output row per differing field. Agreeing rows never reach the join.

    Defined cases: null equals only null, in keys and fields; equal rows repeated within one copy are one row;
    where a copy has several different rows of one key, each is held against each of the other copy's;
    an empty copy makes every key of the other one-sided; columns other than keys and fields are ignored.
    """
    cols = [*keys, *fields]
    a, b = live.select(*cols), replica.select(*cols)
    left = a.exceptAll(b).distinct().select(*[F.col(c).alias(f"l_{c}") for c in cols], F.lit(True).alias("_l"))
    right = b.exceptAll(a).distinct().select(*[F.col(c).alias(f"r_{c}") for c in cols], F.lit(True).alias("_r"))
    on = None
    for k in keys:
        e = F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}"))
        on = e if on is None else on & e
    joined = left.join(right, on, "full_outer")
    text = lambda c: F.col(c).cast("string")
    entry = lambda name, lv, rv: F.struct(F.lit(name).alias("diff"), lv.alias("left_value"), rv.alias("right_value"))
    none = F.lit(None).cast("string")
    per_field = F.array(
        *[F.when(~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")), entry(f, text(f"l_{f}"), text(f"r_{f}"))) for f in fields]
    )
    found = (
        F.when(F.col("_r").isNull(), F.array(entry(only_left, none, none)))
        .when(F.col("_l").isNull(), F.array(entry(only_right, none, none)))
        .otherwise(F.filter(per_field, lambda x: x.isNotNull()))
    )
    key = lambda k: F.when(F.col("_l").isNotNull(), F.col(f"l_{k}")).otherwise(F.col(f"r_{k}")).alias(k)
    return joined.select(*[key(k) for k in keys], F.explode(found).alias("_d")).select(*keys, "_d.*")


def sync_diff(live: DataFrame, replica: DataFrame) -> DataFrame:
    """``table_diff`` of two copies of the mirror's sync state, per store and normalised table name."""
    fields = ["synced_count", "pk_column", "synced_at"]

    def state(df: DataFrame) -> DataFrame:
        named = df.withColumn("table_name", normal_table_name(F.col("table_name"))).filter(F.length("table_name") > 0)
        return latest_by(named, ["store_id", "table_name"], "sync_seq", fields)

    return table_diff(state(live), state(replica), ["store_id", "table_name"], fields)
