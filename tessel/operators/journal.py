"""The change journal as a queue: what to apply, in which state it is, and incremental mirrors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_op_wins(entries: DataFrame, keys: list[str], order: str, *fields: str) -> DataFrame:
    """Per key the fields of the entry with the highest order: one pre-aggregated maximum, no sort."""
    return entries.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct(order, *fields)).alias("_l")).select(*keys, *[F.col(f"_l.{f}").alias(f) for f in fields])


def status_counts(journal: DataFrame, table: str | None = None) -> DataFrame:
    """``status, entries`` by plain spelling; null status counts as pending."""
    j = journal if table is None else journal.filter(F.col("app_table") == table)
    return j.groupBy(F.coalesce(F.lower(F.trim("status")), F.lit("pending")).alias("status")).agg(F.count("*").alias("entries"))


def pending_counts(journal: DataFrame) -> DataFrame:
    s = F.coalesce(F.lower(F.trim("status")), F.lit("pending"))
    return journal.filter(s == "pending").groupBy("app_table").agg(F.count("*").alias("pending"))


def apply_to_mirror(mirror: DataFrame, changes: DataFrame, key: str, op: str = "op") -> DataFrame:
    """Mirror rows after a batch of changes, one per key: rows of touched keys go, and those not deleted come in anew."""
    touched = changes.select(key).distinct()
    fresh = changes.filter(F.col(op) != "delete").select(*mirror.columns)
    return mirror.join(touched, key, "left_anti").unionByName(fresh)


def reconcile(rows: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """``key, state``: ``ghost`` is indexed but gone, ``missing`` is there but not indexed."""
    a, b = rows.select(key).distinct(), index.select(key).distinct()
    ghosts = b.join(a, key, "left_anti").withColumn("state", F.lit("ghost"))
    return ghosts.unionByName(a.join(b, key, "left_anti").withColumn("state", F.lit("missing")))
