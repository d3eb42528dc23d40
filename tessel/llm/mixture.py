"""Mixing sources to target weights (problem 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm import bpe
from tessel.plans.shared import materialize

SEED = 20240601


def sized(documents: DataFrame, *, tokenizers: str = bpe.TOKENIZERS) -> DataFrame:
    """``doc_id, source, tokens`` of each row, written to the shared folder since the mix reads it twice."""
    key = F.struct("doc_id", "source").alias("_k")
    counted = bpe.encode_column(documents.select(key, "text"), "_k", "text", out="tokens", counts=True, tokenizers=tokenizers)
    return materialize(counted.select("_k.doc_id", "_k.source", "tokens"), "tokens")


def repetition_rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target source: ``source, target_share, max_repeats, documents, tokens, rate, total``.

    ``total`` is the number of tokens of one pass over all documents whose source has a target. A source's rate is
    ``level * target_share * total / tokens``, at most ``max_repeats``; the common level (1 if no cap binds) is the one
    at which the used tokens sum to ``total``. What capped and absent sources can't give is thereby spread over the
    others in proportion to their targets. If all are capped, the total can't be met and every rate is its cap.

    The aggregate has one row per source before anything is ordered; a target table has one row per source, so the
    window runs over that many rows.
    """
    have = sizes.filter(F.col("source").isNotNull()).groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    goal = targets.filter(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    t = goal.join(have, "source", "left").fillna(0, ["documents", "tokens"])
    t = t.withColumn("total", F.sum("tokens").over(Window.partitionBy()))
    usable = (F.col("tokens") > 0) & (F.coalesce("target_share", F.lit(0.0)) > 0) & (F.coalesce("max_repeats", F.lit(0)) > 0)
    t = t.withColumn("_usable", usable)
    cap = F.when(F.col("_usable"), F.col("tokens") * F.col("max_repeats").cast("double"))
    share = F.when(F.col("_usable"), F.col("target_share"))
    t = t.withColumn("_cap", cap).withColumn("_share", share).withColumn("_line", cap / share)
    up = Window.partitionBy("_usable").orderBy("_line", "source")
    down = Window.partitionBy("_usable").orderBy(F.desc("_line"), F.desc("source"))
    full = F.coalesce(F.sum("_cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_ = F.sum("_share").over(down.rowsBetween(Window.unboundedPreceding, 0))
    # the level if this row and all with a higher line stay below their caps
    t = t.withColumn("_level", (F.col("total") - full) / open_)
    fits = F.when(F.col("_usable") & (F.col("_level") <= F.col("_line")), F.struct("_line", "source", "_level"))
    t = t.withColumn("_fit", F.min(fits).over(Window.partitionBy())["_level"])
    used = F.when(F.col("_usable"), F.least(F.coalesce(F.col("_fit") * F.col("_share"), F.col("_cap")), F.col("_cap"))).otherwise(0.0)
    rate = F.when(F.col("_usable"), used / F.col("tokens")).otherwise(0.0)
    return t.withColumn("rate", rate).select("source", "target_share", "max_repeats", "documents", "tokens", "rate", "total")


def copies(key: Column, rate: Column, cap: Column, seed: int = SEED) -> Column:
    """``floor(rate)`` and one more if the document's hash of 53 bits falls below the fraction; never above the cap."""
    draw = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return F.least(F.floor(rate) + (draw < rate - F.floor(rate)).cast("long"), cap.cast("long"))


def mix_plan(sizes: DataFrame, targets: DataFrame, *, seed: int = SEED) -> DataFrame:
    """``doc_id, source, tokens, copies`` of every document whose source has a target."""
    rates = repetition_rates(sizes, targets).select("source", "rate", "max_repeats")
    # one row per target source: the size of the target table, and Catalyst broadcasts it only under its threshold
    return sizes.join(rates, "source").select("doc_id", "source", "tokens", copies(F.col("doc_id"), F.col("rate"), F.col("max_repeats"), seed).alias("copies"))


def mix(documents: DataFrame, targets: DataFrame, *, seed: int = SEED, tokenizers: str = bpe.TOKENIZERS) -> DataFrame:
    """The mix: one row ``doc_id, source, tokens, copy_no`` (from 0) per copy of a document.

    Documents of null or untargeted sources don't take part; null and empty texts have 0 tokens and are drawn like
    others; the choice depends on ``doc_id`` and the seed alone, so repeated runs and other partitionings agree.
    """
    plan = mix_plan(sized(documents, tokenizers=tokenizers), targets, seed=seed).filter("copies > 0")
    return plan.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy_no"))


def mix_report(documents: DataFrame, targets: DataFrame, *, seed: int = SEED, tokenizers: str = bpe.TOKENIZERS) -> DataFrame:
    """Per target source: tokens at hand and used, rate, greatest number of repeats of one document, target and actual
    share. A source without documents has zeros; if nothing is used, actual shares are null."""
    sizes = sized(documents, tokenizers=tokenizers)
    rates = repetition_rates(sizes, targets)
    used = mix_plan(sizes, targets, seed=seed).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("repeats"))
    t = rates.join(used, "source", "left").fillna(0, ["used_tokens", "repeats"])
    everything = F.sum("used_tokens").over(Window.partitionBy())
    return t.select(
        "source", "target_share", "max_repeats", "documents", "tokens", F.round("rate", 6).alias("rate"), "used_tokens", "repeats",
        F.round(F.col("used_tokens") / F.nullif(everything, F.lit(0)), 6).alias("actual_share"),
    )
