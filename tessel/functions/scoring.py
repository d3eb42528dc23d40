"""Scores: recency, its blend and measures of ranked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def recency(ts: Column, now: Column) -> Column:
    """``1 / (1 + days / 30)`` in whole days; times ahead count as now, null and unusable ones 0."""
    moment = ts.try_cast("timestamp")
    days = F.greatest(F.floor((F.unix_micros(now) - F.unix_micros(moment)) / 86_400_000_000), F.lit(0))
    return F.when(moment.isNull(), 0.0).otherwise(1 / (1 + days / 30))


def blended(score: Column, fresh: Column, weight: float) -> Column:
    return score * (1 - weight) + fresh * weight


def ranking_metrics(ranked: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """Per query ``ndcg, recall, precision, mrr`` at ``k``.

    ``ranked``: ``query, item, rank`` (from 1); ``judged``: ``query, item, grade`` (above 0 = relevant). Queries are those
    judged; one without results scores 0, one without relevant items has null recall and nDCG.
    """
    good = judged.filter("grade > 0")
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    w = Window.partitionBy("query").orderBy(F.desc("grade"), "item")
    # only the first k of each query matter; the window drops the rest before anything is summed
    ideal = good.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= k).groupBy("query").agg(F.sum(gain / F.log2(F.col("i") + 1)).alias("idcg"))
    relevant = good.groupBy("query").agg(F.count("*").alias("n_rel"))
    hits = ranked.filter(F.col("rank") <= k).join(good, ["query", "item"]).groupBy("query").agg(
        F.sum(gain / F.log2(F.col("rank") + 1)).alias("dcg"), F.count("*").alias("n_hit"), F.min("rank").alias("first")
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return (
        judged.select("query").distinct().join(relevant, "query", "left").join(ideal, "query", "left").join(hits, "query", "left")
        .select(
            "query", (zero(F.col("dcg")) / F.col("idcg")).alias("ndcg"), (zero(F.col("n_hit")) / F.col("n_rel")).alias("recall"),
            (zero(F.col("n_hit")) / k).alias("precision"), zero(1 / F.col("first")).alias("mrr"),
        )
    )


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """One row: the means over all queries of ``ranking_metrics``, a query without relevant items left out where it has none."""
    return metrics.agg(*[F.avg(c).alias(c) for c in ("ndcg", "recall", "precision", "mrr")], F.count("*").alias("queries"))


def set_recall(ranked: DataFrame, expected: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query, recall`` of each of ``queries``: the share of its expected items (``query, item``) among the first ``k``
    ranked; 1 where none is expected."""
    want = expected.select("query", "item").distinct()
    total = want.groupBy("query").agg(F.count("*").alias("n"))
    found = ranked.filter(F.col("rank") <= k).select("query", "item").distinct().join(want, ["query", "item"]).groupBy("query").agg(F.count("*").alias("f"))
    j = queries.select("query").distinct().join(total, "query", "left").join(found, "query", "left")
    return j.select("query", F.when(F.col("n").isNull(), 1.0).otherwise(F.coalesce("f", F.lit(0)) / F.col("n")).alias("recall"))
