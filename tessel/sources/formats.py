"""Sinks and loaders of other formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def retrieval_benchmark(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus (``id, title, text``), queries (``query, text``) and judgements (``query, item, grade``) of a folder with
    ``corpus.jsonl``, ``queries.jsonl`` and ``qrels/test.tsv``."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl")
    queries = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl")
    judged = spark.read.option("header", True).option("sep", "\t").schema("`query-id` string, `corpus-id` string, score int").csv(f"{folder}/qrels/test.tsv")
    return (
        corpus.withColumnRenamed("_id", "id"),
        queries.withColumnRenamed("_id", "query"),
        judged.select(F.col("query-id").alias("query"), F.col("corpus-id").alias("item"), F.col("score").alias("grade")),
    )
