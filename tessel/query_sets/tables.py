"""Tables under manifests: writes, definition changes, copies."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.db import Database
from tessel.plans.shared import shared_root
from tessel.query_sets.registry import register
from tessel.sources import formats
from tessel.sources.tables import table

_PARTS = {"p_partkey": "INTEGER PRIMARY KEY", "p_name": "TEXT", "p_size": "INTEGER", "p_retailprice": "REAL"}


def _with_parts(name: str, sql: str, versioned: bool = False, kinds: dict[str, str] | None = None) -> Callable:
    """A query over what a function does to a database with the table ``part``."""

    def wrap(f: Callable[[Database, DataFrame], DataFrame]) -> None:
        @register(name, sql)
        def run(spark: SparkSession, d: str) -> DataFrame:
            db = Database(spark, f"{shared_root(spark)}/db-{uuid.uuid4().hex}")
            parts = table(spark, d, "part").select(F.col("p_partkey"), "p_name", F.col("p_size").cast("long").alias("p_size"), "p_retailprice")
            db.create_table("part", _PARTS | (kinds or {}), versioned=versioned)
            db.append("part", parts)
            return f(db, parts)

    return wrap


@_with_parts("table_append", "SELECT p_partkey, p_name, p_size::BIGINT AS p_size, p_retailprice FROM part")
def table_append(db: Database, _: DataFrame) -> DataFrame:
    return db.store.scan("part")


@_with_parts("table_update", "SELECT p_partkey, CASE WHEN p_partkey = 5 THEN 'renamed' ELSE p_name END AS p_name, p_size::BIGINT AS p_size FROM part")
def table_update(db: Database, _: DataFrame) -> DataFrame:
    db.update("part", 5, {"p_name": "renamed"})
    return db.store.scan("part").select("p_partkey", "p_name", "p_size")


@_with_parts("table_delete", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (3, 4)")
def table_delete(db: Database, _: DataFrame) -> DataFrame:
    db.delete("part", 3)
    db.delete("part", 4)
    return db.store.scan("part").select("p_partkey")


@_with_parts("table_upsert", "SELECT p_partkey, p_name, CASE WHEN p_partkey = 1 THEN 77 ELSE p_size END::BIGINT AS p_size FROM part UNION ALL SELECT -1, 'new', -1")
def table_upsert(db: Database, _: DataFrame) -> DataFrame:
    db.upsert("part", {"p_partkey": 1, "p_size": 77})
    db.upsert("part", {"p_partkey": -1, "p_name": "new"})
    return db.store.scan("part").select("p_partkey", "p_name", F.coalesce("p_size", F.lit(-1)).alias("p_size"))


@_with_parts("table_bulk_change", "SELECT p_partkey, CASE WHEN p_size > 30 THEN 'big' ELSE p_name END AS p_name FROM part WHERE p_size <> 10")
def table_bulk_change(db: Database, parts: DataFrame) -> DataFrame:
    m = db.store.manifest("part")
    fresh = parts.filter("p_size > 30").withColumn("p_name", F.lit("big"))
    db.store.change(m, parts.filter("p_size > 30 or p_size = 10").select("p_partkey"), fresh)
    return db.store.scan("part").select("p_partkey", "p_name")


@_with_parts("table_columns_changed", "SELECT p_partkey AS id, p_name AS name, 'none' AS note FROM part")
def table_columns_changed(db: Database, _: DataFrame) -> DataFrame:
    db.drop_column("part", "p_size")
    db.rename_column("part", "p_name", "name")
    db.add_column("part", "note", "TEXT")
    return db.store.scan("part").select(F.col("p_partkey").alias("id"), "name", F.coalesce("note", F.lit("none")).alias("note"))


@_with_parts("table_rolled_back", "SELECT p_partkey, p_name FROM part", versioned=True)
def table_rolled_back(db: Database, _: DataFrame) -> DataFrame:
    db.checkpoint("part", "start")
    db.update("part", 2, {"p_name": "x"})
    db.delete("part", 3)
    db.rollback("part", "start")
    return db.store.scan("part").select("p_partkey", "p_name")


@_with_parts("table_pruned_diff", "SELECT p_partkey::VARCHAR AS pk, CASE WHEN p_partkey = 7 THEN 'removed' ELSE 'changed' END AS change, p_name AS before, CASE p_partkey WHEN 5 THEN 'renamed' WHEN 6 THEN 'again' END AS after FROM part WHERE p_partkey IN (5, 6, 7)", versioned=True)
def table_pruned_diff(db: Database, _: DataFrame) -> DataFrame:
    start = db.checkpoint("part", "start")["seq"]
    db.update("part", 5, {"p_name": "renamed"})
    db.prune("part", checkpoint="start")
    db.update("part", 6, {"p_name": "again"})
    db.delete("part", 7)
    name = lambda c: F.get_json_object(c, "$.p_name").alias(c)
    return db.changes("part", start).select("pk", "change", name("before"), name("after"))


@_with_parts("table_pruned_import_rollback", "SELECT p_partkey, p_name FROM part", versioned=True)
def table_pruned_import_rollback(db: Database, _: DataFrame) -> DataFrame:
    start = db.checkpoint("part", "start")["seq"]
    db.prune("part", checkpoint="start")
    db.update("part", 2, {"p_name": "x"})
    db.export(f"{db.store.root}-out")
    db.delete("part", 3)
    db.import_(f"{db.store.root}-out")
    db.rollback("part", at_seq=start)
    return db.store.scan("part").select("p_partkey", "p_name")


@_with_parts("table_sql", "SELECT p_size::BIGINT AS p_size, count(*) AS n FROM part GROUP BY 1")
def table_sql(db: Database, _: DataFrame) -> DataFrame:
    rows = db.olap.query("SELECT p_size, count(*) AS n FROM part GROUP BY p_size")
    return db.spark.createDataFrame([(r["p_size"], r["n"]) for r in rows], "p_size long, n long")


@_with_parts("table_export_import", "SELECT p_partkey, p_name, p_retailprice FROM part")
def table_export_import(db: Database, _: DataFrame) -> DataFrame:
    db.export(f"{db.store.root}-out")
    db.delete("part", 1)
    db.import_(f"{db.store.root}-out")
    return db.store.scan("part").select("p_partkey", "p_name", "p_retailprice")


@_with_parts("table_backup_restore", "SELECT p_partkey, p_name FROM part")
def table_backup_restore(db: Database, _: DataFrame) -> DataFrame:
    db.backup(f"{db.store.root}-copy")
    db.delete("part", 1)
    db.restore(f"{db.store.root}-copy")
    return db.store.scan("part").select("p_partkey", "p_name")


@_with_parts("table_pruned", "SELECT p_partkey::VARCHAR AS pk, CASE WHEN p_partkey = 2 THEN 'x' ELSE p_name END AS name, (SELECT count(*) FROM part) AS dropped FROM part", versioned=True)
def table_pruned(db: Database, _: DataFrame) -> DataFrame:
    db.checkpoint("part", "start")
    db.update("part", 2, {"p_name": "x"})
    dropped = db.prune("part", checkpoint="start")["pruned"]
    return db._state("part", None).select("pk", F.get_json_object("row_json", "$.p_name").alias("name"), F.lit(dropped).cast("long").alias("dropped"))


@_with_parts("table_archive", "SELECT 'current' AS part, p_partkey::VARCHAR AS pk, p_name AS name FROM part WHERE p_partkey <> 1 UNION ALL SELECT 'history', p_partkey::VARCHAR, p_name FROM part UNION ALL SELECT 'history', '1', p_name FROM part WHERE p_partkey = 1", versioned=True)
def table_archive(db: Database, _: DataFrame) -> DataFrame:
    db.delete("part", 1)
    out = db.archive("part", f"{db.store.root}-archive", "parquet")
    now = db.spark.read.parquet(out["current"]).select(F.lit("current").alias("part"), F.col("p_partkey").cast("string").alias("pk"), F.col("p_name").alias("name"))
    then = db.spark.read.parquet(out["history"]).select(F.lit("history").alias("part"), "pk", F.get_json_object("row_json", "$.p_name").alias("name"))
    return now.unionByName(then)


@_with_parts("table_care", "SELECT * FROM (SELECT count(*) - 1 AS n FROM part), (VALUES ('health before', 'drift'), ('health after', 'ok'), ('health lost', 'broken'), ('integrity', 'ok'), ('integrity lost', 'corrupt')) t(what, status)")
def table_care(db: Database, _: DataFrame) -> DataFrame:
    """States of a table before and after it is indexed, and with a file lost; rows by ``stats`` and ``reindex``."""
    db.delete("part", 4)
    said = {"health before": db.health("part")["status"]}
    rows = db.reindex("part")
    said |= {"health after": db.health("part")["status"], "integrity": db.check_integrity("part")["status"]}
    assert db.stats()["part"]["rows"] == rows and db.vacuum() > 0
    m = db.store.manifest("part")
    m.files = [*m.files, f"{m.files[0]}-lost"]
    db.store.files.write(db.store._path("part"), json.dumps(asdict(m)))
    said |= {"health lost": db.health("part")["status"], "integrity lost": db.check_integrity("part")["status"]}
    return db.spark.createDataFrame([(k, v, rows) for k, v in said.items()], "what string, status string, n long")


@_with_parts(
    "table_vectors_follow_rows",
    """SELECT p_partkey, count(DISTINCT ('0x' || md5(w))::UHUGEINT % 384) AS slots FROM (SELECT p_partkey, unnest(string_split(lower(n), ' ')) AS w FROM
(SELECT p_partkey, CASE WHEN p_partkey = 5 THEN 'one two three' ELSE p_name END AS n FROM part WHERE p_partkey <> 6)) WHERE w <> '' GROUP BY 1""",
    kinds={"p_name": "LONGTEXT"},
)
def table_vectors_follow_rows(db: Database, _: DataFrame) -> DataFrame:
    """Stored vectors after an update and a delete of rows that had some."""
    db.process_journal(1 << 40)
    db.update("part", 5, {"p_name": "one two three"})
    db.delete("part", 6)
    texts = db._index(db.store.manifest("part"), "p_name").texts()
    return texts.select(F.col("pk").alias("p_partkey"), F.size("slots").cast("long").alias("slots"))


@_with_parts("table_search", "SELECT p_partkey FROM part WHERE p_partkey % 1000 = 7 OR p_partkey = 5 ORDER BY p_partkey LIMIT 50", kinds={"p_name": "LONGTEXT"})
def table_search(db: Database, parts: DataFrame) -> DataFrame:
    """Rows whose text was set to a word that no other row has, found by the index that follows the table."""
    db.process_journal(1 << 40)
    m = db.store.manifest("part")
    some = parts.filter("p_partkey % 1000 = 7 or p_partkey = 5")
    db.store.change(m, some.select("p_partkey"), some.withColumn("p_name", F.lit("zyzzyva")))
    hits = db.search("part", "p_name", "zyzzyva", "keyword", limit=50)
    same = db.search_columns("part", "zyzzyva", limit=50)
    assert {r["p_partkey"] for r in hits} <= {r["p_partkey"] for r in same}
    return db.spark.createDataFrame([(r["p_partkey"],) for r in hits], "p_partkey long")


@_with_parts("graph_by_rules", "SELECT 'part:' || p_partkey AS source_id, 'sizes:' || p_size AS target_id, 'has' AS type, p_name AS label FROM part WHERE p_partkey <> 9 AND p_size <= 40")
def graph_by_rules(db: Database, _: DataFrame) -> DataFrame:
    """Nodes and edges that rules derive from two tables, synchronised again after a row went."""
    db.create_table("sizes", {"id": "INTEGER PRIMARY KEY"})
    db.append("sizes", db.spark.range(1, 41))
    db.graph.register_entity_node("part", "part", label_template="{p_name}")
    db.graph.register_entity_node("sizes", "size")
    db.graph.register_edge_rule("part", "sizes", "p_size", "has")
    db.graph.sync_graph_nodes()
    db.delete("part", 9)
    said = db.graph.sync_graph_nodes()
    assert (said["created"], said["updated"], said["removed"]) == (0, 0, 1)
    n = db.graph.nodes.select(F.col("id").alias("source_id"), "label")
    return db.graph.edges.select("source_id", "target_id", "type").join(n, "source_id")


@_with_parts("graph_edges_changed", "SELECT 'a' AS source_id, 'b' AS target_id, 'x' AS type, 0.25::DOUBLE AS weight, '{\"k\":1,\"z\":2}' AS properties UNION ALL SELECT 'b', 'c', 'x', 0.5, '{}'")
def graph_edges_changed(db: Database, _: DataFrame) -> DataFrame:
    """Edges added, added again under the same ends and type, updated, deleted."""
    g = db.graph
    g.add_nodes([{"id": x, "label": x} for x in "abc"])
    g.add_edges([{"source_id": "a", "target_id": "b", "type": "x", "weight": 0.9}, {"source_id": "b", "target_id": "c", "type": "x", "weight": 0.5, "properties": {}}])
    gone = g.add_edge(None, "c", "a", "x")
    again = g.add_edge(None, "a", "b", "x", 0.7, properties={"k": 1})
    g.update_edge(again, {"properties": {"z": 2}, "weight": 0.25})
    g.delete_edge(gone)
    return g.edges.select("source_id", "target_id", "type", "weight", "properties")


@register("source_retrieval_benchmark", "SELECT doc_id::VARCHAR AS id, text, coalesce(length(text), 0)::BIGINT AS grade FROM documents")
def source_retrieval_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """The documents as a retrieval benchmark's folder (corpus, queries, judgements), loaded again and joined."""
    at = f"{shared_root(spark)}/benchmark-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("_id"), "text")
    formats.write_jsonl(docs.select("_id", F.lit("").alias("title"), "text"), f"{at}/corpus.jsonl")
    formats.write_jsonl(docs.select(F.concat(F.lit("q"), "_id").alias("_id"), "text"), f"{at}/queries.jsonl")
    judged = docs.select(F.concat(F.lit("q"), "_id").alias("query-id"), F.col("_id").alias("corpus-id"), F.coalesce(F.length("text"), F.lit(0)).alias("score"))
    judged.write.option("header", True).option("sep", "\t").csv(f"{at}/qrels/test.tsv")
    corpus, queries, grades = formats.retrieval_benchmark(spark, at)
    return corpus.join(grades, corpus["id"] == grades["item"]).join(queries.select("query"), "query").select("id", "text", F.col("grade").cast("long").alias("grade"))


@register("sink_jsonl", "SELECT id, doc_id, content FROM doc_chunks")
def sink_jsonl(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_root(spark)}/sink-{uuid.uuid4().hex}"
    formats.write_jsonl(table(spark, d, "doc_chunks").select("id", "doc_id", "content"), path)
    return spark.read.schema("id long, doc_id string, content string").json(path)


@register("sink_parquet", "SELECT id, doc_id, content FROM doc_chunks")
def sink_parquet(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_root(spark)}/sink-{uuid.uuid4().hex}"
    formats.write_parquet(table(spark, d, "doc_chunks").select("id", "doc_id", "content"), path)
    return spark.read.parquet(path)
