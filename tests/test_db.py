import asyncio

import pytest

from tessel import types
from tessel.db import Database
from tessel.functions import vectors
from tessel.sources.files import Files
from tessel.types import Column, IntegrityError


@pytest.fixture()
def db(spark, tmp_path):
    d = Database(spark, f"file://{tmp_path}/db")
    yield d
    d.close()


CONTACTS = {"first_name": "TEXT", "last_name": "TEXT", "notes": "LONGTEXT", "clv": "REAL", "is_active": "BOOLEAN", "extra": "JSON"}


def test_rows(db):
    db.create_table("contacts", CONTACTS)
    a, b = db.insert_batch("contacts", [{"first_name": "Ann", "clv": 3, "is_active": 1, "extra": {"a": [1]}, "unknown": 1}, {"first_name": "Bob", "notes": ""}])
    assert (a, b) == (1, 2) and db.insert("contacts", {"first_name": "Cy"}) == 3
    assert db.get("contacts", 1) == {"id": 1, "first_name": "Ann", "last_name": None, "notes": None, "clv": 3.0, "is_active": True, "extra": '{"a": [1]}'}
    assert db.update("contacts", 2, {"notes": "hi"}) and db.get("contacts", 2)["notes"] == "hi" and not db.update("contacts", 99, {"notes": "x"})
    assert db.delete("contacts", 3) and not db.delete("contacts", 3) and db.get("contacts", 3) is None
    assert db.insert("contacts", {"first_name": "Di"}) == 4  # never again 3
    assert db.upsert("contacts", {"id": 4, "last_name": "Z"}) == 4 and db.get("contacts", 4)["first_name"] == "Di"
    assert [r["id"] for r in db.query("contacts", "first_name <> ?", ("Ann",), "first_name DESC")] == [4, 2]
    assert db.count("contacts") == 3 and db.count("contacts", "clv > ?", (1,)) == 1
    assert set(db.get_many("contacts", [1, 4, 77])) == {1, 4}
    assert db.read_query("SELECT count(*) AS n FROM contacts") == [{"n": 3}] == db.olap.query("select count(*) n from contacts")
    assert db.raw_query("SELECT first_name FROM contacts WHERE id = ?", (1,)) == [{"first_name": "Ann"}]
    with pytest.raises(PermissionError):
        db.read_query("WITH a AS (SELECT 1) INSERT INTO contacts SELECT * FROM a")
    assert db.row_to_metadata("contacts", db.get("contacts", 1)) == {"id": 1, "first_name": "Ann", "clv": 3.0, "is_active": True}
    with pytest.raises(IntegrityError):
        db.insert("contacts", {"id": 1})
    with pytest.raises(ValueError):
        db.query("contacts", order_by="first_name; drop table x")
    assert db.health("contacts")["status"] == "drift" and db.process_journal() == 3 and db.health("contacts")["status"] == "ok" and db.check_integrity("contacts") == {"status": "ok", "issues": []}
    assert db.stats()["contacts"]["rows"] == 3 and db.reindex("contacts") == 3
    assert db.vacuum() > 0 and db.count("contacts") == 3
    assert asyncio.run(db.aget("contacts", 1))["first_name"] == "Ann"
    with pytest.raises(AttributeError):
        db.anothing  # noqa: B018


def test_definition(db):
    db.create_table("kv", {"key": "TEXT PRIMARY KEY", "val": Column("TEXT")})
    db.insert("kv", {"key": "", "val": "empty"})
    assert db.get("kv", "")["val"] == "empty"
    db.add_column("kv", "note", "LONGTEXT")
    assert db.get("kv", "") == {"key": "", "val": "empty", "note": None}
    db.rename_column("kv", "val", "value")
    db.drop_column("kv", "note")
    assert db.get_schema("kv") == {"key": "TEXT PRIMARY KEY", "value": "TEXT"} and db.list_tables() == ["kv"]
    assert db.update("kv", "", {"key": "k2"}) and db.get("kv", "") is None and db.get("kv", "k2")["value"] == "empty"
    db.create_table("kv", {"more": "INTEGER"})
    assert "more" in db.get_schema("kv") and "value" in db.get_schema("kv")
    for bad in (lambda: db.create_table("x_fts_y", {"a": "TEXT"}), lambda: db.create_table("x__history", {"a": "TEXT"}), lambda: db.create_table("y", {"id": "TEXT"}), lambda: db.drop_column("kv", "key"), lambda: db.create_table("1x", {})):
        with pytest.raises(ValueError):
            bad()


def test_indexes_follow_the_table(db):
    db.create_table("t", {"id": "TEXT PRIMARY KEY", "a": "TEXT", "b": "LONGTEXT"})
    db.insert_batch("t", [{"id": f"k{i}", "a": f"word{i}", "b": "common text"} for i in range(4)])
    assert db.journal_status("t") == {"pending": 4, "failed": 0, "done": 0} and db.health("t")["status"] == "drift"
    assert [r["id"] for r in db.search("t", "a", "word2", "keyword")] == ["k2"]
    assert db.journal_status() == {"pending": 4, "failed": 0, "done": 0} and db.process_journal() == 4  # the other column
    assert db.journal_status("t") == {"pending": 0, "failed": 0, "done": 4} and db.health("t") == {"status": "ok", "rows": 4, "indexed": {"a": 4, "b": 4}, "pending": 0, "missing_files": []}
    db.update("t", "k2", {"a": "other"})
    db.delete("t", "k3")
    assert db.search("t", "a", "word2", "keyword") == [] == db.search("t", "a", "word3", "keyword") and [r["id"] for r in db.search("t", "a", "other", "keyword")] == ["k2"]
    assert db.search("t", "b", "common", "keyword", limit=9)[0]["id"] == "k0"
    for i in range(10):  # more files than segments
        db.insert("t", {"id": f"n{i}", "a": f"word{i}", "b": None})
        db.process_journal()
    assert {r["id"] for r in db.search("t", "a", "word1", "keyword")} == {"k1", "n1"} and len(db.store.manifest("t").indexes["a"]) <= 9
    db.update("t", "n4", {"a": "x"})
    got = db.reconcile("t")
    assert got["missing_added"] >= 1 and db.health("t")["status"] == "ok" and db.reconcile("t") == {"ghosts_deleted": 0, "missing_added": 0, "metadata_updated": 0}
    assert db.vacuum() > 0 and {r["id"] for r in db.search("t", "a", "word1", "keyword")} == {"k1", "n1"}
    assert db.reindex("t") == 13 and {r["id"] for r in db.search("t", "a", "word1", "keyword")} == {"k1", "n1"}


NOTES = [
    # id, owner, size, subject, body, day
    ("n1", "kim", 4, "ferry timetable spring", "the harbour crêpe stall opens at nine", "2025-11-02T00:00:00Z"),
    ("n2", "lou", 55, "ferry timetable autumn", "dredging schedule", "2026-02-20T00:00:00Z"),
    ("n3", "kim", 21, "dredging invoice", "harbour dredging schedule and tides", None),
    ("n4", "lou", 70, "tides invoice", None, "someday"),
    ("n5", "ada", 2, "bees", "hives need new frames", None),
    ("n6", "ada", 3, "kiln", "glaze recipes for stoneware", None),
    ("n7", "ada", 5, "", "", None),
]


@pytest.mark.parametrize("fn", [None, vectors.embed_hash])
def test_search(spark, tmp_path, fn):
    db = Database(spark, f"file://{tmp_path}/s", fn)
    db.create_table("notes", {"id": "TEXT PRIMARY KEY", "owner": "TEXT", "size": "INTEGER", "subject": "TEXT", "body": "LONGTEXT", "day": "TEXT"})
    db.insert_batch("notes", [dict(zip(("id", "owner", "size", "subject", "body", "day"), r)) for r in NOTES])
    ids = lambda rows: [r["id"] for r in rows]
    assert ids(db.search("notes", "subject", "timetable", "keyword", where={"owner": "kim"})) == ["n1"]
    assert ids(db.search("notes", "subject", "invoice", "keyword", where={"size": {"$gte": 50}})) == ["n4"]
    assert ids(db.search("notes", "body", "CREPE", "keyword")) == ["n1"] and db.search("notes", "subject", "ferry", "semantic") == []
    assert db.search("notes", "size", "x") == [] == db.search("nothing", "x", "y")
    assert ids(db.search("notes", "subject", limit=2)) == ["n7", "n6"]
    hits = db.search("notes", "body", "dredging schedule")
    assert hits[0]["id"] == "n2" and hits[0]["_search_mode"] == "hybrid" and 0 < hits[0]["_score"] <= 1 / 61
    hits = db.search("notes", "body", "dredging schedule", types.SEMANTIC)
    assert hits[0]["id"] == "n2" and hits[0]["_score"] == pytest.approx(1)
    assert ids(db.search("notes", "body", "harbour", recency_weight=0.9, recency_column="day", now="2026-02-21T00:00:00Z"))[0] == "n2"
    assert set(ids(db.search_all("notes", "dredging", limit=3))) >= {"n3", "n2"}
    assert ids(db.search_columns("notes", "tides", where={"owner": "kim"}))[0] == "n3"
    with pytest.raises(ValueError):
        db.search("notes", "subject", "x", "fuzzy")
    with pytest.raises(types.EmbeddingModelError):
        Database(spark, f"file://{tmp_path}/s", fn, "another")
    assert Database(spark, f"file://{tmp_path}/s", fn, "another", force_model=True).count("notes") == 7


def test_history(db, spark):
    db.create_table("docs", {"id": "TEXT PRIMARY KEY", "body": "TEXT"}, versioned=True)
    db.insert("docs", {"id": "a", "body": "v1"})
    db.update("docs", "a", {"body": "v2"})
    db.insert_batch("docs", [{"id": "c", "body": "y"}, {"id": "b", "body": "x"}])
    assert db.checkpoint("docs", "here") == {"table": "docs", "label": "here", "seq": 4}
    db.delete("docs", "a")
    db.update("docs", "b", {"body": "x2"})
    h = db.history("docs", "a")
    assert [r["_op"] for r in h] == ["insert", "update", "delete"] and h[0]["prev_hash"] == "0" * 64 and '"v2"' in h[2]["row_json"]
    assert [r["_seq"] for r in db.log("docs", 3)] == [6, 5, 4]
    assert db.as_of("docs", 1) == [{"id": "a", "body": "v1"}] and db.as_of("docs", 0) == []
    assert db.diff("docs", 4) == {"added": [], "removed": [{"id": "a", "body": "v2"}], "changed": [{"before": {"id": "b", "body": "x"}, "after": {"id": "b", "body": "x2"}}]}
    assert db.verify_chain("docs") == {"valid": True, "checked": 6, "first_broken_seq": None}
    assert db.rollback("docs", "here") == {"table": "docs", "seq": 4, "changes": 2} and db.rollback("docs", at_seq=8)["changes"] == 0
    assert {r["id"]: r["body"] for r in db.query("docs")} == {"a": "v2", "b": "x", "c": "y"}
    assert [(r["_op"], r["pk"]) for r in reversed(db.log("docs", 2))] == [("insert", "a"), ("update", "b")]
    assert db.verify_chain("docs")["valid"] and db.checkpoints("docs") == {"here": 4}
    with pytest.raises(ValueError):
        db.prune("docs", 6)
    assert db.prune("docs", checkpoint="here") == {"pruned": 4, "anchor_seq": 4} and db.verify_chain("docs")["valid"]
    assert {r["id"]: r["body"] for r in db.as_of("docs", 4)} == {"a": "v2", "b": "x", "c": "y"}
    assert db.rollback("docs", "here")["changes"] == 0
    assert {r["id"] for r in db.query("docs")} == {"a", "b", "c"}
    with pytest.raises(ValueError):
        db.add_column("docs", "x", "TEXT")
    assert db.is_versioned("docs") and db.check_integrity("docs")["status"] == "ok" == db.check_integrity()["overall"]


def test_rollback_after_prune_keeps_untouched_rows(db):
    db.create_table("docs", {"id": "TEXT PRIMARY KEY", "body": "TEXT"}, versioned=True)
    db.insert_batch("docs", [{"id": f"d{i}", "body": "x"} for i in range(5)])
    db.update("docs", "d0", {"body": "y"})
    assert db.prune("docs", 6)["pruned"] == 5
    db.update("docs", "d1", {"body": "z"})
    assert db.rollback("docs", at_seq=6)["changes"] == 1
    assert {r["id"]: r["body"] for r in db.query("docs")} == {"d0": "y", "d1": "x", "d2": "x", "d3": "x", "d4": "x"}


def test_pruned_history(db, spark, tmp_path):
    db.create_table("docs", {"id": "TEXT PRIMARY KEY", "body": "TEXT"}, versioned=True)
    db.insert_batch("docs", [{"id": f"d{i}", "body": "x"} for i in range(4)])
    db.insert("docs", {"id": "d4", "body": "x"})
    assert db.prune("docs", 5)["pruned"] == 4
    db.update("docs", "d1", {"body": "z"})
    assert db.diff("docs", 5, 6) == {"added": [], "removed": [], "changed": [{"before": {"id": "d1", "body": "x"}, "after": {"id": "d1", "body": "z"}}]}
    for before in (lambda: db.as_of("docs", 2), lambda: db.diff("docs", 3, 6), lambda: db.rollback("docs", at_seq=3)):
        with pytest.raises(ValueError, match="pruned"):
            before()
    db.export(f"file://{tmp_path}/out")
    db.import_(f"file://{tmp_path}/out")
    assert len(db.as_of("docs", 4)) == 4 and len(db.as_of("docs", 5)) == 5 and db.verify_chain("docs")["valid"]
    assert db.rollback("docs", at_seq=5)["changes"] == 1 and {r["id"]: r["body"] for r in db.query("docs")} == {f"d{i}": "x" for i in range(5)}


def test_kept_texts(spark, tmp_path):
    f = Files(spark)
    at = f"file://{tmp_path}/a/x.json"
    assert not f.has(at)
    for i in range(4):
        f.write(at, f"{i}")
        assert f.read(at) == f"{i}" and f.kept(f"file://{tmp_path}/a") == ["x.json"]
    (tmp_path / "a" / "_x.json-aside").write_text("half written")
    assert f.read(at) == "3" and len(f._versions(at)) == 2  # the one before stays for those who read it


def test_versioning_switched_on_once(db):
    db.create_table("t", {"id": "TEXT PRIMARY KEY", "v": "TEXT"})
    db.insert("t", {"id": "a", "v": "1"})
    db.create_table("t", {"id": "TEXT PRIMARY KEY", "v": "TEXT"}, versioned=True)
    db.create_table("t", {"id": "TEXT PRIMARY KEY", "v": "TEXT"}, versioned=True)
    assert [r["_op"] for r in db.log("t")] == ["insert"] and db.verify_chain("t")["valid"]


def test_copies(db, spark, tmp_path):
    db.create_table("docs", {"id": "TEXT PRIMARY KEY", "body": "LONGTEXT"}, versioned=True)
    db.insert_batch("docs", [{"id": "a", "body": "CREATE TRIGGER x_fts_y"}, {"id": "b", "body": None}])
    db.backup(f"file://{tmp_path}/copy")
    db.export(f"file://{tmp_path}/out")
    out = db.archive("docs", f"file://{tmp_path}/arch", "jsonl")
    assert spark.read.json(out["history"]).count() == 2 == out["rows"] == out["history_rows"]
    db.delete("docs", "a")
    db.restore(f"file://{tmp_path}/copy")
    assert db.count("docs") == 2 and db.verify_chain("docs")["valid"]
    db.delete("docs", "b")
    assert db.import_(f"file://{tmp_path}/out").count("docs") == 1
    assert db.get("docs", "a")["body"] == "CREATE TRIGGER x_fts_y" and db.count("docs") == 2 and len(db.history("docs", "b")) == 1


def test_graph(db):
    g = db.graph
    g.add_nodes([{"id": x, "label": x.upper(), "properties": {"k": 1}} for x in "abcde"])
    e = g.add_edge(None, "a", "b", weight=0.9)
    g.add_edges([{"source_id": "b", "target_id": "c", "weight": 0.8}, {"source_id": "c", "target_id": "d", "weight": 0.7}])
    got = g.traverse("a", 3)
    assert [(r["node_id"], r["depth"], r["path"]) for r in got] == [("b", 1, "a>b"), ("c", 2, "a>b>c"), ("d", 3, "a>b>c>d")] and [r["cum_cost"] for r in got] == pytest.approx([0.1, 0.3, 0.6])
    assert g.neighbors("b")[0] == {"node": {"id": "a", "label": "A", "type": "node", "properties": {"k": 1}}, "edge": {"id": e, "type": "relates_to", "weight": 0.9, "source_id": "a", "target_id": "b", "properties": {}}}
    assert [r["node"]["id"] for r in g.neighbors("b", "out")] == ["c"]
    assert sorted(map(sorted, g.connected_components())) == [["a", "b", "c", "d"], ["e"]]
    assert g.shortest_path("a", "d") == ["a", "b", "c", "d"] and g.shortest_path("d", "a") is None and g.shortest_path("a", "a") == ["a"]
    assert sum(g.pagerank().values()) == pytest.approx(1)
    with pytest.raises(ValueError):
        g.pagerank({"zz": 1.0})
    assert g.betweenness_centrality() == pytest.approx({"a": 0, "b": 1 / 3, "c": 1 / 3, "d": 0, "e": 0})
    assert set().union(*g.community_detect()) == set("abcde") and {"e"} in g.community_detect()
    with pytest.raises(IntegrityError):
        g.add_edge(None, "a", "nowhere")
    assert g.update_edge(e, {"properties": {"why": "x"}, "weight": 0.1, "valid_until": "2020-01-01"}) and g.get_edge(e)["weight"] == 0.1
    assert g.decay_edges("2026-01-01") == 1 and g.get_edge(e) is None
    assert g.update_node("a", {"properties": {"z": 2}, "label": "new"}) and g.get_node("a")["label"] == "new" and '"z"' in g.get_node("a")["properties"] and '"k"' in g.get_node("a")["properties"]
    assert g.delete_node("c") and len(g.get_edges()) == 0 and len(g.list_nodes()) == 4 and not g.delete_node("c")


def test_rules_and_graph_search(db):
    db.create_table("docs", {"id": "TEXT PRIMARY KEY", "body": "LONGTEXT", "ref": "TEXT"})
    db.insert_batch("docs", [{"id": "d1", "body": "graph database", "ref": None}, {"id": "d2", "body": "river walk", "ref": "d1"}, {"id": "d3", "body": "soup", "ref": None}])
    g = db.graph
    assert g.register_entity_node("docs", "doc", "id", "{id}: {body}")
    assert g.register_edge_rule("docs", "docs", edge_type="refers", source_column="ref", target_column="id")
    assert g.sync_graph_nodes() == {"created": 3, "updated": 0, "removed": 0, "edges": 1}
    assert [(r["source_id"], r["target_id"]) for r in g.get_edges()] == [("docs:d2", "docs:d1")] and g.get_node("docs:d1")["label"] == "d1: graph database"
    db.update("docs", "d1", {"body": "graph  database"})
    db.delete("docs", "d3")
    assert g.sync_graph_nodes() == {"created": 0, "updated": 1, "removed": 1, "edges": 1}
    db.insert("docs", {"id": "d3", "body": "soup"})
    hits = g.search_graph_ppr("graph database", min_similarity=0.1)
    assert [h["node_id"] for h in hits] == ["docs:d1", "docs:d2"] and [h["depth"] for h in hits] == [0, 1]
    best = g.search_graph("graph database")[0]
    assert (best["node_id"], best["source_table"], best["neighbors"]) == ("docs:d1", "docs", ["docs:d2"])
