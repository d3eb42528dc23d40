"""One object over tables, search, graph, history and analytics."""

from __future__ import annotations

import asyncio
import json
import uuid
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel import types
from tessel.functions import rows as fr
from tessel.operators import graph as g
from tessel.operators import predicates, search, versioning
from tessel.operators.textindex import TextIndex, source
from tessel.plans.readonly import reads_only
from tessel.sources import formats
from tessel.sources.store import Manifest, Store

NODE = "id string, label string, type string, domain string, confidence double, source string, properties string, created_at string, updated_at string"
EDGE = "id string, source_id string, target_id string, type string, weight double, properties string, valid_from string, valid_until string, created_at string"
_ASYNC = ("create_table", "add_column", "drop_column", "rename_column", "insert", "insert_batch", "upsert", "update", "delete", "get", "query", "raw_query", "read_query", "count", "search", "search_all", "health", "reconcile", "process_journal", "close")


#: Columns that a search over all columns leaves out.
_NOT_SEARCHED = frozenset({"rowid", "id", "memory_id", "fact_key", "scope", "project_id", "created_at", "updated_at", "previous_value"})
_BASELINE = "pk string, row_json string"


def _dicts(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


class Database:
    """Tables under ``root``. ``embedding_fn``: text to vector; without one the hash embedding runs inside the plan."""

    def __init__(self, spark: SparkSession, root: str, embedding_fn: Callable[[str], Sequence[float]] | None = None, embedding_model: str | None = None, force_model: bool = False) -> None:
        self.spark, self.store = spark, Store(spark, root)
        self.embedding_fn, self.embedding_model = embedding_fn, embedding_model or ("hash" if embedding_fn is None else "custom")
        for t in self.store.tables():
            m = self.store.manifest(t)
            if m.embedding_model not in (None, self.embedding_model):
                if not force_model:
                    raise types.EmbeddingModelError(f"{t} was embedded by {m.embedding_model}, not {self.embedding_model}")
                m.embedding_model, m.indexes = self.embedding_model, {}
                self.store.save(m)
        self.store.on_change.append(self._view)
        for t in self.store.tables():
            self._view(t)
        self.graph, self.olap = Graph(self), Olap(self)

    def __getattr__(self, name: str) -> Any:
        if name[:1] == "a" and name[1:] in _ASYNC:
            method = getattr(self, name[1:])

            async def run(*args: Any, **kw: Any) -> Any:
                return await asyncio.to_thread(method, *args, **kw)

            return run
        raise AttributeError(name)

    def _view(self, table: str) -> None:
        if not table.startswith("_"):
            self.store.scan(table).createOrReplaceTempView(table)

    # definition

    def create_table(self, table: str, columns: dict[str, Any], versioned: bool = False, hash_chain: bool = True) -> None:
        old = self.store.manifest(table) if table in self.store.tables() else None
        m = self.store.create(table, columns, versioned, hash_chain)
        if old is None and any(t.startswith(types.LONGTEXT) for t in m.columns.values()):
            m.embedding_model = self.embedding_model
            self.store.save(m)
        if old is not None and versioned and not old.versioned:  # once only
            m.versioned, m.hash_chain = True, hash_chain
            self._log(m, self._images(m, self.store.scan(table)).withColumn("_op", F.lit("insert")), ["pk"], "backfill")
            self.store.save(m)

    def add_column(self, table: str, column: str, kind: Any) -> None:
        self.store.add_column(table, column, kind)

    def drop_column(self, table: str, column: str) -> None:
        self.store.drop_column(table, column)

    def rename_column(self, table: str, old: str, new: str) -> None:
        self.store.rename_column(table, old, new)

    def list_tables(self) -> list[str]:
        return [t for t in self.store.tables() if not t.startswith("_")]

    def get_schema(self, table: str) -> dict[str, str]:
        return dict(self.store.manifest(table).columns)

    # rows

    def insert(self, table: str, data: dict, sync: bool = True) -> Any:
        """``sync`` is taken for the sake of the interface: what is written can be read and searched at once anyway."""
        return self.insert_batch(table, [data])[0]

    def insert_batch(self, table: str, data: list[dict], sync: bool = True, author: str | None = None) -> list:
        if not data:
            return []
        m = self.store.manifest(table)
        data = [dict(r) for r in data]
        given = not m.implicit_pk or any(r.get(m.pk) is not None for r in data)  # else all keys are new by their making
        if m.implicit_pk:
            for r in data:
                if r.get(m.pk) is None:
                    r[m.pk] = m.next_id
                m.next_id = max(m.next_id, r[m.pk]) + 1
        if any(r.get(m.pk) is None for r in data):
            raise types.IntegrityError(f"no {m.pk}")
        df = self.store.rows(m, data)
        if m.versioned:
            self._log(m, self._images(m, df).withColumn("_op", F.lit("insert")), ["pk"], author)
        keys = [r[m.pk] for r in data]
        self.store.append(m, df, unique=given, keys=[int(k) if m.columns[m.pk].startswith(types.INTEGER) else str(k) for k in keys])
        return keys

    def append(self, table: str, df: DataFrame, *, unique: bool = True) -> None:
        """Rows of a DataFrame with the table's columns, for loads of any size."""
        m = self.store.manifest(table)
        missing = [c for c in m.columns if c not in df.columns]
        df = df.withColumns({c: F.lit(None) for c in missing}).select(*[F.col(f.name).cast(f.dataType) for f in m.schema()])
        if m.versioned:
            self._log(m, self._images(m, df).withColumn("_op", F.lit("insert")), ["pk"], None)
        self.store.append(m, df, unique=unique)

    def upsert(self, table: str, data: dict, sync: bool = True) -> Any:
        m = self.store.manifest(table)
        if data.get(m.pk) is None:
            raise ValueError(f"upsert needs {m.pk}")
        if self.get(table, data[m.pk]) is None:
            return self.insert(table, data)
        self.update(table, data[m.pk], data)
        return data[m.pk]

    def update(self, table: str, key: Any, data: dict, sync: bool = True, author: str | None = None) -> bool:
        m = self.store.manifest(table)
        old = self.store.scan(table).filter(F.col(m.pk) == key)
        if not old.take(1):
            return False
        known = {c: v for c, v in data.items() if c in m.columns}
        typed = self.store.rows(m, [{m.pk: key} | known]).first()
        new = old.withColumns({c: F.lit(typed[c]).cast(types.spark_type(m.columns[c].split()[0])) for c in known}) if known else old
        new = self.spark.createDataFrame(new.collect(), m.schema())  # one row, fixed before its file goes
        moved = m.pk in known and typed[m.pk] != key
        if moved and self.get(table, typed[m.pk]) is not None:
            raise types.IntegrityError(f"repeated key in {table}")
        if m.versioned:
            events = self._images(m, new).withColumn("_op", F.lit("update"))
            if moved:
                events = self._images(m, old).withColumn("_op", F.lit("delete")).unionByName(events)
            self._log(m, events, ["_op", "pk"], author)
        self.store.change(m, old.select(m.pk), new)
        return True

    def delete(self, table: str, key: Any, sync: bool = True, author: str | None = None) -> bool:
        m = self.store.manifest(table)
        old = self.store.scan(table).filter(F.col(m.pk) == key)
        if not old.take(1):
            return False
        if m.versioned:
            self._log(m, self._images(m, old).withColumn("_op", F.lit("delete")), ["pk"], author)
        self.store.change(m, self.spark.createDataFrame([(key,)], f"k {old.schema[m.pk].dataType.simpleString()}"))
        return True

    def get(self, table: str, key: Any) -> dict | None:
        m = self.store.manifest(table)
        got = self.store.scan(table).filter(F.col(m.pk) == key).limit(1).collect()
        return got[0].asDict() if got else None

    def get_many(self, table: str, keys: list) -> dict[Any, dict]:
        m = self.store.manifest(table)
        return {r[m.pk]: r for r in _dicts(self.store.scan(table).filter(F.col(m.pk).isin(keys)))} if keys else {}

    def query(self, table: str, where: str = "", params: Sequence[Any] = (), order_by: str = "", limit: int = 100) -> list[dict]:
        df = self._where(table, where, params)
        order = [F.desc(c) if down else F.asc(c) for c, down in types.ordering(order_by)]
        df = df.orderBy(*order) if order else df
        return _dicts(df.limit(limit) if limit and limit > 0 else df)

    def count(self, table: str, where: str = "", params: Sequence[Any] = ()) -> int:
        return self._where(table, where, params).count()

    def _where(self, table: str, where: str, params: Sequence[Any]) -> DataFrame:
        df = self.store.scan(table)
        return self.spark.sql(f"SELECT * FROM {{df}} WHERE {where}", args=list(params) or None, df=df) if where else df

    def raw_query(self, sql: str, params: Sequence[Any] = ()) -> list[dict]:
        return _dicts(self.spark.sql(sql, args=list(params) or None))

    def read_query(self, sql: str, params: Sequence[Any] = ()) -> list[dict]:
        if not reads_only(self.spark, sql):
            raise PermissionError("only reading statements are allowed")
        return self.raw_query(sql, params)

    def row_to_metadata(self, table: str, row: dict) -> dict:
        m = self.store.manifest(table)
        return json.loads(self.store.rows(m, [row]).select(fr.metadata(m.columns)).first()[0])

    # search

    def _text_columns(self, m: Manifest) -> dict[str, str]:
        """Text columns with their types; the key is no such column."""
        kinds = {c: t.split() for c, t in m.columns.items() if c != m.pk}
        return {c: t[0] for c, t in kinds.items() if types.is_text(t[0])}

    def _index(self, m: Manifest, column: str, only: list[str] | None = None) -> TextIndex:
        long = self._text_columns(m)[column] == types.LONGTEXT
        return self.store.indexed(m, column, self.embedding_fn if long else None, long, only)

    def search(self, table: str, column: str, query: str | None = None, mode: types.SearchMode | str = types.HYBRID, limit: int = 10, fts_weight: float = 0.5, recency_weight: float = 0.0, recency_column: str | None = None, query_embedding: Sequence[float] | None = None, where: dict | None = None, now: Any = None) -> list[dict]:
        mode = types.search_mode(mode)
        if table not in self.store.tables():
            return []
        m = self.store.manifest(table)
        kind = m.columns.get(column, "").split()
        if query is not None:
            types.identifier(column, "column")
            if not kind or not types.is_text(kind[0]) or "PRIMARY" in kind:
                return []
            if kind[0] == types.TEXT:
                if mode == types.SEMANTIC:
                    return []
                mode = types.KEYWORD
        index = None
        if query is not None:
            index = self._index(m, column)
            if mode != types.KEYWORD and query_embedding is None and self.embedding_fn:
                query_embedding = self.embedding_fn(query)
        moment = None if now is None else F.lit(now).cast("timestamp")
        found = search.search(self.store.scan(table), m.pk, column, query, mode, limit, index=index, query_vec=query_embedding, fts_weight=fts_weight, recency_weight=recency_weight, recency_column=recency_column, now=moment, where=where)
        return _dicts(found)

    def search_all(self, table: str, query: str, where: dict | None = None, limit: int = 10, fts_weight: float = 0.5, recency_weight: float = 0.0, recency_column: str | None = None) -> list[dict]:
        """Over all text columns but those that only identify or date a row."""
        return self._search_columns(table, query, _NOT_SEARCHED, where, limit, fts_weight, recency_weight, recency_column)

    def _search_columns(self, table: str, query: str, skip: frozenset, where: dict | None, limit: int, fts_weight: float, recency_weight: float, recency_column: str | None) -> list[dict]:
        m = self.store.manifest(table)
        kinds = self._text_columns(m)
        indexes = {c: self._index(m, c) for c in kinds}
        wanted = self.embedding_fn(query) if self.embedding_fn else None
        words, long = [c for c in kinds if c not in skip], {c: None for c, t in kinds.items() if t == types.LONGTEXT}
        found = search.search_all(self.store.scan(table), m.pk, query, words, long, limit, query_vec=wanted, fts_weight=fts_weight, where=where, recency_weight=recency_weight, recency_column=recency_column, indexes=indexes)
        return _dicts(found)

    def search_columns(self, table: str, query: str, where: dict | None = None, limit: int = 10, fts_weight: float = 0.5, recency_weight: float = 0.0, recency_column: str | None = None) -> list[dict]:
        return self._search_columns(table, query, frozenset(), where, limit, fts_weight, recency_weight, recency_column)

    # history

    def _images(self, m: Manifest, df: DataFrame) -> DataFrame:
        return df.select(F.col(m.pk).cast("string").alias("pk"), fr.canonical_json(list(m.columns)).alias("row_json"))

    def _log(self, m: Manifest, events: DataFrame, order: list[str], author: str | None) -> int:
        from datetime import UTC, datetime

        if not m.versioned:
            raise ValueError(f"{m.name} is not versioned")
        events = versioning.numbered(events, order, m.head_seq).withColumns({"_ts": F.lit(datetime.now(UTC).isoformat()), "_author": F.lit(author).cast("string")})
        if m.hash_chain:
            events = versioning.chained(events, m.head_hash)
        else:
            events = events.withColumns({"prev_hash": F.lit(None).cast("string"), "event_hash": F.lit(None).cast("string")})
        new = self.store.write(m.name, "log", events.select(*[c.split()[0] for c in versioning.LOG.split(", ")]))
        last = self.spark.read.schema(versioning.LOG).parquet(*new).agg(F.count("*").alias("n"), F.max("_seq").alias("s"), F.max_by("event_hash", "_seq").alias("h")).first()
        if last.n:
            m.log_files, m.head_seq, m.head_hash = m.log_files + new, last.s, last.h or m.head_hash
        return last.n

    def _log_of(self, table: str) -> tuple[Manifest, DataFrame]:
        m = self.store.manifest(table)
        if not m.versioned:
            raise ValueError(f"{table} is not versioned")
        df = self.spark.read.schema(versioning.LOG).parquet(*m.log_files) if m.log_files else self.spark.createDataFrame([], versioning.LOG)
        return m, df

    def _state(self, table: str, seq: int | None) -> DataFrame:
        """``pk, row_json`` after event ``seq``. A state before a prune is gone and raises."""
        m, log = self._log_of(table)
        cut = max(map(int, m.anchors), default=0)
        if seq is not None and seq < cut:
            raise ValueError(f"the history of {table} up to {cut} was pruned; there is no state at {seq}")
        if not m.baseline:
            return versioning.as_of(log, seq)
        return versioning.as_of_with_baseline(log, self.spark.read.schema(_BASELINE).parquet(*m.baseline), seq)

    def is_versioned(self, table: str) -> bool:
        return table in self.store.tables() and self.store.manifest(table).versioned

    def log(self, table: str, limit: int = 100) -> list[dict]:
        return _dicts(versioning.latest(self._log_of(table)[1], limit))

    def history(self, table: str, key: Any) -> list[dict]:
        return _dicts(versioning.history(self._log_of(table)[1], str(key)))

    def as_of(self, table: str, seq: int) -> list[dict]:
        return [json.loads(r.row_json) for r in self._state(table, seq).orderBy("pk").collect()]

    def changes(self, table: str, from_seq: int, to_seq: int | None = None) -> DataFrame:
        """``pk, change, before, after`` between two states, for differences of any size."""
        return versioning.diff_between(self._state(table, from_seq), self._state(table, to_seq))

    def diff(self, table: str, from_seq: int, to_seq: int | None = None) -> dict[str, list]:
        """Rows added and removed, and pairs ``before, after`` of those changed."""
        out: dict[str, list] = {"added": [], "removed": [], "changed": []}
        for r in self.changes(table, from_seq, to_seq).orderBy("pk").collect():
            before, after = (None if x is None else json.loads(x) for x in (r.before, r.after))
            out[r.change].append({"before": before, "after": after} if r.change == "changed" else before or after)
        return out

    def checkpoint(self, table: str, label: str) -> dict:
        m, _ = self._log_of(table)
        if not label or not isinstance(label, str):
            raise ValueError("a checkpoint needs a name")
        m.checkpoints[label] = m.head_seq
        self.store.save(m)
        return {"table": table, "label": label, "seq": m.head_seq}

    def checkpoints(self, table: str) -> dict[str, int]:
        return dict(self.store.manifest(table).checkpoints)

    def _seq(self, m: Manifest, checkpoint: str | None, seq: int | None) -> int:
        if checkpoint is not None and checkpoint not in m.checkpoints:
            raise ValueError(f"no checkpoint {checkpoint!r} of {m.name}")
        if checkpoint is None and seq is None:
            raise ValueError("a checkpoint or a sequence number is needed")
        return m.checkpoints[checkpoint] if checkpoint is not None else seq

    def rollback(self, table: str, checkpoint: str | None = None, at_seq: int | None = None, sync: bool = True, author: str | None = None) -> dict:
        """The rows as they were, written as new events; ``table, seq, changes``."""
        m, log = self._log_of(table)
        seq = self._seq(m, checkpoint, at_seq)
        if m.head_seq <= seq:
            return {"table": table, "seq": seq, "changes": 0}
        now = self._images(m, self.store.scan(table))
        target = self._state(table, seq)
        plan = versioning.rollback_between(now, target)
        events = versioning.events_of(plan)
        n = self._log(m, events, ["n", "pk"], author)
        if n:
            done = self.spark.read.schema(versioning.LOG).parquet(*m.log_files).filter(F.col("_seq") > m.head_seq - n)
            key = self.store.scan(table).schema[m.pk].dataType
            gone = done.select(F.col("pk").cast(key).alias(m.pk))
            fresh = done.filter("_op <> 'delete'").select(F.from_json("row_json", m.schema()).alias("r")).select("r.*")
            self.store.change(m, gone, fresh)
        return {"table": table, "seq": seq, "changes": n}

    def verify_chain(self, table: str) -> dict:
        """``valid, checked`` (events) and ``first_broken_seq``."""
        m, log = self._log_of(table)
        found = versioning.verify_chain(log, {int(s): h for s, h in m.anchors.items()})
        return {"valid": found["valid"], "checked": found["checked"], "first_broken_seq": found["first_broken"]}

    def prune(self, table: str, before_seq: int | None = None, checkpoint: str | None = None, keep_checkpoints: bool = True) -> dict:
        """Drops events before the cut, keeping the state they leave; ``pruned`` (how many) and ``anchor_seq`` (the last)."""
        m, log = self._log_of(table)
        cut = self._seq(m, checkpoint, before_seq) + (checkpoint is not None)
        if keep_checkpoints and any(s < cut - 1 for s in m.checkpoints.values()):
            raise ValueError("a checkpoint is older than the cut")
        rest, _, anchor = versioning.prune(log, cut)
        n = log.filter(F.col("_seq") < cut).count()
        if not n:
            return {"pruned": 0, "anchor_seq": None}
        base = self._state(table, cut - 1)
        baseline, kept = self.store.write(table, "baseline", base), self.store.write(table, "log", rest)
        m.log_files, m.baseline, m.anchors = kept, baseline, {str(cut - 1): anchor}
        m.checkpoints = {k: s for k, s in m.checkpoints.items() if s >= cut - 1}
        self.store.save(m)
        return {"pruned": n, "anchor_seq": cut - 1}

    def archive(self, table: str, path: str, format: str = "jsonl") -> dict:
        """Current rows and history, each in a folder, and how many there are."""
        _, log = self._log_of(table)
        write = {"parquet": formats.write_parquet, "jsonl": formats.write_jsonl}[format]
        out = {"current": f"{path}/{table}.{format}", "history": f"{path}/{table}__history.{format}"}
        write(self.store.scan(table), out["current"])
        write(log, out["history"])
        return {"path": path, "format": format, **out, "rows": self.count(table), "history_rows": log.count()}

    # journal: what the indexes of a table's text columns don't cover yet

    def _pending(self, m: Manifest) -> dict[str, int]:
        """Files that some index lacks, with their rows."""
        lost = sorted({f for c in self._text_columns(m) for f in self.store.uncovered(m, c)[1]})
        if not lost:
            return {}
        rows = self.store.read(lost, m.schema()).groupBy(F.substring_index(F.input_file_name(), "/", -2).alias("f")).count().collect()
        count = {r.f: r["count"] for r in rows}
        return {f: count.get(source(f), 0) for f in lost}

    def journal_status(self, table: str | None = None) -> dict[str, int]:
        """Rows that wait to be indexed and rows that are."""
        out = {"pending": 0, "failed": 0, "done": 0}
        for t in [table] if table else self.list_tables():
            m = self.store.manifest(t)
            if self._text_columns(m):
                waiting = sum(self._pending(m).values())
                out["pending"] += waiting
                out["done"] += self.count(t) - waiting
        return out

    def process_journal(self, limit: int = 5000) -> int:
        """Indexes waiting rows, whole files until ``limit`` rows are reached; their number."""
        done = 0
        for t in self.store.tables():
            m, take = self.store.manifest(t), []
            for f, n in self._pending(m).items():
                if done < limit:
                    take.append(f)
                    done += n
            for c in self._text_columns(m) if take else ():
                self._index(m, c, take)
        return done

    def reconcile(self, table: str) -> dict[str, int]:
        """Brings derived data in line: what indexes hold of rows that went, what they lack, the graph's nodes and edges by
        the rules, edges that ran out."""
        m = self.store.manifest(table)
        out = {"ghosts_deleted": 0, "missing_added": sum(self._pending(m).values()), "metadata_updated": 0}
        for c in self._text_columns(m):
            held = [json.loads(self.store.files.read(f"{path}/segment.json")) for path, _ in m.indexes.get(c, [])]
            live = {source(f) for f in m.files}
            out["ghosts_deleted"] = max(out["ghosts_deleted"], sum(x[0] for h in held for f, x in h.items() if f not in live))
            m.indexes[c] = [s for s in m.indexes.get(c, []) if all(f in m.files for f in s[1])]  # the others are written anew
            self._index(m, c)
        self.store.save(m)
        self.graph.sync_graph_nodes()
        self.graph.decay_edges()
        weak = self.graph.edges.filter("weight < 0.05")
        if weak.take(1):
            self.graph._put("_graph_edges", self.graph.edges.filter("weight is null or weight >= 0.05"))
        return out

    # care

    def health(self, table: str) -> dict:
        """``broken`` if files are missing, ``drift`` if an index doesn't hold the rows there are."""
        m = self.store.manifest(table)
        lost = [f for f in m.files if not self.store.files.exists(f)]
        if lost:
            return {"status": "broken", "rows": None, "indexed": {}, "pending": None, "missing_files": lost}
        rows, held = self.count(table), {}
        for c in self._text_columns(m):
            kept, _ = self.store.uncovered(m, c)
            stats = [(json.loads(self.store.files.read(f"{path}/segment.json")), {source(f) for f in files}) for path, files in kept]
            held[c] = sum(x[0] for h, files in stats for f, x in h.items() if f in files)
        waiting = sum(self._pending(m).values())
        return {"status": "ok" if not waiting and all(n == rows for n in held.values()) else "drift", "rows": rows, "indexed": held, "pending": waiting, "missing_files": []}

    def check_integrity(self, table: str | None = None) -> dict:
        """Of one table or, with ``overall`` the worst, of each: ``ok``; ``degraded`` if the hash chain is broken; ``corrupt`` if files are missing or keys null or repeated."""
        if table is None:
            found = {t: self.check_integrity(t) for t in self.list_tables()}
            worst = ("ok", "degraded", "corrupt")
            return {"overall": max((x["status"] for x in found.values()), key=worst.index, default="ok"), "tables": found}
        m = self.store.manifest(table)
        issues = [f"missing file {f}" for f in m.files if not self.store.files.exists(f)]
        if not issues:
            keys = self.store.scan(table).groupBy(m.pk).count().filter(F.col(m.pk).isNull() | (F.col("count") > 1))
            issues += [f"key {r[0]!r} occurs {r[1]} times" for r in keys.take(5)]
        status = "corrupt" if issues else "ok"
        if m.versioned and m.hash_chain and not issues and not (v := self.verify_chain(table))["valid"]:
            status, issues = "degraded", [f"hash chain broken at {v['first_broken_seq']}"]
        return {"status": status, "issues": issues}

    def stats(self) -> dict:
        out = {}
        for t in self.list_tables():
            m = self.store.manifest(t)
            out[t] = {"rows": self.count(t), "columns": len(m.columns), "files": len(m.files), "bytes": sum(self.store.files.size(f) for f in m.files), "events": m.head_seq}
        return out

    def reindex(self, table: str | None = None) -> int:
        """Compacts the files of a table, or of all, and indexes them anew; the number of rows."""
        if table is None:
            return sum(self.reindex(t) for t in self.list_tables())
        m = self.store.manifest(table)
        df = self.store.scan(table)
        n = df.count()
        m.files, m.indexes = self.store.write(table, "data", df.select(*m.columns)), {}
        self.store.save(m)
        for c in self._text_columns(m):
            self._index(m, c)
        return n

    def vacuum(self) -> int:
        return self.store.vacuum()

    def backup(self, path: str) -> str:
        self.store.files.copy(self.store.root, path)
        return path

    def restore(self, path: str) -> None:
        """The copy takes the place of the present tables, which are kept aside."""
        if not self.store.files.exists(f"{path}/catalog"):
            raise FileNotFoundError(path)
        aside = f"{self.store.root}.before-{uuid.uuid4().hex[:8]}"
        self.store.files.move(self.store.root, aside)
        self.store.files.copy(path, self.store.root)
        here = self.store.root
        for t in self.store.tables():
            m = self.store.manifest(t)
            home = lambda fs: [f"{here}/tables/{f.rsplit('/tables/', 1)[1]}" for f in fs]
            m.files, m.log_files, m.baseline = home(m.files), home(m.log_files), home(m.baseline)
            m.indexes = {c: [[*home([p]), home(fs)] for p, fs in x] for c, x in m.indexes.items()}
            self.store.save(m)

    def export(self, path: str) -> str:
        """All tables as JSON lines with their manifests."""
        for t in self.store.tables():
            m = self.store.manifest(t)
            formats.write_jsonl(self.store.scan(t), f"{path}/{t}.jsonl")
            if m.log_files:
                formats.write_jsonl(self._log_of(t)[1], f"{path}/{t}__history.jsonl")
            if m.baseline:
                formats.write_jsonl(self.spark.read.schema(_BASELINE).parquet(*m.baseline), f"{path}/{t}__baseline.jsonl")
            self.store.files.write(f"{path}/{t}.manifest.json", self.store.files.read(self.store._path(t)))
        return path

    def import_(self, path: str) -> list[str]:
        """Replaces tables by those of an export."""
        out = []
        for n in self.store.files.kept(path):
            if n.endswith(".manifest.json"):
                m = Manifest(**json.loads(self.store.files.read(f"{path}/{n}")))
                m.indexes = {}
                m.files = self.store.write(m.name, "data", self.spark.read.schema(m.schema()).json(f"{path}/{m.name}.jsonl"))
                if m.baseline:
                    m.baseline = self.store.write(m.name, "baseline", self.spark.read.schema(_BASELINE).json(f"{path}/{m.name}__baseline.jsonl"))
                if m.log_files:
                    m.log_files = self.store.write(m.name, "log", self.spark.read.schema(versioning.LOG).json(f"{path}/{m.name}__history.jsonl"))
                self.store.save(m)
                out.append(m.name)
        return out

    export_sql, import_sql = export, import_

    def analytics(self, sql: str) -> list[dict]:
        return self.olap.query(sql)

    def close(self) -> None:
        for t in self.list_tables():
            self.spark.catalog.dropTempView(t)


class Olap:
    """SQL over views that always show the present rows."""

    def __init__(self, db: Database) -> None:
        self._db = db

    def query(self, sql: str) -> list[dict]:
        return self._db.read_query(sql)

    def register_table(self, table: str) -> bool:
        if table not in self._db.list_tables():
            return False
        self._db._view(table)
        return True

    def unregister_table(self, table: str) -> bool:
        return self._db.spark.catalog.dropTempView(table)

    def sync_table(self, table: str) -> None:
        self._db._view(table)


class Graph:
    """Nodes and edges kept as two system tables, and the rules that derive them from others."""

    def __init__(self, db: Database) -> None:
        self._db = db
        for name, ddl in (("_graph_nodes", NODE), ("_graph_edges", EDGE)):
            if name not in db.store.tables():
                kinds = {"double": "REAL", "string": "TEXT"}
                cols = {c: kinds[t] + (" PRIMARY KEY" if c == "id" else "") for c, t in (x.split() for x in ddl.split(", "))}
                db.store.save(Manifest(name, cols, "id"))
        self._rules = f"{db.store.root}/catalog/graph.rules"

    nodes = property(lambda self: self._db.store.scan("_graph_nodes"))
    edges = property(lambda self: self._db.store.scan("_graph_edges"))

    def _put(self, name: str, df: DataFrame) -> None:
        m = self._db.store.manifest(name)
        m.files = self._db.store.write(name, "data", df.select(*m.columns))
        self._db.store.save(m)

    def _now(self) -> str:
        from datetime import UTC, datetime

        return datetime.now(UTC).isoformat()

    def _frame(self, name: str, data: list[dict]) -> DataFrame:
        data = [d | {"properties": json.dumps(d["properties"]) if isinstance(d.get("properties"), dict) else d.get("properties")} for d in data]
        return self._db.store.rows(self._db.store.manifest(name), data)

    def add_node(self, node_id: str | None = None, label: str = "", type: str = "node", domain: str = "", confidence: float = 0.5, source: str = "inferred", properties: dict | None = None) -> str:
        return self.add_nodes([{"id": node_id, "label": label, "type": type, "domain": domain, "confidence": confidence, "source": source, "properties": properties or {}}])[0]

    def add_nodes(self, nodes: list[dict]) -> list[str]:
        base = {"label": "", "type": "node", "domain": "", "confidence": 0.5, "source": "inferred", "properties": {}, "created_at": self._now(), "updated_at": self._now()}
        rows = [base | n | {"id": n.get("id") or str(uuid.uuid4())} for n in nodes]
        self._put("_graph_nodes", g.upsert(self.nodes, self._frame("_graph_nodes", rows), ["id"]))
        return [r["id"] for r in rows]

    def get_node(self, node_id: str) -> dict | None:
        return self._db.get("_graph_nodes", node_id)

    def update_node(self, node_id: str, data: dict) -> bool:
        return self._update("_graph_nodes", node_id, data | {"updated_at": self._now()}, ("label", "type", "domain", "confidence", "source", "updated_at"))

    def update_edge(self, edge_id: str, data: dict) -> bool:
        return self._update("_graph_edges", edge_id, data, ("type", "weight", "valid_from", "valid_until"))

    def _update(self, name: str, key: str, data: dict, allowed: tuple) -> bool:
        """Sets the allowed fields and merges ``properties``."""
        if self._db.get(name, key) is None:
            return False
        properties = F.lit(json.dumps(data.get("properties") or {}))
        self._put(name, g.update_properties(self._db.store.scan(name), "id", key, properties, **{k: F.lit(v) for k, v in data.items() if k in allowed}))
        return True

    def delete_node(self, node_id: str) -> bool:
        if self.get_node(node_id) is None:
            return False
        n, e = g.delete_nodes(self.nodes, self.edges, self._db.spark.createDataFrame([(node_id,)], "id string"))
        self._put("_graph_edges", e)
        self._put("_graph_nodes", n)
        return True

    def list_nodes(self, type: str | None = None, domain: str | None = None, min_confidence: float | None = None, limit: int = 100) -> list[dict]:
        return _dicts(predicates.optional(self.nodes, limit, type=type, domain=domain, min_confidence=min_confidence))

    def add_edge(self, edge_id: str | None, source_id: str, target_id: str, type: str = "relates_to", weight: float = 1.0, properties: dict | None = None, valid_until: str | None = None) -> str:
        return self.add_edges([{"id": edge_id, "source_id": source_id, "target_id": target_id, "type": type, "weight": weight, "properties": properties or {}, "valid_until": valid_until}])[0]

    def add_edges(self, edges: list[dict]) -> list[str]:
        base = {"type": "relates_to", "weight": 1.0, "properties": {}, "created_at": self._now()}
        rows = [base | e | {"id": e.get("id") or uuid.uuid4().hex[:16]} for e in edges]
        new = self._frame("_graph_edges", rows)
        old = self.edges.join(new.select("id"), "id", "left_anti").select(*self.edges.columns)
        self._put("_graph_edges", g.add_edges(old, new, self.nodes))
        return [r["id"] for r in rows]

    def get_edge(self, edge_id: str) -> dict | None:
        return self._db.get("_graph_edges", edge_id)

    def delete_edge(self, edge_id: str) -> bool:
        return self._db.delete("_graph_edges", edge_id)

    def get_edges(self, source_id: str | None = None, target_id: str | None = None, type: str | None = None, limit: int = 100) -> list[dict]:
        return _dicts(predicates.optional(self.edges, limit, source_id=source_id, target_id=target_id, type=type))

    def neighbors(self, node_id: str, direction: str = "both", type: str | None = None) -> list[dict]:
        """Each neighbour's node with the heaviest edge to it, heaviest first."""
        n = self.nodes.select(F.struct("id", "label", "type", "properties").alias("node"))
        near = g.neighbors(self.edges, node_id, direction, type).join(n, F.col("neighbor") == F.col("node.id")).orderBy(F.desc("weight"), "neighbor").collect()
        read = lambda x: json.loads(x) if x else {}
        edge = ("id", "type", "weight", "source_id", "target_id")
        return [{"node": r.node.asDict() | {"properties": read(r.node.properties)}, "edge": {c: r.edge[c] for c in edge} | {"properties": read(r.edge.properties)}} for r in near]

    get_neighbors = neighbors

    def traverse(self, start: str, max_depth: int = 3, direction: str = "out", type: str | None = None, max_cost: float = 3.0) -> list[dict]:
        found = g.traverse(self.edges, start, max_depth, direction, type, max_cost)
        return _dicts(found.select(F.col("node").alias("node_id"), "depth", "path", F.col("cost").alias("cum_cost")).orderBy("depth", "cum_cost", "node_id"))

    def decay_edges(self, now: str | None = None) -> int:
        left, expired = g.decay(self.edges, now or self._now())
        n = expired.count()
        if n:
            self._put("_graph_edges", left)
        return n

    def _ranked(self, df: DataFrame, value: str) -> dict[str, float]:
        return {r[0]: r[1] for r in df.select("id", value).collect()}

    def pagerank(self, personalization: dict[str, float] | None = None, alpha: float = 0.85) -> dict[str, float]:
        seeds = self._db.spark.createDataFrame(list(personalization.items()), "id string, weight double") if personalization else None
        return self._ranked(g.pagerank(self.edges, self.nodes.select("id"), seeds, alpha, 100, tolerance=1e-6), "rank")

    def betweenness_centrality(self) -> dict[str, float]:
        return self._ranked(g.betweenness(self.edges, self.nodes), "betweenness")

    def shortest_path(self, start: str, end: str) -> list[str] | None:
        return g.shortest_path(self.edges, start, end)

    def _sets(self, df: DataFrame, by: str) -> list[set[str]]:
        out: dict[str, set[str]] = {}
        for r in df.select("id", by).toLocalIterator():
            out.setdefault(r[1], set()).add(r[0])
        return [out[k] for k in sorted(out)]

    def connected_components(self) -> list[set[str]]:
        return self._sets(g.connected_components(self.edges, self.nodes.select("id")), "component")

    def community_detect(self) -> list[set[str]]:
        return self._sets(g.communities(self.edges, self.nodes), "community")

    def to_edges(self, undirected: bool = False) -> DataFrame:
        return g.collapsed(self.edges, undirected)

    # rules

    def _load(self) -> dict:
        f = self._db.store.files
        return json.loads(f.read(self._rules)) if f.has(self._rules) else {"nodes": {}, "edges": []}

    def register_entity_node(self, table: str, type: str = "entity", id_column: str | None = None, label_template: str = "") -> bool:
        m = self._db.store.manifest(table)
        key = id_column or m.pk
        if key not in m.columns:
            raise ValueError(f"no column {key} in {table}")
        rules = self._load()
        rules["nodes"][table] = [type, key, label_template or f"{{{key}}}"]
        self._db.store.files.write(self._rules, json.dumps(rules))
        return True

    def register_edge_rule(self, source_table: str, target_table: str, target_match: str | None = None, edge_type: str = "relates_to", source_column: str | None = None, target_column: str | None = None) -> bool:
        """Edges between rows whose columns are equal; ``target_match`` alone is the column that holds the target's key."""
        if (source_column is None) != (target_column is None) or source_column is None and target_match is None:
            raise ValueError("target_match, or source_column and target_column, are needed")
        if source_column is None:
            source_column, target_column = target_match, self._db.store.manifest(target_table).pk
        rules = self._load()
        if source_column not in self._db.get_schema(source_table) or target_column not in self._db.get_schema(target_table):
            raise ValueError("no such column")
        rule = [source_table, target_table, source_column, target_column, edge_type]
        rules["edges"] = [r for r in rules["edges"] if r != rule] + [rule]
        self._db.store.files.write(self._rules, json.dumps(rules))
        return True

    def sync_graph_nodes(self) -> dict[str, int]:
        """Nodes and edges as the rules want them; how many nodes were created, updated and removed."""
        rules, total = self._load(), {"created": 0, "updated": 0, "removed": 0, "edges": 0}
        for table, (kind, key, template) in rules["nodes"].items():
            wanted = g.entity_nodes(self._db.store.scan(table), table, key, kind, template)
            changes = g.sync_nodes(self.nodes, wanted, f"{table}:")
            for r in changes.groupBy("change").count().collect():
                total[r.change] = total.get(r.change, 0) + r["count"]
            new = changes.filter("change in ('created', 'updated')").select("id", "label", "type", F.lit(1.0).alias("confidence"), F.lit(table).alias("source"), F.lit(self._now()).alias("updated_at"), F.lit(self._now()).alias("created_at"))
            gone = changes.filter("change = 'removed'").select("id")
            nodes, edges = g.delete_nodes(self.nodes, self.edges, gone)
            self._put("_graph_edges", edges)
            self._put("_graph_nodes", g.upsert(nodes, new, ["id"]))
        for s, t, sc, tc, kind in rules["edges"]:
            scan, pk = self._db.store.scan, lambda x: self._db.store.manifest(x).pk
            wanted = g.rule_edges(scan(s), scan(t), s, t, pk(s), pk(t), sc, tc, kind)
            wanted = wanted.withColumns({"id": F.substring(F.sha2(F.concat_ws("|", "source_id", "target_id", "type"), 256), 1, 16), "created_at": F.lit(self._now())})
            ids = self.nodes.select("id")
            wanted = wanted.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
            total["edges"] += wanted.count()
            self._put("_graph_edges", g.upsert(self.edges, wanted, ["source_id", "target_id", "type"]))
        total.pop("kept", None)
        return total

    def _seeds(self, query: str, limit: int) -> DataFrame:
        out, db = None, self._db
        for table in self._load()["nodes"]:
            m = db.store.manifest(table)
            for c in [c for c, t in db._text_columns(m).items() if t == types.LONGTEXT]:
                wanted = db.embedding_fn(query) if db.embedding_fn else None
                near = search._vector_leg(db.store.scan(table), m.pk, c, query, None, wanted, "l2sq", limit, db._index(m, c))
                hits = near.select(F.concat(F.lit(f"{table}:"), F.col("pk").cast("string")).alias("id"), "similarity")
                out = hits if out is None else out.union(hits)
        return db.spark.createDataFrame([], "id string, similarity double") if out is None else out.groupBy("id").agg(F.max("similarity").alias("similarity"))

    def search_graph(self, query: str, hop_expansion: int = 2, limit: int = 10) -> list[dict]:
        """``node_id, similarity, source_table`` of the nearest nodes with the ids of their heaviest ``neighbors``."""
        self.sync_graph_nodes()
        found = g.search_graph(self._seeds(query, limit), self.edges, hop_expansion).limit(limit)
        return _dicts(found.select(F.col("id").alias("node_id"), "similarity", F.substring_index("id", ":", 1).alias("source_table"), "neighbors"))

    def search_graph_ppr(self, query: str, hop_expansion: int = 2, limit: int = 10, alpha: float = 0.15, min_similarity: float = 0.0) -> list[dict]:
        self.sync_graph_nodes()
        found = g.search_graph_ppr(self._seeds(query, limit), self.edges, hop_expansion, alpha, limit, min_similarity)
        return _dicts(found.withColumnRenamed("id", "node_id"))
