"""Tables as immutable Parquet files under a manifest.

A write adds files and swaps the manifest; an update or delete rewrites only the files that hold a touched key (found
from the key column alone). Files no manifest names are left for ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.operators.textindex import TextIndex, source
from tessel.sources.files import Files
from tessel.types import IntegrityError, identifier, spark_type, table_name


#: Most keys that are looked up one by one.
_FEW_KEYS = 1000
#: Segments of an index after which the next one takes in all files.
_SEGMENTS = 8


@dataclass
class Manifest:
    name: str
    columns: dict[str, str]
    pk: str
    implicit_pk: bool = False
    next_id: int = 1
    version: int = 1
    files: list[str] = field(default_factory=list)
    versioned: bool = False
    hash_chain: bool = True
    log_files: list[str] = field(default_factory=list)
    head_seq: int = 0
    head_hash: str = "0" * 64
    checkpoints: dict[str, int] = field(default_factory=dict)
    anchors: dict[str, str] = field(default_factory=dict)
    baseline: list[str] = field(default_factory=list)
    embedding_model: str | None = None
    indexes: dict[str, list] = field(default_factory=dict)  # by column: segments, each a path and the files it covers

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, spark_type(t.split()[0]), True, {"logical": t, "pk": c == self.pk}) for c, t in self.columns.items()])


class Store:
    """Manifests and files of the tables under ``root``. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self.on_change: list[Any] = []

    # manifests

    def _path(self, name: str) -> str:
        return f"{self.root}/catalog/{name}.json"

    def tables(self) -> list[str]:
        return [n[:-5] for n in self.files.kept(f"{self.root}/catalog") if n.endswith(".json")]

    def manifest(self, name: str) -> Manifest:
        if not self.files.has(self._path(name)):
            raise KeyError(f"no such table: {name}")
        return Manifest(**json.loads(self.files.read(self._path(name))))

    def save(self, m: Manifest) -> None:
        self.files.write(self._path(m.name), json.dumps(asdict(m)))
        for f in self.on_change:
            f(m.name)

    # definition

    def create(self, name: str, columns: dict[str, Any], versioned: bool = False, hash_chain: bool = True) -> Manifest:
        """A new table, or the old one with the columns it lacks."""
        table_name(name)
        given = {identifier(c, "column name"): str(t) for c, t in columns.items()}
        if name in self.tables():
            m = self.manifest(name)
            m.columns |= {c: t for c, t in given.items() if c not in m.columns}
            m.version += 1
            self.save(m)
            return m
        keys = [c for c, t in given.items() if "PRIMARY KEY" in t.upper()]
        if len(keys) > 1:
            raise ValueError("more than one primary key")
        if not keys and "id" in given:
            raise ValueError("a column id must be the primary key")
        if not keys:
            given = {"id": "INTEGER PRIMARY KEY"} | given
        m = Manifest(name, given, keys[0] if keys else "id", implicit_pk=not keys, versioned=versioned, hash_chain=hash_chain)
        self.save(m)
        return m

    def add_column(self, name: str, column: str, kind: str) -> None:
        m = self._changeable(name)
        identifier(column, "column name")
        if column in m.columns:
            raise ValueError(f"column exists: {column}")
        m.columns[column] = str(kind)
        m.version += 1
        self.save(m)  # older files give null for it

    def drop_column(self, name: str, column: str) -> None:
        m = self._changeable(name)
        if column == m.pk:
            raise ValueError("the primary key can't be dropped")
        del m.columns[column]
        self._rewrite(m, self.scan(name).drop(column))

    def rename_column(self, name: str, old: str, new: str) -> None:
        m = self._changeable(name)
        identifier(new, "column name")
        if old not in m.columns or new in m.columns:
            raise ValueError(f"can't rename {old} to {new}")
        df = self.scan(name).withColumnRenamed(old, new)
        m.columns = {new if c == old else c: t for c, t in m.columns.items()}
        m.pk = new if m.pk == old else m.pk
        self._rewrite(m, df)

    def _changeable(self, name: str) -> Manifest:
        m = self.manifest(name)
        if m.versioned:
            raise ValueError("the schema of a versioned table can't change")
        return m

    def _rewrite(self, m: Manifest, df: DataFrame) -> None:
        m.files = self.write(m.name, "data", df.select(*m.columns))
        m.version, m.indexes = m.version + 1, {}
        self.save(m)

    # rows

    def write(self, name: str, kind: str, df: DataFrame) -> list[str]:
        path = f"{self.root}/tables/{name}/{kind}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.files.parquet(path)

    def read(self, files: list[str], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def scan(self, name: str) -> DataFrame:
        m = self.manifest(name)
        return self.read(m.files, m.schema())

    def rows(self, m: Manifest, data: list[dict]) -> DataFrame:
        """Dictionaries as rows of the table: unknown keys are dropped, missing ones null, JSON values encoded."""

        def value(v: Any, kind: str) -> Any:
            kind = kind.split()[0]
            if v is None:
                return None
            if isinstance(v, dict | list):
                return json.dumps(v, default=str)
            return int(v) if kind == "INTEGER" else float(v) if kind == "REAL" else bool(v) if kind == "BOOLEAN" else str(v)

        return self.spark.createDataFrame([tuple(value(r.get(c), t) for c, t in m.columns.items()) for r in data], m.schema())

    def append(self, m: Manifest, df: DataFrame, *, unique: bool = True, keys: list | None = None) -> None:
        """New rows; a key already there, or twice in the batch, raises. A few ``keys`` given as values are looked up by
        the files' statistics instead of reading all keys."""
        if unique and keys is not None and len(keys) <= _FEW_KEYS:
            if len(set(keys)) < len(keys) or self.read(m.files, m.schema()).filter(F.col(m.pk).isin(keys)).select(m.pk).take(1):
                raise IntegrityError(f"repeated key in {m.name}")
        elif unique:
            keys = df.groupBy(m.pk).count()
            if keys.filter(F.col("count") > 1).take(1) or self.read(m.files, m.schema()).select(m.pk).join(keys, m.pk, "left_semi").take(1):
                raise IntegrityError(f"repeated key in {m.name}")
        m.files = m.files + self.write(m.name, "data", df.select(*m.columns))
        self.save(m)

    def change(self, m: Manifest, gone: DataFrame, fresh: DataFrame | None = None) -> None:
        """Without the rows of the keys in ``gone`` and with those of ``fresh``, rewriting only files that hold such a key."""
        keys = gone.select(F.col(gone.columns[0]).alias(m.pk)).distinct()
        held = self.read(m.files, m.schema()).select(m.pk, F.input_file_name().alias("_f"))
        touched = {r[0] for r in held.join(keys, m.pk, "left_semi").select("_f").distinct().collect()} if m.files else set()
        plain = lambda f: f.replace("file:///", "file:/")
        mine = [f for f in m.files if plain(f) in {plain(t) for t in touched}]
        kept = self.read(mine, m.schema()).join(keys, m.pk, "left_anti").select(*m.columns)
        new = kept if fresh is None else kept.unionByName(fresh.select(*m.columns))
        m.files = [f for f in m.files if f not in mine] + (self.write(m.name, "data", new) if mine or fresh is not None else [])
        self.save(m)

    def uncovered(self, m: Manifest, column: str) -> tuple[list, list[str]]:
        """Segments of a column's index with the files still there, and the files that none covers."""
        live = set(m.files)
        kept = [[path, [f for f in files if f in live]] for path, files in m.indexes.get(column, [])]
        kept = [s for s in kept if s[1]]
        covered = {f for _, files in kept for f in files}
        return kept, [f for f in m.files if f not in covered]

    def indexed(self, m: Manifest, column: str, embed: Any = None, hashed: bool = True, only: list[str] | None = None) -> TextIndex:
        """The column's index, brought up to the table's files (or to those in ``only``): new ones become a segment."""
        kept, new = self.uncovered(m, column)
        new = [f for f in new if only is None or f in only]
        if len(kept) >= _SEGMENTS and new:
            kept, new = [], m.files
        if new:
            path = f"{self.root}/tables/{m.name}/index/{uuid.uuid4().hex}"
            TextIndex.build(self.read(new, m.schema()), m.pk, column, path, embed, hashed)
            kept = [*kept, [path, new]]
        if kept != m.indexes.get(column, []):
            m.indexes[column] = kept
            self.save(m)
        kind = m.schema()[m.pk].dataType.simpleString()
        return TextIndex(self.spark, kind, [(path, [source(f) for f in files]) for path, files in kept], dense=embed is not None)

    def vacuum(self) -> int:
        """Deletes files that no manifest names; the bytes freed."""
        freed = 0
        for name in self.files.names(f"{self.root}/tables"):
            m = self.manifest(name) if name in self.tables() else None
            named = {f.rsplit("/", 2)[-2] for f in (m.files + m.log_files + m.baseline if m else [])} | {p.rsplit("/", 1)[-1] for x in (m.indexes.values() if m else ()) for p, _ in x}
            for kind in self.files.names(f"{self.root}/tables/{name}"):
                for part in self.files.names(f"{self.root}/tables/{name}/{kind}"):
                    if part not in named:
                        path = f"{self.root}/tables/{name}/{kind}/{part}"
                        freed += self.files.size(path)
                        self.files.delete(path)
        return freed
