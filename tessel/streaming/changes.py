"""Change feeds as streams: applying micro-batches to a table, and windows over events."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessel.operators.changefeed import CLEAR_OPS, ROW_CLEAR_OPS, SET_OPS, SLICE_BITS, merged_cells
from tessel.sources.files import Files


def file_stream(spark: SparkSession, folder: str, schema: Any, files_per_batch: int = 1, pattern: str = "*.parquet") -> DataFrame:
    """A stream of the Parquet files that appear in a folder; the batch size is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).parquet(folder)


class Mirror:
    """The last change of each key, kept under ``path`` in buckets of the key, deletes included.

    Of changes of one key the one with the highest ``order`` counts (of equals the greatest), in whichever batch it comes;
    so late batches, repeated ones and restarts leave the same mirror. A batch rewrites only the buckets it touches: their
    new files are written beside the old ones, then a versioned manifest points to them. Defined cases: null keys are keys
    like others, a null ``order`` is before all others, an empty batch changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], order: str, op: str = "op", buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.order, self.op, self.buckets = spark, path, keys, order, op, buckets
        self.schema, self.files = schema, Files(spark)

    def _held(self) -> dict[str, str]:
        at = f"{self.path}/mirror.json"
        return json.loads(self.files.read(at)) if self.files.has(at) else {}

    def apply(self, batch: DataFrame, _: int = 0) -> None:
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rest = [f.name for f in self.schema if f.name not in (*self.keys, self.order)]
        last = lambda df: df.groupBy(*self.keys, "_bucket").agg(F.max(F.struct(self.order, *rest)).alias("_l")).select("_bucket", *self.keys, "_l.*")
        new = fresh = last(batch.select(*self.schema.names).withColumn("_bucket", bucket)).persist()
        try:
            touched = [str(r[0]) for r in new.select("_bucket").distinct().collect()]  # at most the number of buckets
            if not touched:
                return
            held, into = self._held(), f"{self.path}/{uuid.uuid4().hex}"
            old = [held[b] for b in touched if b in held]
            if old:
                kept = self.spark.read.schema(self.schema).parquet(*old).withColumn("_bucket", bucket)
                new = last(kept.unionByName(fresh.select("_bucket", *self.schema.names)))
            new.select("_bucket", *self.schema.names).repartition("_bucket").write.partitionBy("_bucket").parquet(into)
            self.files.write(f"{self.path}/mirror.json", json.dumps(held | {b: f"{into}/_bucket={b}" for b in touched}))
            for folder in old:
                self.files.delete(folder)
        finally:
            fresh.unpersist()

    def changes(self) -> DataFrame:
        """The last change of every key ever seen."""
        held = self._held()
        return self.spark.read.schema(self.schema).parquet(*held.values()) if held else self.spark.createDataFrame([], self.schema)

    def rows(self) -> DataFrame:
        """The rows there now, without ``op``."""
        return self.changes().filter(~F.col(self.op).eqNullSafe("delete")).drop(self.op)


def mirror_stream(changes: DataFrame, mirror: Mirror, checkpoint: str):
    """Keeps a mirror in step with a stream of changes."""
    return changes.writeStream.foreachBatch(mirror.apply).option("checkpointLocation", checkpoint)


_PARTIAL = "app_table string, row_id long, slice long, column_name string, row_clear boolean, id long, live boolean"


def _code(op: str | None, column: str | None) -> int:
    if op in ROW_CLEAR_OPS:
        return 3
    return 0 if column is None else 1 if op in SET_OPS else 2 if op in CLEAR_OPS else 0


def _cells(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State of a slice of a row: its entries, of one id that with the most retries. Puts out what the slice says of each
    column it ever touched and of the whole row (null column); a null id takes back what was said before."""
    entries: dict[int, tuple] = {i: (t, c, o, s) for i, t, c, o, s in zip(*state.get)} if state.exists else {}
    rank = lambda e: (e[0], *((x is not None, x or "") for x in e[1:]))
    for b in batches:
        for r in b.itertuples(index=False):
            text = [None if pd.isna(x) else x for x in (r.column_name, r.op, r.status)]
            e = (int(r.retries), *text)
            if r.id not in entries or rank(entries[r.id]) < rank(e):
                entries[int(r.id)] = e
    ids = sorted(entries)
    state.update((ids, *([entries[i][k] for i in ids] for k in range(4))))
    said: dict[str | None, tuple] = {c: (None, None) for _, c, o, _ in entries.values() if _code(o, c) in (1, 2)}
    for i in ids:
        _, c, o, s = entries[i]
        code = _code(o, c)
        if code == 3:
            said.setdefault(None, (None, None))
        if code and s != "failed":
            said[None if code == 3 else c] = (i, code == 1)
    n = len(said)
    yield pd.DataFrame({"app_table": [key[0]] * n, "row_id": [key[1]] * n, "slice": [key[2]] * n, "column_name": list(said), "row_clear": [c is None for c in said], "id": pd.array([i for i, _ in said.values()], "Int64"), "live": pd.array([v for _, v in said.values()], "boolean")})


def live_cells_stream(journal: DataFrame) -> DataFrame:
    """Of each row touched in a micro-batch what its slices of the sequence now say (update mode); ``LiveCells`` merges
    them. A slice holds a bounded number of ids, so a row that gets most of the feed is many state keys.

    As in the batch replay, entries of any order and any number of deliveries are judged by id and retries: one that comes
    again with more retries and another outcome takes the place of the first, also if that undoes it. An entry must come
    under the same row each time.
    """
    plain = lambda c: F.lower(F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", ""))
    some = journal.filter(F.col("row_id").isNotNull() & F.col("id").isNotNull())
    some = some.select("app_table", "row_id", F.shiftright("id", SLICE_BITS).alias("slice"), "id", F.coalesce("retries", F.lit(0)).cast("long").alias("retries"), "column_name", plain("op").alias("op"), plain("status").alias("status"))
    return some.groupBy("app_table", "row_id", "slice").applyInPandasWithState(
        _cells, _PARTIAL, "ids array<long>, retries array<long>, columns array<string>, ops array<string>, statuses array<string>", "update", GroupStateTimeout.NoTimeout
    )


class LiveCells:
    """The live cells of a journal read as a stream, kept under ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        schema = T.StructType.fromDDL(f"{_PARTIAL}, batch long")
        self.mirror = Mirror(spark, path, schema, ["app_table", "row_id", "slice", "column_name", "row_clear"], "batch", "none")

    def follow(self, journal: DataFrame, checkpoint: str):
        """A stream writer that keeps the cells in step with the journal."""
        apply = lambda b, n: self.mirror.apply(b.withColumn("batch", F.lit(n).cast("long")))
        return live_cells_stream(journal).writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint)

    def cells(self) -> DataFrame:
        """``app_table, row_id, column_name, id``."""
        return merged_cells(self.mirror.changes().filter("id is not null"))


def windowed_counts(events: DataFrame, ts: str, by: str, value: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Number and sum per tumbling or sliding window; rows later than the watermark are left out in a stream."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    g = events.withWatermark(ts, late).groupBy(window.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n", "total")


def sessions(events: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """One row per session: events of one key with no gap of that length."""
    g = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), by, "n")


def deduplicated(events: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns what it put out: in ``append`` mode the rows of all micro-batches, in
    ``complete`` mode those of the last. Each micro-batch is written to its own place in the folder, so one that is run
    again replaces itself."""
    spark, files = stream.sparkSession, Files(stream.sparkSession)
    at = lambda n: f"{folder}/out/{n:09d}"
    q = (
        stream.writeStream.outputMode(mode).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(at(n)))
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    parts = [f"{folder}/out/{n}" for n in files.names(f"{folder}/out")]
    if not parts:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(parts[-1:] if mode == "complete" else parts))
