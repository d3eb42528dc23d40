"""Rebuilding current state from a change feed (problem 4)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.plans.shared import materialize

SET_OPS = ("add", "insert", "update", "upsert")
CLEAR_OPS = ("delete", "remove")
ROW_CLEAR_OPS = ("row_delete",)

#: Ids whose number differs only in so many low bits are replayed together; the number of slices grows with the feed.
SLICE_BITS = 12

_SET, _CLEAR, _ROW_CLEAR = 1, 2, 3
_PARTIAL = "app_table string, row_id long, column_name string, id long, live boolean, row_clear boolean"


def _plain(c):
    return F.lower(F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", ""))


def effective_entries(journal: DataFrame) -> DataFrame:
    """Deduplicated entries that change something: ``app_table, row_id, column_name, id, code``.

    Of entries with one ``id`` the one with the most retries counts (null is 0; of equals the greatest entry).
    Failed entries, entries without ``row_id`` or ``id`` and entries whose op changes no cell are left out.
    """
    entry = F.struct(F.coalesce("retries", F.lit(0)).alias("_t"), "app_table", "row_id", "column_name", _plain(F.col("op")).alias("op"), _plain(F.col("status")).alias("status"))
    one = journal.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max(entry).alias("_e")).select("id", "_e.*")
    has_column = F.col("column_name").isNotNull()
    code = (
        F.when(F.col("op").isin(*ROW_CLEAR_OPS), _ROW_CLEAR)
        .when(has_column & F.col("op").isin(*SET_OPS), _SET)
        .when(has_column & F.col("op").isin(*CLEAR_OPS), _CLEAR)
    )
    return (
        one.filter(F.col("row_id").isNotNull() & ~F.col("status").eqNullSafe("failed"))
        .withColumn("code", code.cast("int"))
        .filter(F.col("code").isNotNull())
        .select("app_table", "row_id", "column_name", "id", "code")
    )


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """State machine over entries sorted by row and id: the cells of the row in hand and its last row-wide clear."""
    names = [x.split()[0] for x in _PARTIAL.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
    out: list[tuple] = []
    key: tuple | None = None
    cells: dict[str, tuple[int, bool]] = {}
    cleared, applied = None, None

    def close() -> None:
        if key is None:
            return
        if cleared is not None:
            out.append((*key, None, cleared, False, True))
        out.extend((*key, col, i, live, False) for col, (i, live) in cells.items())

    def emit() -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [[]] * len(names)
        b = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types)], names=names)
        out.clear()
        return b

    for b in batches:
        for table, row, col, i, code in zip(*(c.to_pylist() for c in b.columns)):
            if (table, row) != key:
                close()
                key, cells, cleared, applied = (table, row), {}, None, None
                if len(out) > 20_000:
                    yield emit()
            if applied is not None and i <= applied:
                continue  # already applied
            applied = i
            if code == _ROW_CLEAR:
                cells, cleared = {}, i
            else:
                cells[col] = (i, code == _SET)
    close()
    yield emit()


def replay_changes(journal: DataFrame, *, applied: DataFrame | None = None, slice_bits: int = SLICE_BITS) -> DataFrame:
    """Live cells after all changes: ``app_table, row_id, column_name, id`` (the entry each came from).

    Entries are repartitioned by row and a slice of the sequence, sorted by sequence within partitions and replayed
    by a state machine that skips what it has applied. Slicing the sequence spreads a row that holds a large part of
    the feed over many tasks; each slice's outcome is one row per touched cell, and since a later entry decides a
    cell whatever came before, the outcomes of the slices merge by highest id against the row's last row-wide clear.

    ``applied`` (``app_table, row_id, applied_id``, at most one row each) makes the replay incremental: entries up to
    ``applied_id`` of their row are skipped.

    Defined cases: null ``app_table`` is a table of its own; a row-wide clear counts with or without column; an empty
    feed gives no cells; other columns of the feed are ignored.
    """
    todo = effective_entries(journal)
    if applied is not None:
        done = applied.select(F.col("app_table").alias("_at"), F.col("row_id").alias("_ar"), "applied_id")
        todo = (
            todo.join(done, F.col("app_table").eqNullSafe(F.col("_at")) & (F.col("row_id") == F.col("_ar")), "left")
            .filter(F.col("applied_id").isNull() | (F.col("id") > F.col("applied_id")))
            .drop("_at", "_ar", "applied_id")
        )
    slice_ = F.shiftright("id", slice_bits)
    parts = (
        todo.repartition(F.col("app_table"), F.col("row_id"), slice_)
        .sortWithinPartitions("app_table", "row_id", "id")
        .select("app_table", "row_id", "column_name", "id", "code")
        .mapInArrow(_replay, _PARTIAL)
    )
    return merged_cells(parts)


def merged_cells(parts: DataFrame) -> DataFrame:
    """Live cells from what slices of the sequence say: ``app_table, row_id, column_name, id, live, row_clear``, at most
    one row a slice and cell, and one with null column for its last row-wide clear."""
    # one row per touched column of a row (null column: row-wide clear), so the window holds at most a table's width
    merged = parts.groupBy("app_table", "row_id", "column_name", "row_clear").agg(F.max(F.struct("id", "live")).alias("_c"))
    of_row = Window.partitionBy("app_table", "row_id")
    return (
        merged.withColumn("_clear", F.max(F.when(F.col("row_clear"), F.col("_c.id"))).over(of_row))
        .filter(F.col("_c.live") & (F.col("_clear").isNull() | (F.col("_c.id") > F.col("_clear"))))
        .select("app_table", "row_id", "column_name", F.col("_c.id").alias("id"))
    )


def current_rows(journal: DataFrame) -> DataFrame:
    """``replay_changes`` with the text each live cell holds (``data`` of the entry it came from)."""
    live = materialize(replay_changes(journal), "live")
    # only entries of live cells bring their text
    rank = F.struct(F.coalesce("retries", F.lit(0)).alias("_t"), "app_table", "row_id", "column_name", _plain(F.col("op")).alias("op"), _plain(F.col("status")).alias("status"), "data")
    value = journal.join(live.select("id"), "id", "left_semi").groupBy("id").agg(F.max(rank).alias("_e"))
    return live.join(value.select("id", F.col("_e.data").alias("value")), "id").select("app_table", "row_id", "column_name", "id", "value")
