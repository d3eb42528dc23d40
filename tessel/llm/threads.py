"""Rebuilding conversations from message rows (problem 5), by pointer jumping.

Every message points to the one before it in its session. ``resolve_threads`` follows these pointers for all rows at
once: each round joins the rows that still point somewhere to the rows they point to and takes over their pointers, so a
chain of n links is resolved in about log2(n) joins, however long one chain is and however much of the table it holds.
Rows that have arrived at a root take no more part but as targets. With the pointer goes what is known of the path
behind it; at the end each row knows the whole path from its root, a leaf that of the whole conversation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessel.plans.shared import materialize

#: Fixed by the statement of the problem: spellings of the roles.
ROLES = {"user": ("user", "human"), "assistant": ("assistant", "ai", "bot", "model"), "system": ("system",), "tool": ("tool", "function")}
_BLANK = r"^[ \t\r\n]*$"


def resolve_threads(
    nodes: DataFrame, key: str = "id", parent: str = "parent", *, value: Column | None = None, join: Callable[[Column, Column], Column] | None = None, keep: Sequence[str] = (), unique: bool = False
) -> DataFrame:
    """``key, root, depth, state`` of each row: ``ok``, ``orphan`` (the chain ends at a parent that isn't there) or
    ``cycle`` (it never ends; ``root`` and ``depth`` are null).

    With ``value`` and ``join`` (associative: rows followed by later rows) there is ``path``, the values from the root to
    the row joined in order. Columns in ``keep`` come along. Defined cases: a null parent is a root; an orphan chain's
    root is its first row; rows with a null key are left out and of rows repeated under one key the one with the least
    parent counts, unless ``unique`` says there are none; an empty table gives an empty one.
    """
    fold = join if value is not None and join is not None else None
    n = nodes.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(parent).alias("_ptr"), *([value.alias("_v")] if fold else []), *keep)
    rest = [c for c in n.columns if c not in ("_k", "_ptr")]
    if not unique:
        n = n.groupBy("_k").agg(F.min(F.struct(F.col("_ptr").isNull().alias("_n"), "_ptr", *rest)).alias("_r")).select("_k", "_r._ptr", *[f"_r.{c}" for c in rest])
    start = n.withColumns({"_d": F.when(F.col("_ptr").isNotNull(), 1).otherwise(0).cast("long"), "_root": F.col("_k"), "_orphan": F.lit(False)})
    seen, arrived, rounds = Observation(), [], 0
    counts = F.count("*").alias("rows"), F.count("_ptr").alias("going")  # taken while the rows are written
    state = materialize(start.observe(seen, *counts), "threads")
    total, going = seen.get.get("rows") or 0, F.col("_ptr").isNotNull()
    # as long as no chain without a cycle can be, some pointers of a cycle still go round
    while rounds <= total.bit_length() and seen.get.get("going"):
        every = reduce(DataFrame.unionByName, arrived, state)
        to = every.select(F.col("_k").alias("_tk"), F.col("_ptr").alias("_tptr"), F.col("_d").alias("_td"), F.col("_root").alias("_troot"), F.col("_orphan").alias("_torphan"), *([F.col("_v").alias("_tv")] if fold else []))
        lost = F.col("_tk").isNull()  # the last row passed is the first of an orphaned chain
        moved = state.filter(going).join(to, F.col("_ptr") == F.col("_tk"), "left").select(
            "_k",
            F.col("_tptr").alias("_ptr"),
            *([F.when(lost, F.col("_v")).otherwise(fold(F.col("_tv"), F.col("_v"))).alias("_v")] if fold else []),
            *keep,
            F.when(lost, F.col("_d") - 1).otherwise(F.col("_d") + F.col("_td")).alias("_d"),
            F.coalesce("_troot", "_root").alias("_root"),
            F.coalesce("_torphan", F.lit(True)).alias("_orphan"),
        )
        arrived.append(state.filter(~going))
        seen, rounds = Observation(), rounds + 1
        state = materialize(moved.observe(seen, *counts), "threads")
    return reduce(DataFrame.unionByName, arrived, state).select(
        F.col("_k").alias(key),
        F.when(~going, F.col("_root")).alias("root"),
        F.when(~going, F.col("_d")).alias("depth"),
        F.when(going, "cycle").when(F.col("_orphan"), "orphan").otherwise("ok").alias("state"),
        *([F.when(~going, F.col("_v")).alias("path")] if fold else []),
        *keep,
    )


def instant(ts: Column) -> Column:
    """Microseconds since 1970 of ISO-8601 text (UTC where it has no offset) or epoch milliseconds; null if unusable."""
    t = F.upper(F.regexp_replace(ts, r"^[ \t\r\n]+|[ \t\r\n]+$", ""))
    iso = t.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d{1,9})?)?(Z|[+-]\d\d(:?\d\d)?)?$")
    zoned = F.when(t.rlike(r"(Z|[+-]\d\d(:?\d\d)?)$") & t.rlike(r"[T ]\d\d:\d\d.*(Z|[+-]\d\d(:?\d\d)?)$"), t).otherwise(F.concat(t, F.lit("Z")))
    return F.when(iso, F.unix_micros(zoned.try_cast("timestamp"))).when(t.rlike(r"^\d{9,15}$"), t.try_cast("long") * 1000)


def speaker(role: Column) -> Column:
    """1 user, 2 assistant, 3 system, 4 tool; null for any other role."""
    r = F.lower(F.regexp_replace(role, r"^[ \t\r\n]+|[ \t\r\n]+$", ""))
    code = F.lit(None).cast("int")
    for i, names in enumerate(ROLES.values(), 1):
        code = F.when(r.isin(*names), i).otherwise(code)
    return code


_LINKED = "session string, id long, role int, k long, parent long, edge int"


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the rows of a sorted partition and points each to the one before if that is of its session. ``edge`` has
    bit 1 for the first row, whose predecessor is in another partition, and bit 2 for the last."""
    at, before = TaskContext.get().partitionId() << 33, None
    held: tuple | None = None

    def out(b: pa.RecordBatch, k: np.ndarray, parent: pa.Array, edge: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(k), parent, pa.array(edge)], names=[x.split()[0] for x in _LINKED.split(", ")])

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        session = b.column(0)
        k = np.arange(at, at + n)
        same = np.concatenate(([before is not None and session[0].as_py() == before], pc.equal(session[1:], session[:-1]).to_numpy(zero_copy_only=False)))
        edge = np.zeros(n, np.int32)
        edge[0] = before is None
        if held:
            yield out(*held)
        held = (b, k, pa.array(k - 1, mask=~same), edge)
        at, before = at + n, session[n - 1].as_py()
    if held:
        held[3][-1] |= 2
        yield out(*held)


def linked(rows: DataFrame, *order: str) -> DataFrame:
    """``session, id, role, k, parent`` of rows with these columns: ``k`` numbers all rows in order of session and
    ``order``, ``parent`` is the row before in the session. Rows are range-partitioned by the whole order, so a session of
    any share of the table is spread over as many partitions as it needs; pointers over the edge of a partition come
    from the first and last row of each."""
    ordered = rows.repartitionByRange("session", *order).sortWithinPartitions("session", *order)
    done = materialize(ordered.select("session", "id", "role").mapInArrow(_links, _LINKED), "linked")
    prev = Window.orderBy("k")  # over two rows a partition
    ends = done.filter("edge > 0").withColumns({"_s": F.lag("session").over(prev), "_k": F.lag("k").over(prev)}).filter("edge % 2 = 1")
    first = ends.withColumn("parent", F.when(F.col("_s") == F.col("session"), F.col("_k")))
    columns = ["session", "id", "role", "k", "parent"]
    return done.filter("edge % 2 = 0").select(*columns).unionByName(first.select(*columns))


def _alone(role: Column) -> Column:
    """What a path of one row is: its first and last role, first and last of user and assistant, and whether it is
    broken (a row without usable role or time, or a user turn that starts while the one before is unanswered)."""
    own = F.when(role.isin(1, 2), role).cast("byte")
    return F.struct(role.cast("byte").alias("first"), role.cast("byte").alias("last"), own.alias("first_ua"), own.alias("last_ua"), (role == 0).alias("broken"))


def _joined(a: Column, b: Column) -> Column:
    """Summary of rows followed by more rows of the same session. Adjacent user rows are one turn."""
    unanswered = (a["last_ua"] == 1) & (b["first_ua"] == 1) & ~((a["last"] == 1) & (b["first"] == 1))
    return F.struct(
        a["first"].alias("first"), b["last"].alias("last"), F.coalesce(a["first_ua"], b["first_ua"]).alias("first_ua"), F.coalesce(b["last_ua"], a["last_ua"]).alias("last_ua"),
        (a["broken"] | b["broken"] | F.coalesce(unanswered, F.lit(False))).alias("broken"),
    )


def message_rows(messages: DataFrame, *, session: str = "session_id", key: str = "id", role: str = "role", content: str = "content", ts: str = "ts") -> DataFrame:
    """``session, at, role, hash, id, blank`` of messages with session and id; ``role`` is 0 without usable role or time."""
    when = instant(F.col(ts))
    return messages.select(
        F.col(session).cast("string").alias("session"), F.coalesce(when, F.lit(0)).alias("at"),
        F.when(when.isNull(), 0).otherwise(F.coalesce(speaker(F.col(role)), F.lit(0))).alias("role"),
        F.unhex(F.md5(content)).alias("hash"), F.col(key).cast("long").alias("id"),
        (F.col(content).isNull() | F.col(content).rlike(_BLANK)).alias("blank"),
    ).filter(F.col("session").isNotNull() & F.col("id").isNotNull())


def threads(messages: DataFrame, **columns: str) -> DataFrame:
    """``k, session, id, root, depth, state, path`` of every message that isn't blank: each points to the one before in
    its session, of rows with equal instant, speaker and content the lowest id counts. ``root`` is the ``k`` of a row,
    ``session`` is given for roots only."""
    rows = message_rows(messages, **columns).filter(~F.col("blank"))
    once = rows.groupBy("session", "at", "role", "hash").agg(F.min("id").alias("id"))
    nodes = linked(once, "at", "id").withColumn("session", F.when(F.col("parent").isNull(), F.col("session")))
    return resolve_threads(nodes, "k", "parent", value=_alone(F.col("role")), join=_joined, keep=["session", "id"], unique=True)


def conversations(messages: DataFrame, **columns: str) -> DataFrame:
    """``session_id, turn_no, id`` of the rows of each kept conversation, ``turn_no`` from 0 in order of time and id: the
    paths from a root to its leaf.

    A session is dropped if a row that isn't blank has an unknown role or no usable time, if it has no user turn, an
    assistant row before the first one, or a user turn without an assistant row before the next one or the end.

    Defined cases: blank rows and rows without session or id are left out first; of rows with equal instant, speaker and
    content the lowest id stays; an empty table gives none; other columns are ignored.
    """
    t = threads(messages, **columns).filter("state = 'ok'")
    # the deepest row of a root is its leaf, whose path is the conversation: one pre-aggregated row a session
    leaves = t.groupBy("root").agg(F.max_by("path", "depth").alias("all"), F.max("session").alias("session_id"))
    kept = materialize(leaves.filter("not all.broken and all.first_ua = 1 and all.last_ua = 2").select("root", "session_id"), "kept")
    return t.join(kept, "root").select("session_id", F.col("depth").alias("turn_no"), "id")
