"""History of tables: post-images in an append-only log, time travel, differences, rollback and a hash chain.

Log rows: ``_seq, _op`` (insert, update, delete)``, _ts, _author, pk, row_json, prev_hash, event_hash``; a delete keeps the
last image of the row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.rows import event_hash
from tessel.plans.shared import materialize

GENESIS = "0" * 64
LOG = "_seq long, _op string, _ts string, _author string, pk string, row_json string, prev_hash string, event_hash string"


def as_of(log: DataFrame, seq: int | None = None) -> DataFrame:
    """``pk, row_json`` of the rows there after event ``seq`` (or the last). One pre-aggregated maximum per key, no sort."""
    upto = log if seq is None else log.filter(F.col("_seq") <= seq)
    last = upto.groupBy("pk").agg(F.max_by(F.struct("_op", "row_json"), "_seq").alias("_l"))
    return last.filter("_l._op <> 'delete'").select("pk", "_l.row_json")


def latest(log: DataFrame, limit: int = 100) -> DataFrame:
    return log.orderBy(F.desc("_seq")).limit(limit)


def history(log: DataFrame, pk: str) -> DataFrame:
    return log.filter(F.col("pk") == pk).orderBy("_seq")


def head() -> Column:
    """Aggregate: the last sequence number, 0 of an empty log."""
    return F.coalesce(F.max("_seq"), F.lit(0))


def diff(log: DataFrame, from_seq: int, to_seq: int | None = None) -> DataFrame:
    """``diff_between`` of the states after two events."""
    return diff_between(as_of(log, from_seq), as_of(log, to_seq))


def diff_between(old: DataFrame, new: DataFrame) -> DataFrame:
    """``pk, change`` (added, removed, changed)``, before, after`` between two states (``pk, row_json``)."""
    a = old.select(F.col("pk").alias("pa"), F.col("row_json").alias("before"))
    b = new.select(F.col("pk").alias("pb"), F.col("row_json").alias("after"))
    change = F.when(F.col("pa").isNull(), "added").when(F.col("pb").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    j = a.join(b, F.col("pa") == F.col("pb"), "full_outer")
    return j.select(F.coalesce("pa", "pb").alias("pk"), change.alias("change"), "before", "after").filter("change is not null")


def rollback_plan(log: DataFrame, seq: int, current: DataFrame | None = None) -> DataFrame:
    """``pk, action, row_json``: what turns the current rows (``pk, row_json``; by default the log's last state) back into
    those after ``seq``; ``row_json`` is the image to write, of a delete the one that goes. Equal rows aren't listed."""
    return rollback_between(as_of(log) if current is None else current, as_of(log, seq))


def rollback_between(current: DataFrame, target: DataFrame) -> DataFrame:
    """``rollback_plan`` of two given states (``pk, row_json``)."""
    c = current.select(F.col("pk").alias("pc"), F.col("row_json").alias("jc"))
    t = target.select(F.col("pk").alias("pt"), F.col("row_json").alias("jt"))
    action = F.when(F.col("pt").isNull(), "delete").when(F.col("pc").isNull(), "insert").when(~F.col("jc").eqNullSafe(F.col("jt")), "update")
    j = c.join(t, F.col("pc") == F.col("pt"), "full_outer").select(F.coalesce("pc", "pt").alias("pk"), action.alias("action"), F.coalesce("jt", "jc").alias("row_json"))
    return j.filter("action is not null")


def events_of(plan: DataFrame) -> DataFrame:
    """A rollback plan as events in their order: deletes, inserts, updates, each by key (``n, _op, pk, row_json``)."""
    turn = F.element_at(F.create_map(F.lit("delete"), F.lit(0), F.lit("insert"), F.lit(1), F.lit("update"), F.lit(2)), "action")
    return plan.select(turn.alias("n"), F.col("action").alias("_op"), "pk", "row_json")


def _chain(batches: Iterator[pa.RecordBatch], prev: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        before, after = [], []
        for op, pk, row in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("_op", "pk", "row_json"))):
            before.append(prev)
            prev = hashlib.sha256("|".join(x or "" for x in (prev, op, pk, row)).encode()).hexdigest()
            after.append(prev)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before, pa.string()), pa.array(after, pa.string())], names=[*b.schema.names, "prev_hash", "event_hash"])


def chained(events: DataFrame, prev: str = GENESIS) -> DataFrame:
    """Events with ``prev_hash`` and ``event_hash`` in order of ``_seq``. Each hash needs the one before, so this is one
    stream through one task, holding a batch at a time; it runs over the events of one write, not over the log."""
    cols = ["_seq", "_op", "_ts", "_author", "pk", "row_json"]
    one = events.select(*cols).repartition(1).sortWithinPartitions("_seq")
    return one.mapInArrow(lambda it: _chain(it, prev), LOG)


def numbered(events: DataFrame, order: list[str], start: int) -> DataFrame:
    """Events with ``_seq`` after ``start`` without gaps in the given order: range-partitioned, with the counts of the
    partitions (one number each) added up on the driver."""
    sorted_ = materialize(events.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_m", 33)
    counts = {r.p: r.n for r in sorted_.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    offsets, total = [], start
    for p in sorted(counts):
        offsets.append((p, total))
        total += counts[p]
    if not offsets:
        return sorted_.drop("_m").withColumn("_seq", F.lit(0).cast("long")).limit(0)
    table = F.create_map(*[F.lit(x).cast("long") for o in offsets for x in o])
    return sorted_.withColumn("_seq", F.element_at(table, part) + F.col("_m").bitwiseAND((1 << 33) - 1) + 1).drop("_m")


_LINK = "first_seq long, first_prev string, last_seq long, last_hash string, broken long, events long"


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition: its ends and the first event that doesn't follow the one before."""
    first = last = broken = None
    n = 0
    for b in batches:
        n += b.num_rows
        for seq, prev, own, ok in zip(*(c.to_pylist() for c in b.columns)):
            if first is None:
                first = (seq, prev)
            elif broken is None and prev != last[1]:
                broken = seq
            if broken is None and not ok:
                broken = seq
            last = (seq, own)
    if first:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*first, *last, broken, n), kinds)], names=[x.split()[0] for x in _LINK.split(", ")])


def verify_chain(log: DataFrame, anchors: dict[int, str] | None = None) -> dict:
    """``{"valid", "first_broken", "checked"}`` (events). Hashes are recomputed row by row; links are checked inside range
    partitions, and between them on one row a partition. ``anchors``: hash at a sequence number up to which the log was
    pruned, which the first event left may follow."""
    ok = F.col("event_hash").eqNullSafe(event_hash(F.col("prev_hash"), F.col("_op"), F.col("pk"), F.col("row_json")))
    rows = log.select("_seq", "prev_hash", "event_hash", ok.alias("ok")).repartitionByRange("_seq").sortWithinPartitions("_seq")
    ends = sorted(rows.mapInArrow(_links, _LINK).collect(), key=lambda r: r.first_seq)
    broken = [r.broken for r in ends if r.broken is not None]
    last = None
    for r in ends:
        allowed = [last] if last is not None else [GENESIS, *[h for s, h in (anchors or {}).items() if s < r.first_seq]]
        if r.first_prev not in allowed:
            broken.append(r.first_seq)
        last = r.last_hash
    return {"valid": not broken, "first_broken": min(broken) if broken else None, "checked": sum(r.events for r in ends)}


def prune(log: DataFrame, before_seq: int) -> tuple[DataFrame, DataFrame, str | None]:
    """Events from ``before_seq`` on, the state that those before leave behind, and the hash to anchor the rest to.

    The state is kept (``pk, row_json``), so that later states and rollbacks still see rows last touched before the cut.
    """
    cut = log.filter(F.col("_seq") < before_seq)
    anchor = cut.agg(F.max_by("event_hash", "_seq")).first()[0]
    return log.filter(F.col("_seq") >= before_seq), as_of(cut), anchor


def as_of_with_baseline(log: DataFrame, baseline: DataFrame, seq: int | None = None) -> DataFrame:
    """``as_of`` of a pruned log: the baseline counts as events before all others."""
    base = baseline.select(F.lit(0).cast("long").alias("_seq"), F.lit("insert").alias("_op"), "pk", "row_json")
    return as_of(base.unionByName(log.select("_seq", "_op", "pk", "row_json")), seq)
