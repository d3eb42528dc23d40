"""Versioning over a log made of the events (user as key), changes and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.operators import journal, versioning
from tessel.plans.shared import shared_root, stored
from tessel.query_sets.problems import LIVE_CELLS
from tessel.query_sets.registry import register
from tessel.sources.tables import table
from tessel.streaming import changes

_LOG = "g AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'update' END AS op, user_id::VARCHAR AS pk, props AS j FROM events)"


def _at(share: float) -> str:
    return f"(SELECT floor(max(seq) * {share})::BIGINT FROM g)"


def _state(name: str, share: float | None) -> str:
    """The state after so much of the log."""
    upto = "" if share is None else f"WHERE seq <= {_at(share)}"
    return f"{name} AS (SELECT pk, j FROM (SELECT pk, arg_max(j, seq) AS j, arg_max(op, seq) AS op FROM g {upto} GROUP BY pk) WHERE op <> 'delete')"


def log(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "delete").otherwise("update")
    return table(spark, d, "events").select(
        F.col("event_id").alias("_seq"), op.alias("_op"), F.col("ts").cast("string").alias("_ts"), F.lit(None).cast("string").alias("_author"), F.col("user_id").cast("string").alias("pk"), F.col("props").alias("row_json")
    )


def seq_at(log_: DataFrame, share: float) -> int:
    return int((log_.agg(versioning.head()).first()[0] or 0) * share)


@register("version_as_of", f"WITH {_LOG}, {_state('s', 0.5)} SELECT pk, j AS row_json FROM s")
def version_as_of(spark: SparkSession, d: str) -> DataFrame:
    return versioning.as_of(log(spark, d), seq_at(log(spark, d), 0.5))


@register(
    "version_diff",
    f"WITH {_LOG}, {_state('a', 0.2)}, {_state('b', 0.9)} SELECT coalesce(a.pk, b.pk) AS pk, CASE WHEN a.pk IS NULL THEN 'added' WHEN b.pk IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.pk = b.pk WHERE a.j IS DISTINCT FROM b.j OR a.pk IS NULL OR b.pk IS NULL",
)
def version_diff(spark: SparkSession, d: str) -> DataFrame:
    g = log(spark, d)
    return versioning.diff(g, seq_at(g, 0.2), seq_at(g, 0.9)).select("pk", "change")


@register("version_log_tail", f"WITH {_LOG} SELECT seq, op, pk FROM g ORDER BY seq DESC LIMIT 100")
def version_log_tail(spark: SparkSession, d: str) -> DataFrame:
    return versioning.latest(log(spark, d)).select(F.col("_seq").alias("seq"), F.col("_op").alias("op"), "pk")


@register("version_history", f"WITH {_LOG} SELECT seq, op FROM g WHERE pk = '7'")
def version_history(spark: SparkSession, d: str) -> DataFrame:
    return versioning.history(log(spark, d), "7").select(F.col("_seq").alias("seq"), F.col("_op").alias("op"))


@register("version_head", f"WITH {_LOG} SELECT coalesce(max(seq), 0) AS head FROM g")
def version_head(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).agg(versioning.head().alias("head"))


@register(
    "version_rollback_plan",
    f"WITH {_LOG}, {_state('c', None)}, {_state('t', 0.6)} SELECT coalesce(c.pk, t.pk) AS pk, CASE WHEN t.pk IS NULL THEN 'delete' WHEN c.pk IS NULL THEN 'insert' ELSE 'update' END AS action, coalesce(t.j, c.j) AS row_json FROM c FULL JOIN t ON c.pk = t.pk WHERE c.j IS DISTINCT FROM t.j OR c.pk IS NULL OR t.pk IS NULL",
)
def version_rollback_plan(spark: SparkSession, d: str) -> DataFrame:
    return versioning.rollback_plan(log(spark, d), seq_at(log(spark, d), 0.6))


@register("version_pruned_state", f"WITH {_LOG}, {_state('s', None)} SELECT pk, j AS row_json FROM s")
def version_pruned_state(spark: SparkSession, d: str) -> DataFrame:
    chained = log(spark, d).withColumn("event_hash", F.lit("x"))
    rest, base, _ = versioning.prune(chained, seq_at(chained, 0.4))
    return versioning.as_of_with_baseline(rest, base)


@register("version_verify_chain", "SELECT * FROM (VALUES ('whole', true, -1::BIGINT), ('edited', false, 777::BIGINT), ('cut', false, 501::BIGINT)) t(log, valid, first_broken)")
def version_verify_chain(spark: SparkSession, d: str) -> DataFrame:
    whole = stored(spark, "chain", [table(spark, d, "events")], lambda: versioning.chained(log(spark, d)))  # hashed once
    edited = whole.withColumn("row_json", F.when(F.col("_seq") == 777, "{}").otherwise(F.col("row_json")))
    logs = {"whole": whole, "edited": edited, "cut": whole.filter("_seq <> 500")}
    found = {k: versioning.verify_chain(v) for k, v in logs.items()}
    return spark.createDataFrame([(k, v["valid"], -1 if v["first_broken"] is None else v["first_broken"]) for k, v in found.items()], "log string, valid boolean, first_broken long")


# changes

@register("change_last_op_wins", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def change_last_op_wins(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("n", F.col("event_id"))
    return journal.last_op_wins(e, ["user_id"], "n", "event_type", "event_id")


@register("change_status_counts", "SELECT coalesce(lower(trim(status)), 'pending') AS status, count(*) AS entries FROM journal GROUP BY 1")
def change_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return journal.status_counts(table(spark, d, "journal"))


@register("change_pending", "SELECT app_table, count(*) AS pending FROM journal WHERE coalesce(lower(trim(status)), 'pending') = 'pending' GROUP BY 1")
def change_pending(spark: SparkSession, d: str) -> DataFrame:
    return journal.pending_counts(table(spark, d, "journal"))


@register(
    "change_mirror",
    """SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT k, 'changed', k / 2 FROM (SELECT o_custkey AS k, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1) WHERE s <> 'F'""",
)
def change_mirror(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    op = F.when(F.col("o_orderstatus") == "F", "delete").otherwise("upsert")
    feed = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", op.alias("op"), F.lit("changed").alias("c_name"), (F.col("o_custkey") / 2).alias("c_acctbal"))
    return journal.apply_to_mirror(c, journal.last_op_wins(feed, ["c_custkey"], "o_orderkey", "op", "c_name", "c_acctbal"), "c_custkey")


@register("change_reconcile", "SELECT doc_id, 'ghost' AS state FROM (SELECT doc_id FROM doc_chunks WHERE doc_id IS NOT NULL EXCEPT SELECT id FROM docs) UNION ALL SELECT id, 'missing' FROM (SELECT id FROM docs EXCEPT SELECT doc_id FROM doc_chunks)")
def change_reconcile(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "docs").select(F.col("id").alias("doc_id"))
    return journal.reconcile(rows, table(spark, d, "doc_chunks").filter("doc_id is not null"), "doc_id")


# streams, each run over the events as a file source until nothing is left

def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    s = changes.file_stream(spark, d, schema, pattern="events.parquet")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"


def _run(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    return changes.drained(stream, _folder(spark), mode)


def _batches(spark: SparkSession, *parts: DataFrame) -> tuple[str, DataFrame]:
    """A folder with one file a part, in order, and the stream that reads one of them a micro-batch."""
    at = _folder(spark)
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(f"{at}/in")
    return at, changes.file_stream(spark, f"{at}/in", parts[0].schema)


@register("stream_tumbling", "SELECT epoch_us(date_trunc('hour', ts)) AS w, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = _run(spark, changes.windowed_counts(_stream(spark, d), "ts", "event_type", "value"), "complete")
    return out.select(F.unix_micros("window_start").alias("w"), "event_type", "n", F.round("total", 6).alias("total"))


@register("stream_sliding", "SELECT (h - k) * 1800000000 AS w, event_type, count(*) AS n FROM (SELECT epoch_us(ts) // 1800000000 AS h, event_type, unnest([0, 1]) AS k FROM events) GROUP BY ALL")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    out = _run(spark, changes.windowed_counts(_stream(spark, d), "ts", "event_type", "value", "1 hour", "30 minutes"), "complete")
    return out.select(F.unix_micros("window_start").alias("w"), "event_type", "n")


@register(
    "stream_sessions",
    """WITH a AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 7200000000 THEN 0 ELSE 1 END AS fresh FROM events),
b AS (SELECT user_id, t, sum(fresh) OVER (PARTITION BY user_id ORDER BY t) AS s FROM a) SELECT user_id, min(t) AS started, count(*) AS n FROM b GROUP BY user_id, s""",
)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = _run(spark, changes.sessions(_stream(spark, d), "ts", "user_id", "2 hours", "30 days"), "complete")
    return out.select("user_id", F.unix_micros("session_start").alias("started"), "n")


@register("stream_deduplicated", "SELECT DISTINCT user_id, event_type FROM events")
def stream_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, changes.deduplicated(_stream(spark, d), "ts", ["user_id", "event_type"], "1000 days").select("user_id", "event_type"), "append")


@register(
    "stream_late_rows",
    """WITH h AS (SELECT min(epoch_us(ts)) + (max(epoch_us(ts)) - min(epoch_us(ts))) // 2 AS half, max(epoch_us(ts)) AS last FROM events)
SELECT epoch_us(ts) // 3600000000 * 3600000000 AS w, event_type, count(*) AS n FROM events, h
WHERE NOT (event_id % 50 = 0 AND epoch_us(ts) < half) AND (epoch_us(ts) // 3600000000 + 1) * 3600000000 <= (last - 7200000000) // 1000 * 1000 GROUP BY ALL""",
)
def stream_late_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every fiftieth row of the first half comes after the second half: the watermark of two hours has passed it, so it
    is dropped; windows come out once, when the watermark has passed their end."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    lo, hi = e.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    late = (F.col("event_id") % 50 == 0) & (F.unix_micros("ts") < lo + (hi - lo) // 2)
    early = F.unix_micros("ts") < lo + (hi - lo) // 2
    _, s = _batches(spark, e.filter(~late & early), e.filter(~late & ~early), e.filter(late))
    out = _run(spark, changes.windowed_counts(s, "ts", "event_type", "value", late="2 hours"), "append")
    return out.select(F.unix_micros("window_start").alias("w"), "event_type", "n")


@register("stream_live_cells", f"WITH {LIVE_CELLS} SELECT * FROM live")
def stream_live_cells(spark: SparkSession, d: str) -> DataFrame:
    """The journal in four micro-batches without any order, so that entries come late and again with other outcomes."""
    j = table(spark, d, "journal")
    part = F.pmod(F.xxhash64("id", "retries", "status"), F.lit(4))
    at, s = _batches(spark, *[j.filter(part == i) for i in range(4)])
    cells = changes.LiveCells(spark, f"{at}/cells")
    cells.follow(s, f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return cells.cells()


@register("stream_mirror", "SELECT k AS c_custkey, n AS o_orderkey FROM (SELECT o_custkey AS k, max(o_orderkey) AS n, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1) WHERE s <> 'F'")
def stream_mirror(spark: SparkSession, d: str) -> DataFrame:
    """The last order of each customer unless that is closed, from changes that come latest first."""
    op = F.when(F.col("o_orderstatus") == "F", "delete").otherwise("upsert")
    feed = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", op.alias("op"))
    lo, hi = feed.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    a, b = lo + (hi - lo) * 2 // 3, lo + (hi - lo) // 3
    at, s = _batches(spark, feed.filter(F.col("o_orderkey") >= a), feed.filter((F.col("o_orderkey") >= b) & (F.col("o_orderkey") < a)), feed.filter(F.col("o_orderkey") < b))
    mirror = changes.Mirror(spark, f"{at}/mirror", feed.schema, ["c_custkey"], "o_orderkey")
    changes.mirror_stream(s, mirror, f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return mirror.rows()
