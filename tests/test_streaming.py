import datetime as dt
import random

from pyspark.sql import functions as F

from tessel.operators.changefeed import replay_changes
from tessel.streaming import changes

J = "id long, app_table string, row_id long, column_name string, op string, data string, metadata string, status string, error string, created_at string, retries long"


def test_live_cells_stream_agrees_with_batch(spark, tmp_path):
    """Entries in any order, delivered again with other outcomes, cleared cells; compared after every batch."""
    rnd = random.Random(3)
    one = lambda i, **kw: (i, rnd.choice("ab"), rnd.choice([1, 1, 2, None]), rnd.choice(["x", "y", None]), rnd.choice(["add", "UPDATE", " delete", "row_delete", "noop"]), "d", None, rnd.choice(["done", "Failed ", None]), None, None, 0)
    rows = [one(i * 97) for i in range(1, 200)]  # ids over several slices
    again = [(*r[:7], rnd.choice(["done", "failed", None]), None, None, rnd.choice([1, 2, None])) for r in rnd.sample(rows, 80)]
    rows += again + rnd.sample(rows, 30)
    rows += [(9_000_000, "a", 7, "x", "add", "d", None, "done", None, None, 0), (9_000_001, "a", 7, "x", "remove", "d", None, "done", None, None, 0), (None, "a", 7, "x", "add", "d", None, None, None, None, 0)]
    rnd.shuffle(rows)
    live, seen = changes.LiveCells(spark, f"file://{tmp_path}/cells"), 0
    assert live.cells().count() == 0
    for k in range(4):
        part = rows[k::4]
        seen += len(part)
        spark.createDataFrame(part, J).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live.follow(changes.file_stream(spark, str(tmp_path / "in"), J), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        got = [tuple(r) for r in live.cells().collect()]
        want = {tuple(r) for r in replay_changes(spark.createDataFrame([r for i in range(k + 1) for r in rows[i::4]], J)).collect()}
        assert len(got) == len(set(got)) and set(got) == want


def test_mirror_stream(spark, tmp_path):
    schema = "k long, v string, op string, n long"
    batches = [[(1, "a", "upsert", 1), (2, "b", "upsert", 2), (9, "old", "upsert", 0)], [(1, "c", "upsert", 9), (2, None, "delete", 5)], [(1, "late", "upsert", 3), (2, "late", "upsert", 4), (3, "d", "upsert", 6)]]
    m = changes.Mirror(spark, f"file://{tmp_path}/mirror", spark.createDataFrame([], schema).schema, ["k"], "n", buckets=4)
    assert m.rows().count() == 0
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(2):  # the second run finds nothing new
            changes.mirror_stream(changes.file_stream(spark, str(tmp_path / "in"), schema), m, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        m.apply(spark.createDataFrame(rows, schema))  # a batch that is applied again
        m.apply(spark.createDataFrame([], schema))
        assert {tuple(r) for r in m.rows().select("k", "v").collect()} == [{(1, "a"), (2, "b"), (9, "old")}, {(1, "c"), (9, "old")}, {(1, "c"), (9, "old"), (3, "d")}][n]


def test_windows_and_sessions(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    rows = [(t0 + dt.timedelta(minutes=m), u, float(m)) for m, u in [(0, "a"), (10, "a"), (59, "b"), (61, "a"), (200, "a"), (200, "a")]]
    df = spark.createDataFrame(rows, "ts timestamp, u string, v double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    want = {(r.window_start, r.u, r.n, r.total) for r in changes.windowed_counts(df, "ts", "u", "v").collect()}
    assert (t0, "a", 2, 10.0) in want and len(want) == 4
    s = changes.file_stream(spark, str(tmp_path / "in"), df.schema)
    out = changes.drained(changes.windowed_counts(s, "ts", "u", "v"), f"file://{tmp_path}/w1", "complete")
    assert {(r.window_start, r.u, r.n, r.total) for r in out.collect()} == want
    assert sorted(r.n for r in changes.sessions(df, "ts", "u").collect()) == [1, 1, 2, 2]
    once = changes.drained(changes.deduplicated(s, "ts", ["ts", "u"]), f"file://{tmp_path}/w2")
    assert once.count() == 5
    assert changes.windowed_counts(df, "ts", "u", "v", "1 hour", "30 minutes").agg(F.sum("n")).first()[0] == 12
