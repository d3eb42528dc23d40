from pyspark.sql import functions as F

from tessel.operators.datadiff import normal_table_name, sync_diff, table_diff

SCHEMA = "store_id string, table_name string, synced_count long, pk_column string, synced_at string, sync_seq long"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_names(spark):
    given = [("a",), (' "Main"."Goals" ',), ("MAIN.tags",), ('main."x_y"\n',), ("domain.kv",), (None,), ('""',)]
    got = [r.n for r in spark.createDataFrame(given, "t string").select(normal_table_name(F.col("t")).alias("n")).collect()]
    assert got == ["a", "goals", "tags", "x_y", "domain.kv", None, ""]


def test_sync_diff_cases(spark):
    live = spark.createDataFrame([
        ("s", "a", 1, "id", None, 1), ("s", "a", 1, "id", None, 1), ("s", "A ", 2, "id", None, 2),
        ("s", "only", 1, "id", "x", 3), ("s", None, 9, "id", "x", 4), ("s", "n", None, None, None, 5), (None, "q", 1, "id", "t", 6),
    ], SCHEMA)
    replica = spark.createDataFrame([
        ("s", "main.a", 3, "uid", None, 7), ("s", "other", 1, "id", "x", 8), ("s", "n", None, None, None, 9), (None, "q", 1, "id", "u", 6),
    ], SCHEMA)
    got = {tuple(r) for r in sync_diff(live, replica).select("store_id", "table_name", "diff").collect()}
    assert got == {("s", "a", "synced_count"), ("s", "a", "pk_column"), ("s", "only", "only_live"), ("s", "other", "only_replica"), (None, "q", "synced_at")}


def test_empty_and_clashing_columns(spark):
    a = spark.createDataFrame([(1, "x", 5, True)], "k int, v string, left_value int, _l boolean")
    none = a.limit(0)
    assert rows(table_diff(a, none, ["k"], ["v"]), "k", "diff") == [(1, "only_live")]
    assert rows(table_diff(none, a, ["k"], ["v"]), "k", "diff") == [(1, "only_replica")]
    assert table_diff(none, none, ["k"], ["v"]).count() == 0
    b = spark.createDataFrame([(1, None, 5, True)], a.schema)
    assert rows(table_diff(a, b, ["k"], ["v"]), "diff", "left_value", "right_value") == [("v", "x", None)]
