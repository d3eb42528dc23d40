"""Scans, predicates, joins, aggregates, windows, sorts, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.functions import rows, text, vectors
from tessel.operators.predicates import like, metadata_filter, optional
from tessel.plans.readonly import reads_only
from tessel.query_sets.registry import register
from tessel.sources.tables import table


def sql_query(name: str, sql: str, oracle: str | None = None, tables: str = "") -> None:
    """A query that is SQL on both sides, over views of the given tables."""

    @register(name, oracle or sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return spark.sql(sql.format(**{t: "{" + t + "}" for t in tables.split()}), **{t: table(spark, d, t) for t in tables.split()})


# scans

@register("scan_table", "SELECT * FROM nation")
def scan_table(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation")


@register("scan_point_lookup", "SELECT * FROM orders WHERE o_orderkey = 77")
def scan_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter(F.col("o_orderkey") == 77).limit(1)


@register("scan_multi_lookup", "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def scan_multi_lookup(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(wanted, "c_custkey", "left_semi")


@register("scan_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 1000")
def scan_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").offset(1000).limit(500)


@register("sql_with_parameters", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000")
def sql_with_parameters(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("SELECT c_custkey, c_name FROM {customer} WHERE c_mktsegment = ? AND c_acctbal > ?", args=["BUILDING", 5000], customer=table(spark, d, "customer"))


@register(
    "sql_read_only",
    """SELECT * FROM (VALUES ('select', true), ('with', true), ('explain', true), ('with_insert', false), ('insert', false), ('delete', false), ('drop', false), ('set', false)) t(statement, allowed)""",
)
def sql_read_only(spark: SparkSession, d: str) -> DataFrame:
    given = {
        "select": "SELECT 1", "with": "WITH a AS (SELECT 1 x) SELECT * FROM a", "explain": "EXPLAIN SELECT 1", "with_insert": "WITH a AS (SELECT 1 x) INSERT INTO t SELECT * FROM a",
        "insert": "INSERT INTO t VALUES (1)", "delete": "DELETE FROM t WHERE id = 1", "drop": "DROP TABLE t", "set": "SET a.b=1",
    }
    return spark.createDataFrame([(k, reads_only(spark, q)) for k, q in given.items()], "statement string, allowed boolean")


# predicates and projections

sql_query("filter_structured_query", "SELECT * FROM {part} WHERE p_size >= 40 AND p_brand = 'Brand#3' ORDER BY p_retailprice DESC, p_partkey LIMIT 100", "SELECT * FROM part WHERE p_size >= 40 AND p_brand = 'Brand#3' ORDER BY p_retailprice DESC, p_partkey LIMIT 100", "part")
sql_query("filter_count", "SELECT count(*) AS n FROM {orders} WHERE o_orderstatus = 'F' AND o_totalprice > 200000", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000", "orders")
sql_query("filter_modulo", "SELECT c_custkey, c_acctbal + 1 AS result FROM {customer} WHERE c_custkey % 2 = 0", "SELECT c_custkey, c_acctbal + 1 AS result FROM customer WHERE c_custkey % 2 = 0", "customer")


@register("filter_like_escaped", r"SELECT id, title FROM docs WHERE title ILIKE '%\_a%' ESCAPE '\' UNION ALL SELECT doc_id::VARCHAR, source FROM documents WHERE source ILIKE '%T\_L%' ESCAPE '\'")
def filter_like_escaped(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "docs").filter(like(F.col("title"), "_a")).select("id", "title")
    b = table(spark, d, "documents").filter(like(F.col("source"), "T_L")).select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"))
    return a.union(b)


@register(
    "filter_metadata",
    """SELECT doc_id FROM documents WHERE (lang IS NULL OR lang <> 'en') AND n_chars >= 100 AND n_chars < 5000 AND (source IN ('ticket', 'web_clip') OR source IS NULL OR workspace = 'ws-0001')""",
)
def filter_metadata(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents")
    where = {"lang": {"$ne": "en"}, "n_chars": {"$gte": 100, "$lt": 5000}, "$or": [{"source": {"$in": ["ticket", "web_clip", None]}}, {"workspace": "ws-0001"}]}
    return df.filter(metadata_filter(where, df.columns)).select("doc_id")


@register("filter_unknown_key_matches_nothing", "SELECT doc_id FROM documents WHERE false")
def filter_unknown_key(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents")
    return df.filter(metadata_filter({"nothing": 1, "n_chars": {"$near": 3}}, df.columns)).select("doc_id")


@register("filter_expired", "SELECT id, doc_id FROM doc_chunks WHERE content IS NOT NULL AND doc_id < '1100'")
def filter_expired(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_chunks").filter(F.col("content").isNotNull() & (F.col("doc_id") < "1100")).select("id", "doc_id")


@register("filter_optional", "SELECT doc_id, n_chars FROM documents WHERE workspace = 'ws-0001' AND n_chars >= 10")
def filter_optional(spark: SparkSession, d: str) -> DataFrame:
    return optional(table(spark, d, "documents"), 0, workspace="ws-0001", min_n_chars=10, lang=None).select("doc_id", "n_chars")


@register("project_metadata", """SELECT o_orderkey, json_extract_string(j, '$.o_orderstatus') AS status, json_extract_string(j, '$.o_custkey')::BIGINT AS cust, NOT json_exists(j, '$.o_orderpriority') AS dropped
FROM (SELECT o_orderkey, json_object('o_custkey', o_custkey, 'o_orderstatus', o_orderstatus) AS j FROM orders)""")
def project_metadata(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"o_orderkey": "INTEGER", "o_custkey": "INTEGER", "o_orderstatus": "TEXT", "o_orderpriority": "LONGTEXT", "o_totalprice": "REAL"}
    j = table(spark, d, "orders").select("o_orderkey", rows.metadata(kinds).alias("j"))
    return j.select("o_orderkey", F.get_json_object("j", "$.o_orderstatus").alias("status"), F.get_json_object("j", "$.o_custkey").cast("long").alias("cust"), F.get_json_object("j", "$.o_orderpriority").isNull().alias("dropped"))


@register("project_label", "SELECT id, coalesce(title, '') || ' by ' || coalesce(author, '') || '.' AS label FROM docs")
def project_label(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "docs")
    return df.select("id", rows.label("{title} by {author}{nothing}.", df.columns).alias("label"))


@register("project_merged_json", """SELECT event_id, json_merge_patch(props, '{"t":"x"}')::VARCHAR AS merged FROM events""")
def project_merged_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", rows.merged_properties(F.col("props"), F.lit('{"t": "x"}')).alias("merged"))


@register("project_case", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE o_orderkey END AS other FROM orders")
def project_case(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).otherwise(F.col("o_orderkey")).alias("other"))


# joins

@register(
    "join_group",
    "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
)
def join_group(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum(F.floor(F.col("o_totalprice") * 100 + 0.5)).alias("cents"))
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    j = o.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.sum("orders").alias("orders"), F.round(F.sum("cents") / 100, 2).alias("total"))


@register("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '2-HIGH')")
def join_semi(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_orderpriority = '2-HIGH'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@register("join_anti_missing", "SELECT id, doc_id FROM doc_chunks c WHERE NOT EXISTS (SELECT 1 FROM docs WHERE docs.id = c.doc_id)")
def join_anti(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_chunks").select("id", "doc_id").join(table(spark, d, "docs").select(F.col("id").alias("doc_id")), "doc_id", "left_anti")


@register("join_range_bucketed", """SELECT a.event_id, count(*) AS near FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR GROUP BY a.event_id""")
def join_range(spark: SparkSession, d: str) -> DataFrame:
    """A range join as an equi-join on the hour and the two after it."""
    e = table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    hour = 3_600_000_000
    a = e.select("event_id", "user_id", F.col("t").alias("ta"), F.explode(F.sequence(F.floor(F.col("t") / hour), F.floor(F.col("t") / hour) + 2)).alias("h"))
    b = e.select("user_id", F.col("t").alias("tb"), F.floor(F.col("t") / hour).alias("h"))
    return a.join(b, ["user_id", "h"]).filter((F.col("tb") > F.col("ta")) & (F.col("tb") <= F.col("ta") + 2 * hour)).groupBy("event_id").agg(F.count("*").alias("near"))


@register("join_full_outer", "SELECT coalesce(c_nationkey, s_nationkey) AS nation, c, s FROM (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_acctbal < 0 GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey")
def join_full_outer(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").filter("c_acctbal < 0").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("s"))
    return c.join(s, F.col("c_nationkey") == F.col("s_nationkey"), "full_outer").select(F.coalesce("c_nationkey", "s_nationkey").alias("nation"), "c", "s")


# aggregates; money is summed in whole cents, which is exact and, unlike decimals, primitive

sql_query("olap_full_scan", "SELECT count(*) AS n, round(avg(l_quantity), 6) AS avg_qty, round(sum(floor(l_extendedprice * 100 + 0.5)) / 100, 2) AS total FROM {lineitem}", "SELECT count(*) AS n, round(avg(l_quantity), 6) AS avg_qty, round(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE, 2) AS total FROM lineitem", "lineitem")
sql_query(
    "olap_group_by",
    "SELECT l_returnflag, l_linestatus, count(*) AS cnt, round(sum(floor(l_quantity * 100 + 0.5)) / 100, 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price FROM {lineitem} WHERE l_shipdate <= timestamp '2001-06-01' GROUP BY l_returnflag, l_linestatus ORDER BY cnt DESC",
    "SELECT l_returnflag, l_linestatus, count(*) AS cnt, round(sum(l_quantity::DECIMAL(18,2))::DOUBLE, 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY l_returnflag, l_linestatus ORDER BY cnt DESC",
    "lineitem",
)
sql_query("olap_filtered", "SELECT count(*) AS n, max(l_extendedprice) AS top FROM {lineitem} WHERE l_discount >= 0.05 AND l_quantity < 24", "SELECT count(*) AS n, max(l_extendedprice) AS top FROM lineitem WHERE l_discount >= 0.05 AND l_quantity < 24", "lineitem")
sql_query(
    "olap_join_multi_key",
    "SELECT c_mktsegment, o_orderpriority, count(*) AS n, round(sum(floor(l_extendedprice * 100 + 0.5)) / 100, 2) AS revenue FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey GROUP BY c_mktsegment, o_orderpriority",
    "SELECT c_mktsegment, o_orderpriority, count(*) AS n, round(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE, 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, o_orderpriority",
    "lineitem orders customer",
)
for _kind in ("CUBE", "ROLLUP"):
    _q = f"SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM {{t}} GROUP BY {_kind} (o_orderstatus, o_orderpriority)"
    sql_query(f"olap_{_kind.lower()}", _q.replace("{t}", "{orders}"), _q.replace("{t}", "orders"), "orders")
sql_query("olap_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", "lineitem")
sql_query("agg_max_or_zero", "SELECT coalesce(max(event_id), 0) AS head FROM {events} WHERE event_type = 'none such'", "SELECT coalesce(max(event_id), 0) AS head FROM events WHERE event_type = 'none such'", "events")


@register("agg_pivot", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY 1")
def agg_pivot(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count().fillna(0)


@register("agg_table_stats", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'messages', count(*) FROM messages UNION ALL SELECT 'journal', count(*) FROM journal")
def agg_table_stats(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t: table(spark, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("n"))
    return one("documents").union(one("messages")).union(one("journal"))


# windows and sorts

@register("window_latest_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def window_latest(spark: SparkSession, d: str) -> DataFrame:
    """The latest row per key as one pre-aggregated maximum instead of a window."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))


@register("window_rank_and_running", "SELECT o_orderkey, row_number() OVER w AS rn, round(sum(o_totalprice::DECIMAL(18,2)) OVER (w ROWS UNBOUNDED PRECEDING)::DOUBLE, 2) AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_rank(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    run = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("rn"), F.round(run.cast("double"), 2).alias("running"))


@register("window_lag_link", "SELECT event_id, coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id), -1) AS prev FROM events")
def window_lag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.coalesce(F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")), F.lit(-1)).alias("prev"))


@register("window_top_per_group", "SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn <= 3")
def window_top(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, d, "part").withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("p_brand", "p_partkey", "p_retailprice")


sql_query("sort_top_k", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", "orders")

# set operations

sql_query("set_union_all", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", "customer supplier")
sql_query("set_intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", "customer supplier")
sql_query("set_except", "SELECT o_custkey AS k FROM {orders} EXCEPT SELECT c_custkey FROM {customer} WHERE c_acctbal > 0", "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0", "orders customer")
sql_query(
    "set_recursive",
    "WITH RECURSIVE r(n_regionkey, hop, names) AS (SELECT n_regionkey, 1, n_name FROM {nation} WHERE n_nationkey = 0 UNION ALL SELECT r.n_regionkey, hop + 1, concat(names, '>', n_name) FROM r JOIN {nation} n ON n.n_nationkey = hop WHERE hop < 6) SELECT * FROM r",
    "WITH RECURSIVE r(n_regionkey, hop, names) AS (SELECT n_regionkey, 1, n_name FROM nation WHERE n_nationkey = 0 UNION ALL SELECT r.n_regionkey, hop + 1, names || '>' || n_name FROM r JOIN nation n ON n.n_nationkey = hop WHERE hop < 6) SELECT * FROM r",
    "nation",
)

# scalar functions

@register(
    "fn_plain_query",
    r"SELECT doc_id, array_to_string([x FOR x IN regexp_split_to_array(text, '[^\p{L}\p{N}_]+') IF x <> ''], ' OR ') AS q FROM documents",
)
def fn_plain_query(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.plain_query(F.col("text")).alias("q"))


@register("fn_sentences", r"SELECT doc_id, len([s FOR s IN regexp_split_to_array(regexp_replace(text, '([.!?])[ \t\r\x0b\f\n]+', E'\\1\n', 'g'), '\n+') IF trim(s, E' \t\n\r\x0b\f') <> '']) AS n FROM documents WHERE text IS NOT NULL")
def fn_sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.size(text.sentences(F.col("text"))).alias("n"))


@register("fn_fixed_pieces", "SELECT doc_id, list_aggregate([length(substr(text, i * 500 + 1, 500)) FOR i IN range(0, (length(text) + 499) // 500)], 'string_agg', ',') AS sizes FROM documents WHERE text <> ''")
def fn_fixed_pieces(spark: SparkSession, d: str) -> DataFrame:
    p = text.fixed_pieces(F.col("text"), 500)
    return table(spark, d, "documents").filter("text <> ''").select("doc_id", F.array_join(F.transform(p, lambda x: F.length(x).cast("string")), ",").alias("sizes"))


_WORDS = f"SELECT doc_id, unnest([w FOR w IN regexp_split_to_array(lower(text), '{vectors.SPACE}') IF w <> '']) AS w FROM documents WHERE text IS NOT NULL"


@register("fn_hash_embedding", f"SELECT doc_id, slot, round(c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)), 6) AS value FROM (SELECT doc_id, (('0x' || md5(w))::UHUGEINT % 384)::INT AS slot, count(*)::DOUBLE AS c FROM ({_WORDS}) GROUP BY ALL)")
def fn_hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    e = vectors.hash_embedding_rows(table(spark, d, "documents"), "doc_id", "text")
    return e.select("doc_id", "slot", F.round("value", 6).alias("value"))


@register("fn_event_hash", "SELECT event_id, sha256(concat_ws('|', '0', event_type, user_id, props)) AS h FROM events")
def fn_event_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", rows.event_hash(F.lit("0"), F.col("event_type"), F.col("user_id"), F.col("props")).alias("h"))


@register("fn_key_coercion", "SELECT id, coalesce(try_cast(CASE WHEN regexp_full_match(doc_id, '[0-9]+') THEN doc_id END AS BIGINT), -1) AS k FROM doc_chunks")
def fn_key_coercion(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_chunks").select("id", F.coalesce(rows.as_key(F.col("doc_id"), "INTEGER"), F.lit(-1)).alias("k"))
