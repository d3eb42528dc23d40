"""Graph queries over a graph derived from the tables: customers and suppliers in nations, nations in regions, parts from suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.operators import graph as g
from tessel.plans.shared import materialize, stored
from tessel.query_sets.registry import register
from tessel.sources.tables import table

_EDGES = """e AS (SELECT 'c:' || c_custkey AS source_id, 'n:' || c_nationkey AS target_id, 'lives' AS type, 0.9 AS weight FROM customer
UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'sits', 0.7 FROM supplier UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'in', 0.8 FROM nation
UNION ALL SELECT 'p:' || l_partkey, 's:' || l_suppkey, 'from', least(1, count(*) / 4.0)::DOUBLE FROM lineitem GROUP BY l_partkey, l_suppkey)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """The graph's edges, derived once and kept, sorted by their ends."""
    return stored(spark, "edges", [table(spark, d, t) for t in ("customer", "supplier", "nation", "lineitem")], lambda: derived(spark, d), ["source_id", "target_id"])


def derived(spark: SparkSession, d: str) -> DataFrame:
    def e(df: DataFrame, a: str, source: str, b: str, target: str, kind: str, weight) -> DataFrame:
        return df.select(F.concat(F.lit(a), F.col(source).cast("string")).alias("source_id"), F.concat(F.lit(b), F.col(target).cast("string")).alias("target_id"), F.lit(kind).alias("type"), weight.alias("weight"))

    parts = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return (
        e(table(spark, d, "customer"), "c:", "c_custkey", "n:", "c_nationkey", "lives", F.lit(0.9))
        .union(e(table(spark, d, "supplier"), "s:", "s_suppkey", "n:", "s_nationkey", "sits", F.lit(0.7)))
        .union(e(table(spark, d, "nation"), "n:", "n_nationkey", "r:", "n_regionkey", "in", F.lit(0.8)))
        .union(e(parts, "p:", "l_partkey", "s:", "l_suppkey", "from", F.least(F.lit(1.0), F.col("n") / 4.0)))
    )


_BOTH = "b AS (SELECT source_id AS src, target_id AS dst, weight AS w, type FROM e UNION ALL SELECT target_id, source_id, weight, type FROM e)"


@register("graph_neighbors", f"WITH {_EDGES}, {_BOTH} SELECT dst AS neighbor, max(w) AS weight FROM b WHERE src = 'n:3' GROUP BY dst")
def graph_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return g.neighbors(edges(spark, d), "n:3").select("neighbor", "weight")


@register("graph_neighbors_of_all", f"WITH {_EDGES} SELECT source_id AS start, target_id AS neighbor, max(weight) AS weight FROM e WHERE type = 'from' GROUP BY ALL")
def graph_neighbors_all(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return g.neighbors(e, e.select(F.col("source_id").alias("id")), "out", "from").select("start", "neighbor", "weight")


@register("graph_degree", f"WITH {_EDGES}, {_BOTH} SELECT src AS id, count(*) AS degree, round(sum(w), 6) AS strength FROM b GROUP BY src")
def graph_degree(spark: SparkSession, d: str) -> DataFrame:
    b = g._directed(edges(spark, d), "both")
    return b.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"), F.round(F.sum("w"), 6).alias("strength"))


def _hops(start: str, depth: int, table_: str, limit: float) -> str:
    parts = [f"h0 AS (SELECT '{start}' AS node, 0.0::DOUBLE AS cost)"]
    parts += [f"h{i} AS (SELECT dst AS node, min(cost + 1 - w) AS cost FROM h{i - 1} JOIN {table_} ON src = node WHERE cost + 1 - w <= {limit} GROUP BY dst)" for i in range(1, depth + 1)]
    union = " UNION ALL ".join(f"SELECT node, {i} AS depth, cost FROM h{i}" for i in range(1, depth + 1))
    return ", ".join(parts) + f" SELECT node, min(depth)::INT AS depth, round(min(cost), 6) AS cost FROM ({union}) WHERE node <> '{start}' GROUP BY node"


def _walks(start: str, depth: int, table_: str, limit: float) -> str:
    """The least path of any walk, found by following all of them."""
    parts = [f"h0 AS (SELECT '{start}' AS node, 0.0::DOUBLE AS cost, '{start}' AS path)"]
    parts += [f"h{i} AS (SELECT dst AS node, cost + 1 - w AS cost, path || '>' || dst AS path FROM h{i - 1} JOIN {table_} ON src = node WHERE cost + 1 - w <= {limit})" for i in range(1, depth + 1)]
    union = " UNION ALL ".join(f"SELECT node, path FROM h{i}" for i in range(1, depth + 1))
    return ", ".join(parts) + f" SELECT node, min(path) AS path FROM ({union}) WHERE node <> '{start}' GROUP BY node"


@register("graph_traverse_paths", f"WITH {_EDGES}, {_BOTH}, {_walks('p:7', 3, 'b', 1.6 + 1e-9)}")
def graph_traverse_paths(spark: SparkSession, d: str) -> DataFrame:
    return g.traverse(edges(spark, d), "p:7", 3, "both", max_cost=1.6).select("node", "path")


@register("graph_neighbor_edges", f"WITH {_EDGES} SELECT source_id, target_id, type, weight FROM e WHERE source_id = 's:2' OR target_id = 's:2'")
def graph_neighbor_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges behind the neighbours (of no two to one neighbour here)."""
    return g.neighbors(edges(spark, d), "s:2").select("edge.*")


@register("graph_traverse", f"WITH {_EDGES}, {_BOTH}, {_hops('c:1', 3, 'b', 3.0 + 1e-9)}")
def graph_traverse(spark: SparkSession, d: str) -> DataFrame:
    return g.traverse(edges(spark, d), "c:1", 3, "both").select("node", "depth", F.round("cost", 6).alias("cost"))


@register("graph_traverse_bounded_cost", f"WITH {_EDGES}, o AS (SELECT source_id AS src, target_id AS dst, weight AS w FROM e), {_hops('p:1', 3, 'o', 1.2 + 1e-9)}")
def graph_traverse_out(spark: SparkSession, d: str) -> DataFrame:
    return g.traverse(edges(spark, d), "p:1", 3, "out", max_cost=1.2).select("node", "depth", F.round("cost", 6).alias("cost"))


def _rank_sql(rounds: int, alpha: float, seed: str | None) -> str:
    base = f"CASE WHEN id = '{seed}' THEN 1.0 ELSE 0.0 END" if seed else "1.0 / count(*) OVER ()"
    parts = [
        "u AS (SELECT source_id AS src, target_id AS dst, max(weight) AS w FROM e GROUP BY ALL)",
        "t AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM u)",
        f"v AS (SELECT id, {base} AS base, 1.0 / count(*) OVER () AS first, id NOT IN (SELECT src FROM t) AS leaf FROM (SELECT src AS id FROM u UNION SELECT dst FROM u))",
        "r0 AS MATERIALIZED (SELECT id, first::DOUBLE AS r, base, leaf FROM v)",
    ]
    for i in range(1, rounds + 1):
        parts.append(
            f"r{i} AS MATERIALIZED (SELECT v.id, {alpha} * (coalesce(m, 0) + loose * v.base) + (1 - {alpha}) * v.base AS r, v.base, v.leaf FROM v "
            f"LEFT JOIN (SELECT dst, sum(r * p) AS m FROM r{i - 1} JOIN t ON src = id GROUP BY dst) x ON x.dst = v.id, (SELECT coalesce(sum(r) FILTER (leaf), 0) AS loose FROM r{i - 1}))"
        )
    return ", ".join(parts) + f" SELECT id, round(r, 9) AS rank FROM r{rounds}"


@register("graph_pagerank", f"WITH {_EDGES}, {_rank_sql(20, 0.85, None)}")
def graph_pagerank(spark: SparkSession, d: str) -> DataFrame:
    return g.pagerank(edges(spark, d)).select("id", F.round("rank", 9).alias("rank"))


@register("graph_pagerank_joins", f"WITH {_EDGES}, {_rank_sql(20, 0.85, None)}")
def graph_pagerank_joins(spark: SparkSession, d: str) -> DataFrame:
    """The way of graphs too large for one task: a join a round."""
    return g.pagerank(edges(spark, d), one_task_edges=0).select("id", F.round("rank", 9).alias("rank"))


@register("graph_personalised_pagerank", f"WITH {_EDGES}, {_rank_sql(8, 0.15, 'p:1')}")
def graph_ppr(spark: SparkSession, d: str) -> DataFrame:
    seed = spark.createDataFrame([("p:1", 2.0)], "id string, weight double")
    return g.pagerank(edges(spark, d), personalization=seed, alpha=0.15, iterations=8).select("id", F.round("rank", 9).alias("rank"))


@register(
    "graph_components",
    """WITH k AS (SELECT 'k:' || id AS chunk, 'd:' || doc_id AS doc FROM doc_chunks WHERE doc_id IS NOT NULL) SELECT DISTINCT chunk AS id, min(doc) OVER (PARTITION BY doc) AS component FROM k UNION SELECT doc, doc FROM k""",
)
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "doc_chunks").filter("doc_id is not null")
    return g.connected_components(c.select(F.concat(F.lit("k:"), "id").alias("source_id"), F.concat(F.lit("d:"), "doc_id").alias("target_id")))


@register("graph_rule_edges", "SELECT DISTINCT 'orders:' || o_orderkey AS source_id, 'customer:' || c_custkey AS target_id, 'placed_by' AS type, 1.0::DOUBLE AS weight FROM orders JOIN customer ON o_custkey = c_custkey")
def graph_rule_edges(spark: SparkSession, d: str) -> DataFrame:
    return g.rule_edges(table(spark, d, "orders"), table(spark, d, "customer"), "orders", "customer", "o_orderkey", "c_custkey", "o_custkey", "c_custkey", "placed_by")


@register(
    "graph_sync_nodes",
    """SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'created' WHEN b.id IS NULL THEN 'removed' WHEN a.label = b.label THEN 'kept' ELSE 'updated' END AS change
FROM (SELECT 'customer:' || c_custkey AS id, c_mktsegment || '/' || c_nationkey AS label FROM customer WHERE c_custkey % 3 <> 0) a
FULL JOIN (SELECT 'customer:' || c_custkey AS id, c_mktsegment || '/' || CASE WHEN c_custkey % 7 = 0 THEN 99 ELSE c_nationkey END AS label FROM customer WHERE c_custkey % 5 <> 0) b ON a.id = b.id""",
)
def graph_sync_nodes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    old = g.entity_nodes(c.filter("c_custkey % 3 <> 0"), "customer", "c_custkey", "customer", "{c_mktsegment}/{c_nationkey}")
    changed = c.filter("c_custkey % 5 <> 0").withColumn("c_nationkey", F.when(F.col("c_custkey") % 7 == 0, 99).otherwise(F.col("c_nationkey")))
    return g.sync_nodes(old, g.entity_nodes(changed, "customer", "c_custkey", "customer", "{c_mktsegment}/{c_nationkey}"), "customer:").select("id", "change")


@register(
    "graph_decay",
    """SELECT o_orderkey, weight FROM (SELECT o_orderkey, CASE WHEN until < '2000-01-01' THEN round(greatest(w - 0.15, 0.05), 6) ELSE w END AS weight, until < '2000-01-01' AS old
FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS until, CASE WHEN o_orderstatus = 'F' THEN 0.1 ELSE 0.5 END AS w FROM orders)) WHERE NOT (old AND weight <= 0.05)""",
)
def graph_decay(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("valid_until"), F.when(F.col("o_orderstatus") == "F", 0.1).otherwise(0.5).alias("weight"))
    left, _ = g.decay(e, "2000-01-01")
    return left.select("o_orderkey", F.round("weight", 6).alias("weight"))


@register(
    "graph_distances",
    f"""WITH {_EDGES}, h0 AS (SELECT 'p:7' AS node, 0.0::DOUBLE AS cost), h1 AS (SELECT target_id AS node, min(cost + weight) AS cost FROM h0 JOIN e ON source_id = node GROUP BY 1),
h2 AS (SELECT target_id AS node, min(cost + weight) AS cost FROM h1 JOIN e ON source_id = node GROUP BY 1), h3 AS (SELECT target_id AS node, min(cost + weight) AS cost FROM h2 JOIN e ON source_id = node GROUP BY 1)
SELECT node, round(min(cost), 6) AS cost FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) GROUP BY node""",
)
def graph_distances(spark: SparkSession, d: str) -> DataFrame:
    return g.distances(edges(spark, d), "p:7").select("node", F.round("cost", 6).alias("cost"))


@register("graph_upsert", "SELECT 'n:' || n_nationkey AS id, CASE WHEN n_regionkey = 2 THEN 'new' ELSE n_name END AS label FROM nation UNION ALL SELECT 'x', 'new'")
def graph_upsert(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.concat(F.lit("n:"), "n_nationkey").alias("id"), F.col("n_name").alias("label"), "n_regionkey")
    new = n.filter("n_regionkey = 2").select("id", F.lit("new").alias("label")).union(spark.createDataFrame([("x", "new")], "id string, label string"))
    return g.upsert(n.select("id", "label"), new, ["id"])


@register("graph_delete_nodes", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def graph_delete_nodes(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    e = c.select(F.col("c_custkey").alias("source_id"), F.concat(F.lit("n"), "c_nationkey").alias("target_id"), "c_custkey", "c_nationkey").withColumn("source_id", F.concat(F.lit("c"), "source_id"))
    nodes = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"))
    _, left = g.delete_nodes(nodes, e, n.filter("n_regionkey = 1").select(F.concat(F.lit("n"), "n_nationkey").alias("id")))
    return left.select("c_custkey", "c_nationkey")


@register("graph_betweenness")
def graph_betweenness(spark: SparkSession, d: str) -> DataFrame:
    return g.betweenness(edges(spark, d))


@register("graph_communities")
def graph_communities(spark: SparkSession, d: str) -> DataFrame:
    """All nodes, those without edges (regions that no nation is in, say) too."""
    regions = table(spark, d, "region").select(F.concat(F.lit("r:"), "r_regionkey").alias("id"))
    return g.communities(edges(spark, d), regions)


@register("graph_modularity")
def graph_modularity(spark: SparkSession, d: str) -> DataFrame:
    """How good the communities are: the share of weight inside them less that expected by chance."""
    c = materialize(graph_communities(spark, d), "communities")
    return spark.createDataFrame([(c.select("community").distinct().count(), g.modularity(edges(spark, d), c))], "communities long, modularity double")


def _ppr_sql(seeds: dict[str, float], hops: int, rounds: int, alpha: float, limit: int) -> str:
    values = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in seeds.items())
    parts = [f"s AS (SELECT * FROM (VALUES {values}) t(id, sim))", "d0 AS (SELECT id, 0 AS depth FROM s)"]
    parts += [f"d{i} AS (SELECT DISTINCT dst AS id, {i} AS depth FROM d{i - 1} JOIN b ON src = id)" for i in range(1, hops + 1)]
    near = " UNION ALL ".join(f"SELECT * FROM d{i}" for i in range(hops + 1))
    parts += [
        f"i AS (SELECT id, min(depth) AS depth FROM ({near}) GROUP BY id)",
        "u AS (SELECT src, dst, max(w) AS w FROM b SEMI JOIN i x ON x.id = src SEMI JOIN i y ON y.id = dst GROUP BY ALL)",
        "t AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM u)",
        "v AS (SELECT i.id, depth, coalesce(sim, 0) AS sim, coalesce(sim, 0) / sum(sim) OVER () AS base, 1.0 / count(*) OVER () AS first, i.id NOT IN (SELECT src FROM t) AS leaf FROM i LEFT JOIN s ON s.id = i.id)",
        "r0 AS MATERIALIZED (SELECT id, first::DOUBLE AS r, base, leaf FROM v)",
    ]
    for k in range(1, rounds + 1):
        parts.append(
            f"r{k} AS MATERIALIZED (SELECT v.id, {alpha} * (coalesce(m, 0) + loose * v.base) + (1 - {alpha}) * v.base AS r, v.base, v.leaf FROM v "
            f"LEFT JOIN (SELECT dst, sum(r * p) AS m FROM r{k - 1} JOIN t ON src = id GROUP BY dst) x ON x.dst = v.id, (SELECT coalesce(sum(r) FILTER (leaf), 0) AS loose FROM r{k - 1}))"
        )
    return ", ".join(parts) + f" SELECT v.id, round(r, 9) AS score, depth, sim AS similarity FROM r{rounds} JOIN v USING (id) ORDER BY round(r, 12) DESC, v.id LIMIT {limit}"


@register("graph_search_ppr", f"WITH {_EDGES}, {_BOTH}, {_ppr_sql({'p:1': 0.9, 'p:2': 0.4}, 2, 20, 0.15, 10)}")
def graph_search_ppr(spark: SparkSession, d: str) -> DataFrame:
    seeds = spark.createDataFrame([("p:1", 0.9), ("p:2", 0.4)], "id string, similarity double")
    return g.search_graph_ppr(seeds, edges(spark, d), 2).withColumn("score", F.round("score", 9))


@register(
    "graph_search",
    f"""WITH {_EDGES}, {_BOTH}, s AS (SELECT * FROM (VALUES ('s:1', 0.9::DOUBLE), ('n:3', 0.4::DOUBLE)) t(id, similarity)),
n AS (SELECT src, dst, max(w) AS w FROM b SEMI JOIN s ON s.id = src GROUP BY ALL),
k AS (SELECT src, string_agg(dst, ',' ORDER BY w DESC, dst) AS neighbors FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) <= 6) GROUP BY src)
SELECT id, similarity, neighbors FROM s LEFT JOIN k ON src = id""",
)
def graph_search(spark: SparkSession, d: str) -> DataFrame:
    seeds = spark.createDataFrame([("s:1", 0.9), ("n:3", 0.4)], "id string, similarity double")
    return g.search_graph(seeds, edges(spark, d)).select("id", "similarity", F.array_join("neighbors", ",").alias("neighbors"))
