"""Property graph operators over node and edge tables.

Nodes: ``id, label, type, domain, confidence, source, properties``; edges: ``source_id, target_id, type, weight`` and
what else there is. Iterative operators write each round to the shared folder, so no lineage grows and the loss of an
executor costs a re-read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tessel.functions import rows
from tessel.plans.shared import discard, materialize


def _directed(edges: DataFrame, direction: str = "out", kind: str | None = None) -> DataFrame:
    """``src, dst, w, type`` along the given direction; both directions as a union of two, never an OR in a join."""
    if direction not in ("out", "in", "both"):
        raise ValueError(f"unknown direction: {direction!r}")
    e = edges if kind is None else edges.filter(F.col("type") == kind)
    typed = F.col("type") if "type" in edges.columns else F.lit(None).cast("string")
    out = e.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), F.col("weight").alias("w"), typed.alias("type"))
    back = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w", "type")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def collapsed(edges: DataFrame, undirected: bool = False) -> DataFrame:
    """One ``src, dst, w`` per ordered (or unordered) pair: the greatest weight of parallel edges; null weighs 1."""
    e = _directed(edges)
    if undirected:
        e = e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w")
    return e.groupBy("src", "dst").agg(F.max(F.coalesce("w", F.lit(1.0))).alias("w"))


# keyed upserts and deletes -------------------------------------------------------------------------------------------


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``old`` with those of ``new`` in their place or beside them; of new rows with one key the last in order
    of all columns counts. Missing columns come out null."""
    fresh = new.groupBy(*keys).agg(F.max(F.struct(*[F.col(c) for c in new.columns])).alias("_n")).select("_n.*")
    return old.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh, allowMissingColumns=True)


def add_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Edges with new ones, unique by source, target and type. With ``nodes``, an edge to a missing node raises."""
    if nodes is not None:
        ends = new.select(F.col("source_id").alias("id")).union(new.select(F.col("target_id")))
        lost = ends.join(nodes.select("id"), "id", "left_anti").take(1)
        if lost:
            from tessel.types import IntegrityError

            raise IntegrityError(f"no such node: {lost[0][0]!r}")
    return upsert(edges, new, ["source_id", "target_id", "type"])


def update_properties(table: DataFrame, key: str, value: str, properties: Column, **fields: Column) -> DataFrame:
    """The row with its JSON properties merged and given fields set."""
    hit = F.col(key) == value
    table = table.withColumn("properties", F.when(hit, rows.merged_properties(F.col("properties"), properties)).otherwise(F.col("properties")))
    for name, v in fields.items():
        table = table.withColumn(name, F.when(hit, v).otherwise(F.col(name)))
    return table


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the given ids; edges of a deleted node go with it."""
    g = gone.select(F.col("id").alias("_g")).distinct()
    left = edges.join(g, F.col("source_id") == F.col("_g"), "left_anti").join(g, F.col("target_id") == F.col("_g"), "left_anti")
    return nodes.join(g, F.col("id") == F.col("_g"), "left_anti"), left


def decay(edges: DataFrame, now: str, step: float = 0.15, floor: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Edges after decay, and the expired ones: ``valid_until`` before ``now`` (as text) takes ``step`` off the weight,
    not below ``floor``; what is at the floor is deleted."""
    expired = F.col("valid_until").isNotNull() & (F.col("valid_until") < now)
    aged = edges.withColumn("weight", F.when(expired, F.greatest(F.col("weight") - step, F.lit(floor))).otherwise(F.col("weight")))
    return aged.filter(~(F.coalesce(expired, F.lit(False)) & (F.col("weight") <= floor))), edges.filter(expired)


# rules that derive a graph from tables -------------------------------------------------------------------------------


def entity_nodes(table: DataFrame, name: str, key: str, node_type: str, template: str) -> DataFrame:
    """One node ``table:key`` per row with its label."""
    return table.filter(F.col(key).isNotNull()).select(F.concat(F.lit(f"{name}:"), F.col(key).cast("string")).alias("id"), rows.label(template, table.columns).alias("label"), F.lit(node_type).alias("type")).dropDuplicates(["id"])


def sync_nodes(current: DataFrame, wanted: DataFrame, prefix: str) -> DataFrame:
    """``id, label, type, change`` (created, updated, removed, kept) of nodes under ``prefix`` against those wanted."""
    c = current.filter(F.col("id").startswith(prefix)).select(F.col("id").alias("ci"), F.col("label").alias("cl"), F.col("type").alias("ct"))
    j = c.join(wanted, F.col("ci") == F.col("id"), "full_outer")
    same = F.col("cl").eqNullSafe(F.col("label")) & F.col("ct").eqNullSafe(F.col("type"))
    change = F.when(F.col("ci").isNull(), "created").when(F.col("id").isNull(), "removed").when(same, "kept").otherwise("updated")
    return j.select(F.coalesce("id", "ci").alias("id"), F.coalesce("label", "cl").alias("label"), F.coalesce("type", "ct").alias("type"), change.alias("change"))


def rule_edges(source: DataFrame, target: DataFrame, source_name: str, target_name: str, source_key: str, target_key: str, source_column: str, target_column: str, edge_type: str) -> DataFrame:
    """Edges of weight 1 between rows whose columns are equal."""
    s = source.select(F.col(source_key).cast("string").alias("_s"), F.col(source_column).alias("_a"))
    t = target.select(F.col(target_key).cast("string").alias("_t"), F.col(target_column).alias("_b"))
    return s.join(t, F.col("_a") == F.col("_b")).select(
        F.concat(F.lit(f"{source_name}:"), "_s").alias("source_id"), F.concat(F.lit(f"{target_name}:"), "_t").alias("target_id"), F.lit(edge_type).alias("type"), F.lit(1.0).alias("weight")
    ).distinct()


# neighbourhoods ------------------------------------------------------------------------------------------------------


def neighbors(edges: DataFrame, start: str | DataFrame, direction: str = "both", kind: str | None = None) -> DataFrame:
    """``start, neighbor, weight, type, edge``: each neighbour once, by its heaviest edge (then the least type); ``edge`` has
    all columns of that edge.

    ``start`` is an id or a table with a column ``id``. An edge from a node to itself makes it its own neighbour.
    """
    whole = F.struct(*[F.col(c) for c in edges.columns])
    typed = edges if "type" in edges.columns else edges.withColumn("type", F.lit(None).cast("string"))
    e = typed if kind is None else typed.filter(F.col("type") == kind)

    def from_(a: str, b: str) -> DataFrame:
        near = e.filter(F.col(a).isNotNull())
        near = near.filter(F.col(a) == start) if isinstance(start, str) else near.join(start.select(F.col("id").alias(a)).distinct(), a, "left_semi")
        return near.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.col("weight").alias("w"), "type", whole.alias("edge"))

    ends = {"out": [("source_id", "target_id")], "in": [("target_id", "source_id")]}
    ends["both"] = ends["out"] + ends["in"]
    if direction not in ends:
        raise ValueError(f"unknown direction: {direction!r}")
    near = reduce(DataFrame.unionByName, [from_(*x) for x in ends[direction]])
    best = F.min_by(F.struct("w", "type", "edge"), F.struct(-F.coalesce("w", F.lit(0.0)), "type", "edge")).alias("_b")
    return near.groupBy("src", "dst").agg(best).select(F.col("src").alias("start"), F.col("dst").alias("neighbor"), F.col("_b.w").alias("weight"), F.col("_b.type").alias("type"), "_b.edge")


def traverse(edges: DataFrame, start: str | DataFrame, max_depth: int = 3, direction: str = "out", kind: str | None = None, max_cost: float = 3.0) -> DataFrame:
    """``start, node, depth, cost, path``: what is reached within ``max_depth`` steps and ``max_cost``, a step costing
    1 - weight. ``depth``, ``cost`` and ``path`` (ids joined by ``>``) are the least of any walk, each for itself; the start
    isn't part of the result.

    Of the walks to a node in so many steps those go on that no other one beats in both cost and path: one that does leads
    on wherever the other would, cheaper and under the lesser path. A hop joins the walks, whose size is known, to the edges.
    Defined cases: a null weight is 1; edges without one of their ends are left out; a start without edges reaches nothing.
    """
    if not 1 <= max_depth <= 10:
        raise ValueError("max_depth must be between 1 and 10")
    step, spark = _directed(edges, direction, kind).filter("src is not null and dst is not null").select("src", "dst", (1 - F.coalesce("w", F.lit(1.0))).alias("c")), edges.sparkSession
    begin = start.select(F.col("id").cast("string").alias("start")).distinct() if isinstance(start, DataFrame) else spark.createDataFrame(pa.table({"start": [start]}))
    front = begin.select("start", F.col("start").alias("node"), F.lit(0.0).alias("cost"), F.col("start").alias("path"))
    seen = []
    for depth in range(1, max_depth + 1):
        moved = front.join(step, front["node"] == step["src"]).select("start", F.col("dst").alias("node"), (F.col("cost") + F.col("c")).alias("cost"), F.concat_ws(">", "path", "dst").alias("path"))
        least = moved.filter(F.col("cost") <= max_cost + 1e-9).groupBy("start", "node", F.round("cost", 12).alias("cost")).agg(F.min("path").alias("path"))
        before = Window.partitionBy("start", "node").orderBy("path", "cost").rowsBetween(Window.unboundedPreceding, -1)
        unbeaten = least.withColumn("_m", F.min("cost").over(before)).filter("_m is null or cost < _m").drop("_m")
        front = materialize(unbeaten, "front")
        seen.append(front.withColumn("depth", F.lit(depth)))
    found = reduce(DataFrame.unionByName, seen).filter("node <> start").groupBy("start", "node").agg(F.min("depth").alias("depth"), F.min("cost").alias("cost"), F.min("path").alias("path"))
    done = materialize(found, "reached")
    for x in seen:
        discard(x)
    return done


# ranks ---------------------------------------------------------------------------------------------------------------


#: Most edges for which ranks are iterated in one task; larger graphs take a join a round.
ONE_TASK_EDGES = 1_000_000


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, personalization: DataFrame | None = None, alpha: float = 0.85, iterations: int = 20, *, tolerance: float | None = None, undirected: bool = False, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """``id, rank`` summing to 1. ``personalization``: ``id, weight``; a seed that is no node raises.

    Parallel edges count by the heaviest. Mass of nodes without outgoing edges goes where the restart goes. With
    ``tolerance`` the iteration ends when ranks move less than that times the number of nodes. The edges are
    normalised once; each round joins the ranks to them and sums by target. A graph of at most ``one_task_edges`` edges
    and as many nodes, counted first, is iterated by one task in memory instead.
    """
    e = materialize(collapsed(edges, undirected), "collapsed")
    if undirected:
        e = e.union(e.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    out = e.groupBy("src").agg(F.sum("w").alias("t"))
    ids = e.select(F.col("src").alias("id")).union(e.select("dst"))
    if nodes is not None:
        ids = ids.union(nodes.select("id"))
    ids = ids.distinct()
    e = materialize(e.join(out, "src").filter("t > 0").select("src", "dst", (F.col("w") / F.col("t")).alias("p")), "transitions")
    if personalization is not None:
        seeds = personalization.groupBy("id").agg(F.sum("weight").alias("s"))
        if seeds.join(ids, "id", "left_anti").take(1):
            raise ValueError("a personalization node is not in the graph")
        total = seeds.agg(F.sum("s")).first()[0]
        if not total:
            raise ValueError("personalization weights sum to zero")
        base = ids.join(seeds, "id", "left").select("id", (F.coalesce("s", F.lit(0.0)) / total).alias("base"))
    else:
        base = _uniform(ids)
    leaves = base.join(e.select(F.col("src").alias("id")).distinct().withColumn("_o", F.lit(True)), "id", "left")
    start = Observation()
    base = leaves.select("id", "base", F.col("_o").isNull().alias("leaf"))
    base = materialize(base.observe(start, F.count("*").alias("n"), F.coalesce(F.sum(F.col("leaf").cast("long")), F.lit(0)).alias("leaves")), "base")
    n = start.get["n"]
    if max(n, e.count()) <= one_task_edges:
        return _ranked_in_memory(e, base, alpha, iterations, tolerance)
    rank, loose = base.withColumn("rank", F.lit(1.0 / max(n, 1))), start.get["leaves"] / max(n, 1)
    written: DataFrame | None = None
    for _ in range(iterations):
        inflow = rank.join(e, rank["id"] == e["src"]).groupBy(F.col("dst").alias("_d")).agg(F.sum(F.col("rank") * F.col("p")).alias("m"))
        mass = F.coalesce("m", F.lit(0.0)) + F.lit(loose) * F.col("base")
        fresh = rank.join(inflow, rank["id"] == inflow["_d"], "left").select("id", "base", "leaf", (alpha * mass + (1 - alpha) * F.col("base")).alias("rank"), F.col("rank").alias("_before"))
        # what the next round needs to know of the ranks is summed while they are written
        seen = Observation()
        fresh = fresh.observe(seen, F.sum(F.when(F.col("leaf"), F.col("rank"))).alias("loose"), F.sum(F.abs(F.col("rank") - F.col("_before"))).alias("moved"))
        new = materialize(fresh.drop("_before"), "rank")
        discard(written)
        rank = written = new
        loose, moved = seen.get["loose"] or 0.0, seen.get["moved"] or 0.0
        if tolerance is not None and moved < tolerance * n:
            break
    discard(e)
    return rank.select("id", "rank")


def _ranked_in_memory(e: DataFrame, base: DataFrame, alpha: float, iterations: int, tolerance: float | None) -> DataFrame:
    def run(links: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        at = pd.Index(start["id"])
        src, dst, p = at.get_indexer(links["src"]), at.get_indexer(links["dst"]), links["p"].to_numpy(float)
        b, leaf, n = start["base"].to_numpy(float), start["leaf"].to_numpy(bool), len(start)
        r = np.full(n, 1.0 / max(n, 1))
        for _ in range(iterations):
            new = alpha * (np.bincount(dst, r[src] * p, n) + r[leaf].sum() * b) + (1 - alpha) * b
            moved, r = np.abs(new - r).sum(), new
            if tolerance is not None and moved < tolerance * n:
                break
        return pd.DataFrame({"id": start["id"], "rank": r})

    one = F.lit(0).alias("k")
    links, start = e.select(one, "src", "dst", "p").groupBy("k"), base.select(one, "id", "base", "leaf").groupBy("k")
    return links.cogroup(start).applyInPandas(run, f"id {base.schema['id'].dataType.simpleString()}, rank double")


def _uniform(ids: DataFrame) -> DataFrame:
    return ids.select("id", (1.0 / ids.agg(F.count("*").alias("_n")).scalar()).alias("base"))


# components, paths, communities --------------------------------------------------------------------------------------


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``id, component``, the component named by its least id, edges taken both ways.

    Alternates large-star and small-star: every node hands its neighbours the least id it sees. Rounds grow with the
    logarithm of the size, and a hub's neighbours are never listed in one task: stars use a minimum per node and a join.
    """
    pairs = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).filter("a is not null and b is not null")
    every = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    if nodes is not None:
        every = every.union(nodes.select("id"))
    e = materialize(pairs.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")

    def least(x: DataFrame) -> DataFrame:
        return x.groupBy("u").agg(F.min("v").alias("m"))

    while True:
        both = e.union(e.select("v", "u"))
        m = least(both).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        m2 = least(large)
        small = large.join(m2, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        new = materialize(small, "star")
        changed = new.exceptAll(e).take(1) or e.exceptAll(new).take(1)
        discard(e)
        e = new
        if not changed:
            break
    return every.distinct().join(e.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def shortest_path(edges: DataFrame, start: str, end: str, cost: Column | None = None) -> list[str] | None:
    """Ids of a directed path of least total cost (the weight by default), or None. Costs must not be negative."""
    found = distances(edges, start, cost=cost, end=end).filter(F.col("node") == end).select("path").take(1)
    return found[0].path if found else None


#: Rounds after which what improved since is merged into one table.
_MERGED = 8


def distances(edges: DataFrame, start: str, cost: Column | None = None, end: str | None = None) -> DataFrame:
    """``node, cost, previous`` of all nodes reached from ``start``. Each round relaxes only what improved in the one before
    and writes only what improves; rounds go on until nothing does. With ``end`` there is ``path`` as well, and nodes
    farther than the best way there found so far aren't followed. Edges without one of their ends are left out, a null weight
    is 1."""
    e = edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), (F.coalesce("weight", F.lit(1.0)) if cost is None else cost).alias("c")).filter("src is not null and dst is not null")
    if e.filter("c < 0").take(1):
        raise ValueError("negative costs")
    e = materialize(e.groupBy("src", "dst").agg(F.min("c").alias("c")), "costs")
    spark, more = edges.sparkSession, [] if end is None else ["path"]
    first = spark.createDataFrame([(start, 0.0, None, [start])], "node string, cost double, previous string, path array<string>")
    front = materialize(first.select("node", "cost", "previous", *more), "known")
    parts, bound = [front], 0.0 if start == end else float("inf")

    def known() -> DataFrame:
        every = reduce(DataFrame.unionByName, parts)
        return every.groupBy("node").agg(F.min(F.struct("cost", "previous", *more)).alias("_b")).select("node", "_b.*")

    while True:
        on = [F.concat("path", F.array("dst")).alias("path")] if more else []
        tried = front.join(e, front["node"] == e["src"]).select(F.col("dst").alias("node"), (F.col("cost") + F.col("c")).alias("cost"), F.col("src").alias("previous"), *on)
        tried = tried.filter(F.col("cost") < bound) if bound < float("inf") else tried
        best = tried.groupBy("node").agg(F.min(F.struct("cost", "previous", *more)).alias("_b")).select("node", "_b.*")
        old = known().select("node", F.col("cost").alias("_k"))
        front = materialize(best.join(old, "node", "left").filter("_k is null or cost < _k - 1e-12").drop("_k"), "better")
        n, there = front.agg(F.count("*"), F.min(F.when(F.col("node") == end, F.col("cost")))).first()
        if not n:
            break
        bound = bound if there is None else there
        parts.append(front)
        if len(parts) > _MERGED:
            old_parts, parts = parts, [materialize(known(), "known")]
            for x in old_parts[:-1]:  # the last is the front of the next round
                discard(x)
    done = materialize(known(), "distances")
    for x in (e, *parts):
        discard(x)
    return done


#: Most edges that are given to every task by ``betweenness``.
MOST_SMALL_EDGES = 10_000_000

#: Most different weights for which ``betweenness`` settles all nodes of a distance at once.
_MOST_WEIGHTS = 32


def betweenness(edges: DataFrame, nodes: DataFrame | None = None, normalized: bool = True, most_edges: int = MOST_SMALL_EDGES) -> DataFrame:
    """``id, betweenness`` on the undirected graph, weight as distance, exact. What hangs on the graph by one edge is
    folded into the node that carries it, its pairs are counted without a search. The other nodes are sources spread over
    the tasks, each with the whole edge list, so graphs of more than ``most_edges`` are refused. ``nodes`` adds those
    without edges, which count in the normalisation."""
    e = collapsed(edges, undirected=True).filter("src <> dst")
    if (n := e.count()) > most_edges:
        raise ValueError(f"{n} edges; betweenness takes at most {most_edges}")
    spark = edges.sparkSession
    if not n:
        found, size = spark.createDataFrame([], "id string, x double"), 0
    else:
        t = e.toArrow()
        ids = pc.unique(pa.chunked_array(t["src"].chunks + t["dst"].chunks))
        ids = ids.take(pc.sort_indices(ids))
        a, b = (pc.index_in(t[c], ids).to_numpy().astype(np.int64) for c in ("src", "dst"))
        w, size = t["w"].to_numpy().astype(float), len(ids)
        found = _between(spark, ids.to_pylist(), a, b, w)
    n = size
    if nodes is not None:
        alone = nodes.select("id").distinct().join(found, "id", "left_anti").withColumn("x", F.lit(0.0))
        n += alone.count()
        found = found.unionByName(alone)
    scale = (1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0) if normalized else 0.5
    return found.select("id", (F.col("x") * scale).alias("betweenness"))


def _between(spark: SparkSession, ids: list, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> DataFrame:
    """``id, x``: over all ordered pairs, the share of shortest paths that a node lies on."""
    size = len(ids)
    gone, many, hanging, squares, whole = _folded(a, b, size)
    apart = whole - 1 - hanging
    known = (whole - 1.0) ** 2 - squares - apart**2
    inner = ~(gone[a] | gone[b])
    kept = np.flatnonzero(~gone)
    number = np.cumsum(~gone) - 1
    a, b, w, many = number[a[inner]], number[b[inner]], w[inner], many[kept]
    order = np.argsort(src := np.r_[a, b], kind="stable")
    src, dst, w = src[order], np.r_[b, a][order].astype(np.int32), np.r_[w, w][order]
    ticks = np.rint(w * 1e6)
    even = not len(w) or bool((np.abs(w * 1e6 - ticks) < 1e-6).all() and ticks.min() > 0 and len(np.unique(ticks)) <= _MOST_WEIGHTS)
    if even:
        # neighbours by weight, as places of each node in one list
        graph = [(int(k), np.searchsorted(src[ticks == k], np.arange(len(kept) + 1)), dst[ticks == k]) for k in np.unique(ticks)]
    else:
        at = np.searchsorted(src, np.arange(len(kept) + 1))
        graph = [list(zip(dst[i:j].tolist(), w[i:j].tolist())) for i, j in itertools.pairwise(at.tolist())]
    sent = spark.sparkContext.broadcast((graph, many))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, many = sent.value
        total, search = np.zeros(len(many)), _dependencies_by_level if even else _dependencies
        for x in batches:
            for s in x["s"]:
                total += many[s] * search(graph, int(s), many)
        yield pd.DataFrame({"i": np.arange(len(many)), "x": total})

    tasks = max(1, min(len(kept), spark.sparkContext.defaultParallelism))
    sums = spark.range(len(kept)).select(F.col("id").alias("s")).repartition(tasks).mapInPandas(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x"))
    names = spark.createDataFrame(pd.DataFrame({"id": ids, "i": np.where(gone, -1, number), "y": known}), "id string, i long, y double")
    return names.join(sums, "i", "left").select("id", (F.col("y") + F.coalesce("x", F.lit(0.0))).alias("x"))


def _folded(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Takes away nodes with one edge until none is left. Which are gone; of each node how many it stands for, how many
    hang on it, the squares of what hangs on each of its edges, and the size of its component."""
    degree = np.bincount(np.r_[a, b], minlength=size).tolist()
    others = np.zeros(size, np.int64)
    np.bitwise_xor.at(others, a, b)
    np.bitwise_xor.at(others, b, a)
    other = others.tolist()
    many, squares, gone = [1] * size, [0.0] * size, [False] * size
    wait = [v for v in range(size) if degree[v] == 1]
    while wait:
        v = wait.pop()
        if degree[v] != 1:
            continue
        p, gone[v] = other[v], True
        other[p] ^= v
        degree[v], degree[p] = 0, degree[p] - 1
        many[p] += many[v]
        squares[p] += float(many[v]) ** 2
        if degree[p] == 1:
            wait.append(p)
    up = list(range(size))

    def top(v: int) -> int:
        while up[v] != v:
            up[v] = v = up[up[v]]
        return v

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    tops = np.array([top(v) for v in range(size)])
    stands = np.array(many, float)
    return np.array(gone), stands, stands - 1, np.array(squares), np.bincount(tops, minlength=size)[tops].astype(float)


def _dependencies_by_level(graph: list[tuple[int, np.ndarray, np.ndarray]], s: int, many: np.ndarray) -> np.ndarray:
    """``_dependencies`` where weights are few whole numbers: all nodes of one distance are settled together. Between two
    sets of nodes the neighbours of the set with fewer edges are looked at, those of most nodes as one sum over rows."""
    size = len(many)
    far = np.iinfo(np.int64).max
    dist, ways, x = np.full(size, far), np.zeros(size), np.zeros(size)
    dist[s], ways[s] = 0, 1.0

    def edges(v: np.ndarray, at: np.ndarray) -> int:
        return int((at[v + 1] - at[v]).sum())

    def given(v: np.ndarray, at: np.ndarray, dst: np.ndarray) -> np.ndarray:
        """Of all nodes the sum of ``x`` over their neighbours in ``v``."""
        i, n = _places(at, v)
        return np.bincount(dst[i], np.repeat(x[v], n), size)

    def taken(v: np.ndarray, at: np.ndarray, dst: np.ndarray) -> np.ndarray:
        """Of each node of ``v`` the sum of ``x`` over its neighbours."""
        out = np.zeros(size)
        if 2 * len(v) > size:
            some = np.flatnonzero(at[1:] > at[:-1])
            out[some] = np.add.reduceat(x[dst], at[some])
        elif len(some := v[at[v + 1] > at[v]]):
            i, n = _places(at, some)
            out[some] = np.add.reduceat(x[dst[i]], np.cumsum(n) - n)
        return out[v]

    levels, open_ = {}, {0: [np.array([s])]}
    while open_:
        d = min(open_)
        v = np.unique(np.concatenate(open_.pop(d)))
        v = v[dist[v] == d]
        if not len(v):
            continue
        levels[d], later = v, np.flatnonzero(dist > d)
        x[v] = ways[v]
        for k, at, dst in graph:
            ahead = later[dist[later] >= d + k]
            here, there = edges(v, at), edges(ahead, at)
            if not here or not there:
                continue
            new = given(v, at, dst)[ahead] if here <= 2 * there else taken(ahead, at, dst)
            u, new = ahead[new > 0], new[new > 0]
            closer = u[dist[u] > d + k]
            if len(closer):
                dist[closer], ways[closer] = d + k, 0.0
                open_.setdefault(d + k, []).append(closer)
            ways[u] += new
        x[v] = 0.0
    share, each = np.zeros(size), np.zeros(size)
    for d, v in reversed(levels.items()):
        for k, at, dst in graph:
            after = levels.get(d + k)
            if after is None:
                continue
            here, there = edges(v, at), edges(after, at)
            if not here or not there:
                continue
            x[after] = each[after]
            share[v] += (given(after, at, dst)[v] if 2 * there < here else taken(v, at, dst)) * ways[v]
            x[after] = 0.0
        each[v] = (many[v] + share[v]) / ways[v]
    share[s] = 0.0
    return share


def _dependencies(near: list[list[tuple[int, float]]], s: int, many: np.ndarray) -> np.ndarray:
    """How much each node lies on the shortest paths from ``s`` to as many nodes as each one stands for
    (accumulation from the farthest inwards)."""
    from heapq import heappop, heappush

    size = len(near)
    dist, ways, order = np.full(size, np.inf), np.zeros(size), []
    before: list[list[int]] = [[] for _ in range(size)]
    dist[s], ways[s] = 0.0, 1.0
    done, heap = np.zeros(size, bool), [(0.0, s)]
    while heap:
        d, v = heappop(heap)
        if done[v]:
            continue
        done[v] = True
        order.append(v)
        for u, w in near[v]:
            t = d + w
            if t < dist[u] - 1e-12:
                dist[u], ways[u], before[u] = t, ways[v], [v]
                heappush(heap, (t, u))
            elif abs(t - dist[u]) <= 1e-12 and not done[u]:
                ways[u] += ways[v]
                before[u].append(v)
    share = np.zeros(size)
    for v in reversed(order):
        for u in before[v]:
            share[u] += ways[u] / ways[v] * (many[v] + share[v])
    share[s] = 0.0
    return share


#: Up to so many edges a level of ``communities`` runs in one task, as arrays of numbers.
ONE_TASK_LEVEL_EDGES = 10_000_000


def communities(edges: DataFrame, nodes: DataFrame | None = None, one_task_edges: int = ONE_TASK_LEVEL_EDGES) -> DataFrame:
    """``id, community`` of all nodes (those of ``nodes`` without edges are each one of its own) on the undirected weighted graph by the Louvain method, deterministic: nodes move to the
    neighbouring community that raises modularity most until no move raises it, then communities become the nodes, until
    none of them moves either. Communities are named by their least member. Levels of up to ``one_task_edges`` are done
    in one task; above, a round moves nodes at once and is taken back for fewer of them where it doesn't raise modularity."""
    e = materialize(collapsed(edges, undirected=True).filter("src <> dst"), "links")
    both = e.union(e.select("dst", "src", "w")).toDF("src", "dst", "w")
    degree = materialize(both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")), "degree")
    total = degree.agg(F.sum("k")).first()[0]
    label = degree.select("id", F.col("id").alias("label"))
    while total and total > 0:
        if both.count() <= 2 * one_task_edges:
            moved, last = _louvain_in_memory(both, degree), True
        else:
            moved, last = _moved(both, degree, total)
        done = [label] if label.inputFiles() != degree.inputFiles() else []  # the first labels are the nodes themselves
        label = materialize(label.join(moved.toDF("_i", "_l"), F.col("label") == F.col("_i")).select("id", F.col("_l").alias("label")), "labels")
        if not last:
            to = lambda c: moved.toDF(c, f"_{c}")  # noqa: E731, B023
            done += [degree, both]
            degree = materialize(degree.join(moved, "id").groupBy(F.col("label").alias("id")).agg(F.sum("k").alias("k")), "degree")
            both = materialize(both.join(to("src"), "src").join(to("dst"), "dst").filter("_src <> _dst").groupBy(F.col("_src").alias("src"), F.col("_dst").alias("dst")).agg(F.sum("w").alias("w")), "both")
        for x in done:
            discard(x)
        if last:
            break
    names = label.groupBy("label").agg(F.min("id").alias("community"))
    found = label.join(names, "label").select("id", "community")
    if nodes is None:
        return found
    return found.unionByName(nodes.select("id").distinct().join(found, "id", "left_anti").select("id", F.col("id").alias("community")))


#: Least gain of a move, as a share of the node's weight: below, rounding could move nodes for ever.
_LEAST_GAIN = 1e-9


def _moved(both: DataFrame, degree: DataFrame, total: float) -> tuple[DataFrame, bool]:
    """``id, label`` when no move of a single node raises modularity any more, and whether nothing moved at all."""

    def quality(label: DataFrame) -> float:
        named = label.select("id", "label")
        inside = both.join(named.toDF("src", "_s"), "src").join(named.toDF("dst", "_d"), "dst").filter("_s = _d").agg(F.sum("w")).first()[0] or 0.0
        return inside / total - label.groupBy("label").agg(F.sum("k").alias("t")).agg(F.sum(F.pow(F.col("t") / total, 2))).first()[0]

    label, still, share, i = degree.select("id", F.col("id").alias("label"), "k"), True, 0.5, 0
    best = quality(label)
    while True:
        votes = both.join(label.select(F.col("id").alias("dst"), "label"), "dst").select(F.col("src").alias("id"), "label", "w")
        tally = votes.union(label.select("id", "label", F.lit(0.0))).groupBy("id", "label").agg(F.sum("w").alias("w"))
        weights = label.groupBy("label").agg(F.sum("k").alias("t"))
        own = label.select("id", F.col("label").alias("_own"), "k")
        scored = tally.join(own, "id").join(weights, "label").withColumn("s", F.col("w") - F.col("k") * (F.col("t") - F.when(F.col("label") == F.col("_own"), F.col("k")).otherwise(0.0)) / total)
        to = scored.groupBy("id").agg(F.min_by("label", F.struct(-F.col("s"), F.col("label"))).alias("_to"), (F.max("s") - F.max(F.when(F.col("label") == F.col("_own"), F.col("s")))).alias("gain"), F.first("k").alias("k"))
        moves = materialize(to.filter(F.col("gain") > _LEAST_GAIN * F.col("k")).select("id", "_to", "gain"), "moves")
        first = moves.orderBy(F.desc("gain"), "id").limit(1).collect()
        if not first:
            return label.select("id", "label"), still
        while True:
            i += 1
            some = moves.filter((F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1 << 20)) < share * (1 << 20)) | (F.col("id") == first[0].id))
            alone = some.limit(2).count() == 1
            new = materialize(label.join(some.select("id", "_to"), "id", "left").select("id", F.coalesce("_to", "label").alias("label"), "k"), "labels")
            now = quality(new)
            # a single move raises it by its gain, be that below what the sums can show
            if now > best or alone:
                break
            share /= 2
        discard(moves)
        label, best, still, share = new, now, False, min(0.5, 1.5 * share)


def _louvain_in_memory(both: DataFrame, degree: DataFrame) -> DataFrame:
    """The task gets numbers in place of ids, in order of the ids, and links and weights of nodes (``b`` -1) in one stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[x.to_numpy(zero_copy_only=False) for x in b.columns] for b in batches]
        if not parts:
            return
        a, b, w = (np.concatenate(x) for x in zip(*parts))
        del parts
        link = b >= 0
        k = np.zeros(int((~link).sum()))
        k[a[~link]] = w[~link]
        found = _louvain(a[link], b[link], w[link], k)
        for x in np.array_split(np.arange(len(k)), max(1, len(k) >> 16)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()), pa.array(found[x], pa.int32())], names=["i", "l"])

    number = materialize(degree.select("id", "k", (F.row_number().over(Window.orderBy("id")) - 1).alias("i")), "numbers")
    named = lambda c, i: number.select(F.col("id").alias(c), F.col("i").alias(i))
    links = both.filter("src < dst").join(named("src", "a"), "src").join(named("dst", "b"), "dst").select("a", "b", "w")
    every = links.union(number.select("i", F.lit(-1), "k"))
    moved = every.repartition(1).mapInArrow(run, "i int, l int").join(named("id", "i"), "i").join(named("label", "l"), "l")
    found = materialize(moved.select("id", "label"), "moved")
    discard(number)
    return found


def _louvain(a: np.ndarray, b: np.ndarray, w: np.ndarray, k: np.ndarray) -> np.ndarray:
    """A number of its community for each node; ``a, b, w`` has each undirected edge once, ``k`` a node's whole weight."""
    total, where = k.sum(), np.arange(len(k))
    names = where
    while True:
        n = len(k)
        src, near = np.r_[a, b].astype(np.int32), np.r_[b, a].astype(np.int32)
        order = np.lexsort((near, src))
        at, near, weight = np.r_[0, np.cumsum(np.bincount(src, minlength=n))], near[order], np.r_[w, w][order]
        del src, order
        label = _settled(at, near, weight, k, total)
        if (label == np.arange(n)).all():
            return names[where]
        kept, new = np.unique(label, return_inverse=True)
        where, names = new[where], names[kept]
        k = np.bincount(new, k, len(kept))
        a, b = np.minimum(new[a], new[b]), np.maximum(new[a], new[b])
        apart = a != b
        key, back = np.unique(a[apart] * len(kept) + b[apart], return_inverse=True)
        a, b, w = key // len(kept), key % len(kept), np.bincount(back, w[apart], len(key))


def _places(at: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the neighbours of the nodes stand, and how many each node has."""
    n = at[v + 1] - at[v]
    return np.repeat(at[v] - np.cumsum(n) + n, n) + np.arange(n.sum()), n


def _settled(at: np.ndarray, near: np.ndarray, weight: np.ndarray, k: np.ndarray, total: float) -> np.ndarray:
    """Labels of nodes that no move of a single one improves. Nodes are taken in blocks: the best move of each is found at
    once, then they are made one by one, each if it still raises modularity; a node waits for the next round if its
    neighbour of the same block moved or its own move no longer pays. The last round looks at all nodes and moves none."""
    n = len(k)
    label, of, waiting, moved = np.arange(n), k.astype(float), np.ones(n, bool), False
    most = min(1 << 16, max(64, len(near) >> 8))
    while True:
        todo = np.flatnonzero(waiting)
        if not len(todo):
            if not moved:
                return label
            waiting[:], moved = True, False
            continue
        cut = np.cumsum(at[todo + 1] - at[todo]) // most
        for v in np.split(todo, np.flatnonzero(np.diff(cut)) + 1):
            waiting[v] = False
            i, many = _places(at, v)
            if not len(i):
                continue
            u, pos = near[i], np.repeat(np.arange(len(v)), many)
            key = pos * n + label[u]
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sums, p, c = np.add.reduceat(weight[i[order]], first), key[first] // n, key[first] % n
            own, kv = label[v], k[v]
            here = c == own[p]
            stay = np.zeros(len(v))
            stay[p[here]] = sums[here]
            s = sums - kv[p] * (of[c] - np.where(here, kv[p], 0.0)) / total
            start = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            best = np.full(len(v), -np.inf)
            best[p[start]] = np.maximum.reduceat(s, start)
            go = best > stay - kv * (of[own] - kv) / total + _LEAST_GAIN * kv
            if not go.any():
                continue
            x = np.flatnonzero(go[p] & (s == best[p]))
            x = x[np.r_[True, p[x][1:] != p[x][:-1]]]  # of equal ones the least
            goes = np.zeros(n, bool)
            goes[v[go]] = True
            beside = np.flatnonzero(go[pos] & goes[u])
            also: dict[int, list[int]] = {}
            for q, y in zip(v[pos[beside]].tolist(), u[beside].tolist()):
                also.setdefault(q, []).append(y)
            done: set[int] = set()
            for q, o, to, w_to, w_own, kq in zip(v[p[x]].tolist(), own[p[x]].tolist(), c[x].tolist(), sums[x].tolist(), stay[p[x]].tolist(), kv[p[x]].tolist()):
                if not done.isdisjoint(also.get(q, ())) or w_to - kq * of[to] / total <= w_own - kq * (of[o] - kq) / total + _LEAST_GAIN * kq:
                    waiting[q] = True
                    continue
                of[o] -= kq
                of[to] += kq
                label[q] = to
                done.add(q)
            if done:
                moved, m = True, np.array(sorted(done))
                j, many = _places(at, m)
                waiting[near[j][label[near[j]] != np.repeat(label[m], many)]] = True


def modularity(edges: DataFrame, community: DataFrame) -> float:
    """Share of weight inside communities less that expected by chance."""
    e = collapsed(edges, undirected=True).filter("src <> dst")
    c = lambda a: community.select(F.col("id").alias(a), F.col("community").alias(f"c_{a}"))
    j = materialize(e.join(c("src"), "src").join(c("dst"), "dst").groupBy("c_src", "c_dst").agg(F.sum("w").alias("w")), "between")
    inside = j.agg(F.sum("w").alias("m"), F.sum(F.when(F.col("c_src") == F.col("c_dst"), F.col("w"))).alias("i")).first()
    if not inside.m:
        return 0.0
    degree = j.select(F.col("c_src").alias("c"), "w").union(j.select("c_dst", "w")).groupBy("c").agg(F.sum("w").alias("d"))
    return (inside.i or 0.0) / inside.m - degree.agg(F.sum(F.pow(F.col("d") / (2 * inside.m), 2))).first()[0]


# retrieval over a graph ----------------------------------------------------------------------------------------------


def search_graph(seeds: DataFrame, edges: DataFrame, hop_expansion: int = 3) -> DataFrame:
    """``id, similarity, neighbors``: seeds (``id, similarity``) best first, each with its ``2 * hop_expansion`` heaviest
    direct neighbours."""
    near = neighbors(edges, seeds)
    w = Window.partitionBy("start").orderBy(F.desc("weight"), "neighbor")
    near = near.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= 2 * hop_expansion)
    listed = near.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("_n", "neighbor"))).alias("_l")).select(F.col("start").alias("id"), F.transform("_l", lambda x: x["neighbor"]).alias("neighbors"))
    best = seeds.groupBy("id").agg(F.max("similarity").alias("similarity"))
    return best.join(listed, "id", "left").select("id", "similarity", F.coalesce("neighbors", F.array().cast("array<string>")).alias("neighbors")).orderBy(F.desc("similarity"), "id")


def search_graph_ppr(seeds: DataFrame, edges: DataFrame, hop_expansion: int = 3, alpha: float = 0.15, limit: int = 10, min_similarity: float = 0.0, iterations: int = 20) -> DataFrame:
    """``id, score, depth, similarity`` by personalised PageRank on the undirected graph within reach of the seeds."""
    best = seeds.filter(F.col("similarity") >= min_similarity).groupBy("id").agg(F.max("similarity").alias("similarity"))
    reach = traverse(edges, best, hop_expansion, "both", max_cost=float("inf")).groupBy(F.col("node").alias("id")).agg(F.min("depth").alias("depth"))
    inside = materialize(reach.join(best, "id", "left_anti").unionByName(best.select("id", F.lit(0).alias("depth"))), "reach")
    sub = edges.join(inside.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(inside.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    start = best.select("id", F.greatest("similarity", F.lit(1e-6)).alias("weight"))
    rank = pagerank(sub, inside.select("id"), start, alpha, iterations, undirected=True)
    return rank.join(inside, "id").join(best, "id", "left").select("id", F.col("rank").alias("score"), "depth", F.coalesce("similarity", F.lit(0.0)).alias("similarity")).orderBy(F.desc(F.round("score", 12)), "id").limit(limit)
