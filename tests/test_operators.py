import itertools
import json
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessel.functions import rows, scoring, text, vectors
from tessel.operators import graph as g
from tessel.operators import search, versioning
from tessel.operators.chunking import chunk_rows, chunks
from tessel.operators.predicates import like, metadata_filter
from tessel.operators.textindex import TextIndex
from tessel.sources.formats import retrieval_benchmark

# chunks


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["One two.", " ", "\n", "\n\n", "Is it? ", "word ", "x" * 30, "é!"]), max_size=40).map("".join), st.integers(8, 60))
def test_chunks_are_lossless_and_within_the_size(t, size):
    plain = chunks(t, size, overlap=False)
    assert "".join("".join(plain).split()) == "".join(t.split())
    assert all(len(c) <= size and c.strip() for c in plain)
    with_overlap = chunks(t, size)
    assert len(with_overlap) == len(plain) and all(c.endswith(p) for c, p in zip(with_overlap, plain))


def test_chunk_rules(spark):
    assert chunks("A b. C d.\n\nE f!", 100) == ["A b. C d.\n\nE f!"]
    assert chunks("Aaaa bbbb. Cccc dddd. Eeee ffff.", 22) == ["Aaaa bbbb. Cccc dddd.", "Cccc dddd. Eeee ffff."]
    assert [len(c) for c in chunks("x" * 5000, overlap=False)] == [1200] * 4 + [200] and chunks(" \n") == [] == chunks(None)
    with pytest.raises(ValueError):
        chunks("a", 0)
    df = spark.createDataFrame([(1, "Aaaa bbbb. Cccc dddd. Eeee ffff.", "c"), (2, None, "c"), (3, "", "c")], "id int, t string, content string")
    assert [tuple(r) for r in chunk_rows(df, "id", "t", 22).orderBy("chunk_seq").collect()] == [(1, 0, "Aaaa bbbb. Cccc dddd."), (1, 1, "Cccc dddd. Eeee ffff.")]


# functions


def test_functions(spark):
    df = spark.createDataFrame([(None,), ("",), ("Déjà-vu, ÉTÉ 2x!́",), ("a b A",)], "t string")
    assert [r[0] for r in df.select(text.tokens(F.col("t"))).collect()] == [[], [], ["deja", "vu", "ete", "2x"], ["a", "b", "a"]]
    assert df.select(text.plain_query(F.col("t"))).collect()[3][0] == "a OR b OR A"
    for r in df.select("t", vectors.hash_embedding(F.col("t")).alias("v")).collect():
        assert r.v == pytest.approx(vectors.embed_hash(r.t)) and len(r.v) == 384
    one = spark.range(1).select(
        vectors.distance(vectors.vector([1, 2]), vectors.vector([3, 2])).alias("l2"), vectors.distance(vectors.vector([1, 0]), vectors.vector([0, 2]), "cosine").alias("cos"),
        vectors.distance(vectors.vector([1, 1]), vectors.vector([2, 3]), "ip").alias("ip"), vectors.distance(vectors.vector([0, 0]), vectors.vector([2, 3]), "cosine").alias("zero"),
        text.fixed_pieces(F.lit("abcde"), 2).alias("p"), text.paragraphs(F.lit("a \n \n b\n\n\n")).alias("q"),
        rows.merged_properties(F.lit('{"a": "1", "b": "2"}'), F.lit('{"b": "3"}')).alias("m"), rows.merged_properties(F.lit(None).cast("string"), F.lit("{}")).alias("e"),
    ).first()
    assert (one.l2, one.cos, one.ip, one.zero, one.p, one.q, json.loads(one.m), one.e) == (4, 1, -4, 1, ["ab", "cd", "e"], ["a", "b"], {"a": "1", "b": "3"}, "{}")
    now = F.lit("2026-03-01T00:00:00Z").cast("timestamp")
    t = spark.createDataFrame([("2026-03-01T00:00:00Z",), ("2026-01-30T00:00:00Z",), ("2027-01-01T00:00:00Z",), ("x",), (None,)], "ts string")
    assert [r[0] for r in t.select(scoring.recency(F.col("ts"), now)).collect()] == pytest.approx([1, 0.5, 1, 0, 0])
    with pytest.raises(ValueError):
        vectors.distance(F.lit(1), F.lit(2), "hamming")


def test_predicates(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, None, 7), (3, "b%", None)], "id int, s string, n int")
    ids = lambda w: [r.id for r in df.filter(metadata_filter(w, df.columns)).orderBy("id").collect()]
    assert ids({}) == ids(None) == [1, 2, 3] and ids({"s": "a"}) == [1] and ids({"s": None}) == [2] and ids({"s": {"$ne": "a"}}) == [2, 3]
    assert ids({"n": {"$gt": 4, "$lte": 5}}) == [1] and ids({"n": {"$nin": [5]}}) == [2, 3] and ids({"n": {"$in": [7, None]}}) == [2, 3] and ids({"n": {"$in": []}}) == []
    assert ids({"x": 1}) == ids({"n": {"$like": 1}}) == ids({"$or": []}) == [] and ids({"$or": [{"s": "a"}, {"n": 7}]}) == [1, 2] and ids({"$and": [{"s": "a"}, {"n": 7}]}) == []
    assert [r.id for r in df.filter(like(F.col("s"), "B%")).collect()] == [3]


def test_merged_properties_keep_their_types(spark):
    given = [('{"k": 1, "a": [1, {"x": null}], "s": "q"}', '{"z": 2.5, "k": true}', {"k": True, "a": [1, {"x": None}], "s": "q", "z": 2.5}), (None, '{"z": 1}', {"z": 1}), ('{"k": "1"}', None, {"k": "1"}), ("bad", "{}", {})]
    df = spark.createDataFrame([(a, b) for a, b, _ in given], "a string, b string")
    assert [json.loads(r[0]) for r in df.select(rows.merged_properties(F.col("a"), F.col("b"))).collect()] == [c for *_, c in given]


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "x", 2), ("q", "b", 3)], "query string, item string, rank int")
    judged = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 1), ("p", "a", 1), ("z", "a", 0)], "query string, item string, grade int")
    m = {r.query: r for r in scoring.ranking_metrics(ranked, judged, 3).collect()}
    ideal = 3 + 1 / 1.584962500721156 + 0.5
    assert m["q"].ndcg == pytest.approx((1 + 3 / 2) / ideal) and m["q"].recall == pytest.approx(2 / 3) and m["q"].precision == pytest.approx(2 / 3) and m["q"].mrr == 1
    assert m["p"].ndcg == 0 == m["p"].mrr and m["z"].ndcg is None


# search


def test_index_and_batches(spark, tmp_path, monkeypatch):
    docs = [(i, " ".join(random.Random(i).choices("alpha beta gamma delta eps zeta".split(), k=i % 9))) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(docs, "id int, t string")
    TextIndex.build(df, "id", "t", f"file://{tmp_path}/ix")
    index = TextIndex(spark, "int", [(f"file://{tmp_path}/ix", None)])
    for q in ("alpha zeta", "beta beta", "nothing", ""):
        a = {r.pk: round(r.score, 9) for r in search.bm25(df, "id", "t", q).collect()}
        b = {r.pk: round(r.score, 9) for r in search.bm25(df, "id", "t", q, index=index).collect()}
        assert b == {r.pk: round(r.score, 9) for r in search.batch_bm25(df, "id", "t", spark.createDataFrame([(1, q)], "query int, text string"), index=index).collect()}
        near = {r.pk: round(r.distance, 9) for r in index.distances(q).collect()}
        assert near == {r.id: round(r.d, 9) for r in df.select("id", vectors.hash_distance(F.col("t"), q).alias("d")).collect()}
        c = {r.pk: round(r.score, 9) for r in search.batch_bm25(df, "id", "t", spark.createDataFrame([(1, q)], "query int, text string")).collect()}
        assert a == b == c and (not a) == (q in ("nothing", ""))
    some = df.filter("id < 20").select(F.col("id").alias("pk"))
    assert {r.pk: round(r.score, 9) for r in search.bm25(df, "id", "t", "zeta", index=index, among=some).collect()} == {r.pk: round(r.score, 9) for r in search.bm25(df.filter("id < 20"), "id", "t", "zeta").collect()}
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(50)] + [(99, None)], "id int, v array<double>")
    q = v.filter("id < 9").select(F.col("id").alias("query"), F.col("v").alias("vec"))
    whole = {tuple(r) for r in search.batch_nearest(v, "id", "v", q, 3).select("query", "pk", "rank").collect()}
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    assert {tuple(r) for r in search.batch_nearest(v, "id", "v", q, 3).select("query", "pk", "rank").collect()} == whole and len(whole) == 27


def test_index_of_odd_texts(spark, tmp_path):
    rows_ = [(1, None, "x"), (2, "", "x"), (3, "\u00a0 \n", "x"), (4, "word " * 60_000, "x"), (5, "Word word", "x"), (5, "Word word", "x")]
    df = spark.createDataFrame(rows_, "src int, dl string, pk string")  # names the index uses itself
    TextIndex.build(df, "src", "dl", f"file://{tmp_path}/odd")
    index = TextIndex(spark, "int", [(f"file://{tmp_path}/odd", None)])
    assert sorted((r.pk, r.tf, r.dl) for r in index.postings().collect()) == [(4, 60_000, 60_000), (5, 2, 2), (5, 2, 2)]
    assert sorted((r.pk, r.distance) for r in index.distances("word").collect()) == [(1, 1.0), (2, 1.0), (3, 1.0), (4, 0.0), (5, 0.0), (5, 0.0)]
    TextIndex.build(df.limit(0), "src", "dl", f"file://{tmp_path}/none")
    none = TextIndex(spark, "int", [(f"file://{tmp_path}/none", None)])
    assert search.bm25(df, "src", "dl", "word", index=none).count() == 0 == none.distances("word").count() and TextIndex(spark, "int", []).postings().count() == 0


def test_cells_find_the_nearest(spark):
    rnd = random.Random(4)
    centers = [[rnd.gauss(0, 4) for _ in range(8)] for _ in range(12)]
    data = [(i, [c + rnd.gauss(0, 1) for c in rnd.choice(centers)]) for i in range(1500)]
    df = spark.createDataFrame(data, "id int, v array<double>")
    q = df.filter("id % 20 = 0").select(F.col("id").alias("query"), F.col("v").alias("vec"))
    index, centroids = search.ivf_index(df, "id", "v", 12)
    assert index.count() == 1500
    got = {tuple(r) for r in search.ivf_search(index, centroids, q, 10).select("query", "pk").collect()}
    want = {tuple(r) for r in search.batch_nearest(df, "id", "v", q, 10).select("query", "pk").collect()}
    assert len(got & want) >= 0.9 * len(want)
    empty, none = search.ivf_index(df.limit(0), "id", "v")
    assert none == [] and empty.count() == 0


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01", "sf0.1"])
def test_cells_lose_no_neighbour_of_the_test_tables(spark, folder):
    from tessel.queries import QUERIES

    if not os.path.exists(at := f"/root/testdata/{folder}"):
        pytest.skip("no test tables")
    got, want = ({tuple(r) for r in QUERIES[n](spark, at).select("query", "pk", "rank").collect()} for n in ("search_vector_cells", "search_vector_batch"))
    assert got == want


@pytest.mark.parametrize("indexed", [False, True])
def test_first_rows_of_many_queries_are_those_of_all_pairs(spark, monkeypatch, tmp_path, indexed):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    some = lambda n: " ".join(words[min(39, int(rnd.expovariate(0.15)))] for _ in range(n))
    texts = [some(rnd.randrange(12)) for _ in range(150)]
    held = [(f"k{i:03}", texts[i % 150]) for i in range(450)] + [("k001", "w30 w30 w1"), ("k002", None), (None, "w30 w2")]
    spark.createDataFrame(held, "id string, t string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    asked = [(i, some(rnd.randrange(5))) for i in range(120)] + [(3, "w30"), (200, "w30 w30 w39"), (201, "nowhere"), (202, None)]
    q = spark.createDataFrame(asked, "query int, text string")
    index = TextIndex.of(df, "id", "t") if indexed else None
    every = search.batch_bm25(df, "id", "t", q, index=index).withColumn("_s", F.round("score", 9))
    want = {(r.query, r["rank"]): (r.pk, round(r.score, 9)) for r in search.top_per_group(every, "query", ["_s", "pk"], 5).collect()}
    monkeypatch.setattr(search, "QUERY_TERMS", 100)  # several blocks of queries
    got = {(r.query, r["rank"]): (r.pk, round(r.score, 9)) for r in search.batch_bm25(df, "id", "t", q, index=index, limit=5).collect()}
    assert len(got) > 400 and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], abs=2e-9) for k in want)
    assert search.batch_bm25(df, "id", "t", q.limit(0), index=index, limit=5).count() == 0 == search.batch_bm25(df.limit(0), "id", "t", q, limit=5).count()


# graphs


def random_graph(seed, n=14, m=30):
    rnd = random.Random(seed)
    return {(rnd.randrange(n), rnd.randrange(n)): rnd.choice([0.2, 0.5, 0.9, 1.0]) for _ in range(m)}


def as_edges(spark, e):
    return spark.createDataFrame([(f"{a:02}", f"{b:02}", "t", w) for (a, b), w in e.items()], "source_id string, target_id string, type string, weight double")


@pytest.mark.parametrize("seed", [1, 2])
def test_graph_algorithms(spark, seed):
    e = random_graph(seed)
    df = as_edges(spark, e)
    nodes = sorted({x for p in e for x in p})
    # walks
    best = {}
    front = [(0, 0.0, "00")]
    for depth in range(1, 5):
        front = [(b, c + 1 - w, f"{p}>{b:02}") for (x, c, p) in front for (a, b), w in e.items() if a == x and c + 1 - w <= 1.5 + 1e-9]
        for x, c, p in front:
            d0, c0, p0 = best.get(x, (depth, c, p))
            best[x] = (min(d0, depth), min(c0, c), min(p0, p))
    best.pop(0, None)
    got = {int(r.node): (r.depth, round(r.cost, 9), r.path) for r in g.traverse(df, "00", 4, max_cost=1.5).collect()}
    assert got == {k: (d, round(c, 9), p) for k, (d, c, p) in best.items()}
    # components
    label = {x: x for x in nodes}
    for _ in nodes:
        for a, b in e:
            label[a] = label[b] = min(label[a], label[b])
    assert {int(r.id): int(r.component) for r in g.connected_components(df).collect()} == label
    # shortest paths
    dist = {(a, b): float("inf") for a in nodes for b in nodes} | {(a, a): 0.0 for a in nodes}
    for (a, b), w in e.items():
        dist[a, b] = min(dist[a, b], w)
    for k, a, b in itertools.product(nodes, nodes, nodes):
        dist[a, b] = min(dist[a, b], dist[a, k] + dist[k, b])
    start = nodes[0]
    assert {int(r.node): round(r.cost, 9) for r in g.distances(df, f"{start:02}").collect()} == {b: round(dist[start, b], 9) for b in nodes if dist[start, b] < float("inf")}
    for end in nodes[::4]:
        p = g.shortest_path(df, f"{start:02}", f"{end:02}")
        steps = [(int(a), int(b)) for a, b in itertools.pairwise(p or [])]
        assert (p is None) == (dist[start, end] == float("inf")) and (p is None or (int(p[0]), int(p[-1])) == (start, end) and sum(e[x] for x in steps) == pytest.approx(dist[start, end]))
    # betweenness, by counting shortest paths
    und = {}
    for (a, b), w in e.items():
        if a != b:
            und[a, b] = und[b, a] = max(w, und.get((a, b), 0))
    mine = sorted({x for p in und for x in p})
    d = {(a, b): und.get((a, b), float("inf")) if a != b else 0.0 for a in mine for b in mine}
    for k, a, b in itertools.product(mine, mine, mine):
        d[a, b] = min(d[a, b], d[a, k] + d[k, b])

    def ways(a, b):
        return 1 if a == b else sum(ways(a, x) for x in mine if (x, b) in und and abs(d[a, x] + und[x, b] - d[a, b]) < 1e-9)

    share = dict.fromkeys(mine, 0.0)
    for a, b in itertools.combinations(mine, 2):
        if d[a, b] < float("inf"):
            for v in mine:
                if v not in (a, b) and abs(d[a, v] + d[v, b] - d[a, b]) < 1e-9:
                    share[v] += ways(a, v) * ways(v, b) / ways(a, b)
    got = {int(r.id): r.betweenness for r in g.betweenness(df, normalized=False).collect()}
    assert got == pytest.approx(share)
    with pytest.raises(ValueError):
        g.betweenness(df, most_edges=3)


@pytest.mark.parametrize("one_task_edges", [g.ONE_TASK_EDGES, 0])
def test_communities_of_bipartite_graphs_settle(spark, one_task_edges):
    # three blocks of 3 x 3 with a light edge between neighbouring ones: labels that swap sides never settle
    e = {(10 * b + i, 10 * b + 5 + j): 1.0 for b in range(3) for i in range(3) for j in range(3)} | {(0, 15): 0.2, (10, 25): 0.2}
    c = {r.id: r.community for r in g.communities(as_edges(spark, e), one_task_edges=one_task_edges).collect()}
    assert c == {f"{v:02}": f"{v // 10 * 10:02}" for pair in e for v in pair}


def test_no_single_move_raises_modularity_of_the_registered_communities(spark):
    from tessel.queries import QUERIES
    from tessel.query_sets.graph import edges

    if not os.path.exists(at := "/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    c = QUERIES["graph_communities"](spark, at)
    of = {r.id: r.community for r in c.collect()}
    near: dict = {v: {} for v in of}
    for r in g.collapsed(edges(spark, at), undirected=True).collect():
        near[r.src][r.dst] = near[r.dst][r.src] = r.w
    k = {v: sum(near[v].values()) for v in near}
    total, whole = sum(k.values()), dict.fromkeys(of.values(), 0.0)
    for v in of:
        whole[of[v]] += k[v]
    assert g.modularity(edges(spark, at), c) > 0.15
    for v in of:
        s = {of[v]: 0.0}
        for u, w in near[v].items():
            s[of[u]] = s.get(of[u], 0.0) + w
        s = {x: w - k[v] * (whole[x] - k[v] * (x == of[v])) / total for x, w in s.items()}
        assert max(s.values()) <= s[of[v]] + 1e-6


@pytest.mark.parametrize("more", [0.0, 1e-8])
def test_betweenness_of_the_whole_registered_graph(spark, more):
    """Against the search from every node without folding; with odd weights it is the one in order of distance."""
    from tessel.query_sets.graph import edges, graph_betweenness

    if not os.path.exists(at := "/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    e = edges(spark, at).withColumn("weight", F.col("weight") + more)
    rows_ = g.collapsed(e, undirected=True).collect()
    ids = sorted({r.src for r in rows_} | {r.dst for r in rows_})
    near = [[] for _ in ids]
    for r in rows_:
        a, b = ids.index(r.src), ids.index(r.dst)
        near[a].append((b, r.w))
        near[b].append((a, r.w))
    want = sum(g._dependencies(near, s, [1] * len(ids)) for s in range(len(ids))) / ((len(ids) - 1) * (len(ids) - 2))
    got = {r.id: r.betweenness for r in (g.betweenness(e) if more else graph_betweenness(spark, at)).collect()}
    assert got == pytest.approx(dict(zip(ids, want)), abs=1e-9) and any(v.startswith("c:") for v in got)


def test_a_level_of_over_a_million_edges_needs_no_rounds_of_joins(spark, monkeypatch):
    monkeypatch.setattr(g, "_moved", lambda *a: pytest.fail("moved by joins"))
    name = lambda c: F.format_string("%05d", c)
    n = spark.range(100 * 150 * 150).select((F.col("id") % 22500).alias("p"), F.floor(F.col("id") / 22500).alias("b"))
    e = n.select((F.col("b") * 150 + F.floor(F.col("p") / 150)).alias("x"), (F.col("b") * 150 + F.col("p") % 150).alias("y")).filter("x < y")
    e = e.union(spark.range(99).selectExpr("id * 150", "id * 150 + 150")).select(name("x").alias("source_id"), name("y").alias("target_id"), F.lit("t").alias("type"), F.lit(0.5).alias("weight"))
    assert e.count() == 1_117_599
    c = {r.id: r.community for r in g.communities(e).collect()}
    assert c == {f"{v:05}": f"{v // 150 * 150:05}" for v in range(15_000)}


@pytest.mark.parametrize("seed", [1, 2])
def test_no_move_of_a_single_node_improves_settled_labels(seed):
    rnd = np.random.default_rng(seed)
    n, pairs = 400, np.unique(np.sort(rnd.integers(0, 400, (3000, 2)), 1), axis=0)
    a, b = pairs[pairs[:, 0] < pairs[:, 1]].T
    w = rnd.choice([0.25, 0.5, 1.0], len(a))
    k, links = np.bincount(a, w, n) + np.bincount(b, w, n), np.zeros((n, n))
    links[a, b] = links[b, a] = w
    at = np.r_[0, np.cumsum((links > 0).sum(1))]
    near = np.nonzero(links)[1]
    label = g._settled(at, near, links[links > 0], k, k.sum())
    to = links @ (label[:, None] == np.arange(n))
    s = to - k[:, None] * (np.bincount(label, k, n)[None] - k[:, None] * (label[:, None] == np.arange(n))) / k.sum()
    assert len(set(label.tolist())) < n / 2 and (s.max(1) <= s[np.arange(n), label] + 1e-6).all()


def test_betweenness_looks_at_the_fewer_edges_between_two_sets(monkeypatch):
    rnd = np.random.default_rng(5)
    a, b = np.nonzero(rnd.random((1500, 120)) < 0.2)
    w, n = rnd.choice([250_000, 500_000], len(a), p=[0.97, 0.03]), 1620
    src, dst, w = np.r_[a, b + 1500], np.r_[b + 1500, a], np.r_[w, w]
    order = np.argsort(src, kind="stable")
    src, dst, w, looked = src[order], dst[order], w[order], []
    graph = [(k, np.searchsorted(src[w == k], np.arange(n + 1)), dst[w == k]) for k in (250_000, 500_000)]
    near = [[] for _ in range(n)]
    for x, y, z in zip(src.tolist(), dst.tolist(), w.tolist()):
        near[x].append((y, z / 1e6))
    many, places = rnd.integers(1, 5, n).astype(float), g._places
    monkeypatch.setattr(g, "_places", lambda at, v: looked.append(int((at[v + 1] - at[v]).sum())) or places(at, v))
    for s in (0, 700, 1500):
        looked.clear()
        assert g._dependencies_by_level(graph, s, many) == pytest.approx(g._dependencies(near, s, many))
        assert 0 < sum(looked) < 1.5 * len(dst)  # of twice as many, there and back


def test_modularity_reads_the_edges_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    e = {(a, b): 1.0 for a in range(4) for b in range(4) if a < b} | {(a, b): 1.0 for a in range(4, 8) for b in range(4, 8) if a < b} | {(0, 4): 1.0}
    df = as_edges(spark, e)
    c = spark.createDataFrame([(f"{v:02}", str(v // 4)) for v in range(8)], "id string, community string")
    assert g.modularity(df.mapInArrow(counted, df.schema), c) == pytest.approx(12 / 13 - 0.5)
    assert read.value == len(e)


def test_distances_along_a_chain_and_nodes_without_edges(spark):
    chain = as_edges(spark, {(i, i + 1): 1.0 for i in range(20)})  # more rounds than are kept apart
    assert {int(r.node): r.cost for r in g.distances(chain, "00").collect()} == {i: float(i) for i in range(21)}
    assert g.shortest_path(chain, "03", "19") == [f"{i:02}" for i in range(3, 20)] and g.shortest_path(chain, "19", "03") is None
    alone = spark.createDataFrame([("00",), ("zz",)], "id string")
    c = {r.id: r.community for r in g.communities(chain, alone).collect()}
    assert c["zz"] == "zz" and len(c) == 22
    loose = chain.unionByName(spark.createDataFrame([("05", None, "t", 0.1), (None, "07", "t", 0.1), ("05", "06", "t", None)], chain.schema)).withColumns({"src": F.lit("x"), "edge": F.lit(1), "path": F.lit(2)})
    assert g.distances(loose, "00").count() == 21 and g.traverse(loose, "04", 3, "both").filter("node is null").count() == 0
    assert g.shortest_path(loose, "04", "08") == ["04", "05", "06", "07", "08"]
    near = g.neighbors(chain, "05").orderBy("neighbor").collect()
    assert [(r.neighbor, r.edge.source_id, r.edge.target_id) for r in near] == [("04", "04", "05"), ("06", "05", "06")]


def test_ranks_and_communities(spark):
    e = as_edges(spark, {(0, 1): 1.0, (1, 2): 1.0, (2, 0): 1.0, (0, 3): 0.5})
    plain = {r.id: r.rank for r in g.pagerank(e, tolerance=1e-5, iterations=60).collect()}
    seeded = {r.id: r.rank for r in g.pagerank(e, personalization=spark.createDataFrame([("02", 1.0)], "id string, weight double"), alpha=0.15, iterations=8).collect()}
    assert sum(plain.values()) == pytest.approx(1) == sum(seeded.values()) and seeded["02"] > plain["02"]
    assert seeded["02"] == pytest.approx(0.853, abs=1e-3) and plain["02"] == pytest.approx(0.282, abs=1e-3)
    rounds = {r.id: r.rank for r in g.pagerank(e, iterations=3, one_task_edges=0).collect()}
    assert rounds == pytest.approx({r.id: r.rank for r in g.pagerank(e, iterations=3).collect()})
    two = as_edges(spark, {(a, b): 1.0 for a, b in itertools.combinations(range(5), 2)} | {(a + 10, b + 10): 1.0 for a, b in itertools.combinations(range(5), 2)} | {(0, 10): 0.1})
    c = g.communities(two)
    assert {r.id[0]: r.community for r in c.collect()} == {"0": "00", "1": "10"} and g.modularity(two, c) > 0.4
    empty = e.limit(0)
    assert g.pagerank(empty, iterations=2, one_task_edges=0).count() == g.pagerank(empty).count() == g.connected_components(empty).count() == g.communities(empty).count() == g.betweenness(empty).count() == 0
    assert g.traverse(empty, "x", 2).count() == 0
    with pytest.raises(ValueError):
        g.traverse(e, "00", 11)


def test_chain_over_partitions(spark):
    events = spark.createDataFrame([(i, "update", "t", None, f"k{i % 3}", f'{{"a": {i}}}') for i in range(1, 300)], "_seq long, _op string, _ts string, _author string, pk string, row_json string")
    log = versioning.chained(events)
    assert versioning.verify_chain(log.repartition(6))["valid"] and versioning.verify_chain(log.limit(0))["valid"]
    rest, base, anchor = versioning.prune(log, 100)
    assert not versioning.verify_chain(rest)["valid"] and versioning.verify_chain(rest, {99: anchor})["valid"]
    assert {tuple(r) for r in versioning.as_of_with_baseline(rest, base).collect()} == {tuple(r) for r in versioning.as_of(log).collect()}
    n = versioning.numbered(events.drop("_seq").repartition(5), ["pk", "row_json"], 10).select("_seq", "pk", "row_json").orderBy("_seq").collect()
    assert [r._seq for r in n] == list(range(11, 310)) and [(r.pk, r.row_json) for r in n] == sorted((r.pk, r.row_json) for r in n)


def test_benchmark_loader(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id": "d1", "title": "T", "text": "x", "metadata": {}}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q1", "text": "y"}\n')
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t2\n")
    c, q, j = retrieval_benchmark(spark, str(tmp_path))
    assert [tuple(r) for df in (c, q, j) for r in df.collect()] == [("d1", "T", "x"), ("q1", "y"), ("q1", "d1", 2)]
