"""Keyword, vector and hybrid search, chunks and ranking measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions import scoring, vectors
from tessel.functions.text import ACCENTED, PLAIN
from tessel.operators import chunking, search
from tessel.operators.textindex import TextIndex
from tessel.plans.shared import materialize
from tessel.query_sets.registry import register
from tessel.sources.tables import table

QUERY = "nightly backup for the scheduler"

# SQL for the operators above: tokens of a text, BM25 from a token table, and the hash embedding


def tokens_sql(c: str) -> str:
    folded = f"translate(regexp_replace(lower(coalesce({c}, '')), '\\p{{Mn}}+', '', 'g'), '{ACCENTED}', '{PLAIN}')"
    return f"[w FOR w IN string_split(regexp_replace({folded}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ') IF w <> '']"


def bm25_sql(name: str, source: str, pk: str, column: str, queries: str) -> str:
    """CTEs ``{name}`` (query, pk, score) of ``queries`` (query, text) over a column."""
    return f"""{name}_d AS (SELECT {pk} AS pk, {tokens_sql(column)} AS ts FROM {source}),
{name}_n AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM {name}_d),
{name}_q AS (SELECT query, term, count(*) AS times FROM (SELECT query, unnest({tokens_sql('text')}) AS term FROM ({queries})) GROUP BY ALL),
{name}_p AS (SELECT pk, dl, term, count(*) AS tf FROM (SELECT pk, len(ts) AS dl, unnest(ts) AS term FROM {name}_d) WHERE term IN (SELECT term FROM {name}_q) GROUP BY ALL),
{name}_f AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
{name} AS (SELECT query, pk, -sum(times * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM {name}_p JOIN {name}_q USING (term) JOIN {name}_f USING (term), {name}_n GROUP BY query, pk)"""


def embedded_sql(name: str, source: str, pk: str, column: str) -> str:
    """CTE ``{name}`` (pk, slot, v) of unit-length hash embeddings."""
    words = f"unnest([w FOR w IN regexp_split_to_array(lower({column}), '{vectors.SPACE}') IF w <> '']) AS w"
    return f"""{name} AS (SELECT pk, slot, c / sqrt(sum(c * c) OVER (PARTITION BY pk)) AS v FROM
  (SELECT pk, (('0x' || md5(w))::UHUGEINT % 384)::INT AS slot, count(*)::DOUBLE AS c FROM (SELECT {pk} AS pk, {words} FROM {source} WHERE {column} IS NOT NULL) GROUP BY ALL))"""


_ONE = f"SELECT 0 AS query, '{QUERY}' AS text"


@register("search_keyword_bm25", f"WITH {bm25_sql('b', 'documents', 'doc_id', 'text', _ONE)} SELECT pk AS doc_id, round(score, 6) + 0.0 AS score FROM b")
def search_keyword(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents")
    return search.bm25(df, "doc_id", "text", QUERY, index=TextIndex.of(df, "doc_id", "text")).select(F.col("pk").alias("doc_id"), (F.round("score", 6) + 0.0).alias("score"))


@register("search_keyword_scan", f"WITH {bm25_sql('b', 'doc_chunks', 'id', 'content', _ONE)} SELECT pk AS id, round(score, 6) + 0.0 AS score FROM b")
def search_keyword_scan(spark: SparkSession, d: str) -> DataFrame:
    """The same ranking straight from the texts, for tables without an index."""
    return search.bm25(table(spark, d, "doc_chunks"), "id", "content", QUERY).select(F.col("pk").alias("id"), (F.round("score", 6) + 0.0).alias("score"))


@register(
    "search_keyword_batch",
    f"WITH {bm25_sql('b', 'doc_chunks', 'id', 'content', 'SELECT DISTINCT id AS query, title AS text FROM docs WHERE title IS NOT NULL')} SELECT query, pk, round(score, 6) + 0.0 AS score FROM b QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9), pk) <= 5",
)
def search_keyword_batch(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "docs").filter("title is not null").select(F.col("id").alias("query"), F.col("title").alias("text")).distinct()
    c = table(spark, d, "doc_chunks")
    # one pass over the texts keeps the query terms; an index of all terms takes more disk than that
    return search.batch_bm25(c, "id", "content", q, limit=5).select("query", "pk", (F.round("score", 6) + 0.0).alias("score"))


_D2 = "list_sum([(x[1]::DOUBLE - x[2]::DOUBLE) ** 2 FOR x IN list_zip(e.embedding, q.embedding)])"


@register("search_vector_topk", f"SELECT e.vec_id, round(greatest(0, 1 - {_D2}), 5) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY round({_D2}, 9), e.vec_id LIMIT 20")
def search_vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id = 0").first().embedding
    return search.nearest(e, "vec_id", "embedding", q, 20).select(F.col("pk").alias("vec_id"), F.round("similarity", 5).alias("similarity"))


@register("search_vector_filtered", f"SELECT e.vec_id, round({_D2}, 5) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q WHERE e.label IN (0, 3) ORDER BY round({_D2}, 9), e.vec_id LIMIT 15")
def search_vector_filtered(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id = 1").first().embedding
    return search.nearest(e.filter(F.col("label").isin(0, 3)), "vec_id", "embedding", q, 15).select(F.col("pk").alias("vec_id"), F.round("distance", 5).alias("distance"))


_BATCH = f"""near AS (SELECT q.vec_id AS query, e.vec_id AS pk, {_D2} AS distance FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0),
top AS (SELECT query, pk, distance, row_number() OVER (PARTITION BY query ORDER BY distance, pk) AS rank FROM near QUALIFY rank <= 10)"""


def _batch(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vec"))
    return search.batch_nearest(e, "vec_id", "embedding", q, 10)


@register("search_vector_batch", f"WITH {_BATCH} SELECT query, pk, rank FROM top")
def search_vector_batch(spark: SparkSession, d: str) -> DataFrame:
    return _batch(spark, d).select("query", "pk", F.col("rank").cast("long").alias("rank"))


_METRICS = f"""{_BATCH}, j AS (SELECT t.query, t.rank FROM top t JOIN embeddings a ON a.vec_id = t.query JOIN embeddings b ON b.vec_id = t.pk WHERE a.label = b.label),
r AS (SELECT a.vec_id AS query, count(*) AS n FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 20 = 0 GROUP BY 1),
i AS (SELECT query, list_sum([1 / log2(k + 1) FOR k IN range(1, least(n, 10) + 1)]) AS idcg FROM r)"""
_METRICS_ROWS = """SELECT query, coalesce(sum(1 / log2(rank + 1)), 0) / any_value(idcg) AS ndcg, count(rank) / any_value(n) AS recall, count(rank) / 10 AS precision, coalesce(1 / min(rank), 0) AS mrr
 FROM r JOIN i USING (query) LEFT JOIN j USING (query) GROUP BY query"""


@register("search_metrics", f"WITH {_METRICS}, m AS ({_METRICS_ROWS}) SELECT query, round(ndcg, 6) AS ndcg, round(recall, 6) AS recall, round(precision, 6) AS precision, round(mrr, 6) AS mrr FROM m")
def search_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = scoring.ranking_metrics(_batch(spark, d).withColumnRenamed("pk", "item"), _judged(spark, d))
    return m.select("query", *[F.round(c, 6).alias(c) for c in ("ndcg", "recall", "precision", "mrr")])


def _judged(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label")
    return e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "label").join(e.select(F.col("vec_id").alias("item"), "label"), "label").select("query", "item", F.lit(1).alias("grade"))


@register("search_metrics_mean", f"WITH {_METRICS}, m AS ({_METRICS_ROWS}) SELECT round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(mrr), 6) AS mrr, count(*) AS queries FROM m")
def search_metrics_mean(spark: SparkSession, d: str) -> DataFrame:
    m = scoring.mean_metrics(scoring.ranking_metrics(_batch(spark, d).withColumnRenamed("pk", "item"), _judged(spark, d)))
    return m.select(*[F.round(c, 6).alias(c) for c in ("ndcg", "recall", "precision", "mrr")], "queries")


@register("search_set_recall", f"WITH {_METRICS}, x AS (SELECT query, count(*) AS f FROM j WHERE rank <= 5 GROUP BY query) SELECT r.query, round(CASE WHEN r.query % 3 = 0 THEN 1 ELSE coalesce(f, 0) / n END, 6) AS recall FROM r LEFT JOIN x USING (query)")
def search_set_recall(spark: SparkSession, d: str) -> DataFrame:
    """Nothing is expected of every third query."""
    judged = _judged(spark, d)
    m = scoring.set_recall(_batch(spark, d).withColumnRenamed("pk", "item"), judged.filter("query % 3 <> 0"), judged, 5)
    return m.select("query", F.round("recall", 6).alias("recall"))


@register("search_vector_cells", f"WITH {_BATCH} SELECT query, pk, rank FROM top")
def search_vector_cells(spark: SparkSession, d: str) -> DataFrame:
    """Exact over cells that may hold a neighbour; the number of cells grows with the table."""
    e = table(spark, d, "embeddings")
    index, centroids = search.ivf_index(e, "vec_id", "embedding")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vec"))
    return search.ivf_search(index, centroids, q, 10).select("query", "pk", F.col("rank").cast("long").alias("rank"))


def _vector_leg(name: str, source: str, pk: str, column: str) -> str:
    """Distances of all rows to the query: 2 - 2 cos, 1 for rows without words."""
    return f"""{embedded_sql(name + '_e', source, pk, column)}, {embedded_sql(name + '_q', f"(SELECT 0 AS pk, '{QUERY}' AS {column})", 'pk', column)},
{name} AS (SELECT d.{pk} AS pk, CASE WHEN d.{pk} IN (SELECT pk FROM {name}_e) THEN 2 - 2 * coalesce(dot, 0) ELSE 1 END AS dist
  FROM {source} d LEFT JOIN (SELECT e.pk, sum(e.v * q.v) AS dot FROM {name}_e e JOIN {name}_q q USING (slot) GROUP BY e.pk) x ON x.pk = d.{pk})"""


_HYBRID = f"""{bm25_sql('b', 'documents', 'doc_id', 'text', _ONE)}, {_vector_leg('v', 'documents', 'doc_id', 'text')},
kw AS (SELECT pk, row_number() OVER (ORDER BY round(score, 12), pk) AS fr FROM b QUALIFY fr <= 40),
vc AS (SELECT pk, row_number() OVER (ORDER BY round(dist, 12), pk) AS vr FROM v QUALIFY vr <= 40)"""


@register(
    "search_hybrid",
    f"""WITH {_HYBRID}, h AS (SELECT pk, fr, vr, coalesce(0.5 / (60 + fr), 0) + coalesce(0.5 / (60 + vr), 0) AS s FROM kw FULL JOIN vc USING (pk))
SELECT doc_id, round(s, 9) AS score FROM h JOIN documents ON doc_id = pk ORDER BY round(s, 12) DESC, fr NULLS LAST, vr NULLS LAST, pk LIMIT 20""",
)
def search_hybrid(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents")
    return search.search(df, "doc_id", "text", QUERY, limit=20, index=TextIndex.of(df, "doc_id", "text")).select("doc_id", F.round("_score", 9).alias("score"))


@register(
    "search_hybrid_filtered_recent",
    f"""WITH {_HYBRID.replace("documents", "(SELECT * FROM documents WHERE lang = 'en' AND n_chars >= 300)")},
h AS (SELECT pk, fr, vr, coalesce(0.3 / (60 + fr), 0) + coalesce(0.7 / (60 + vr), 0) AS s FROM kw FULL JOIN vc USING (pk)),
r AS (SELECT h.*, CASE WHEN created_at IS NULL THEN 0 ELSE 1 / (1 + greatest(floor((epoch_us(TIMESTAMPTZ '2026-07-01 00:00:00+00') - epoch_us(created_at)) / 86400000000), 0) / 30) END AS fresh FROM h JOIN documents ON doc_id = pk)
SELECT pk AS doc_id, round(s * 0.8 + fresh * 0.2, 9) AS score FROM r ORDER BY round(s * 0.8 + fresh * 0.2, 12) DESC, fr NULLS LAST, vr NULLS LAST, pk LIMIT 20""",
)
def search_hybrid_recent(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents")
    found = search.search(
        df, "doc_id", "text", QUERY, limit=20, fts_weight=0.3, recency_weight=0.2, recency_column="created_at",
        now=F.lit("2026-07-01T00:00:00Z").cast("timestamp"), where={"lang": "en", "n_chars": {"$gte": 300}},
        index=TextIndex.of(df, "doc_id", "text"),
    )
    return found.select("doc_id", F.round("_score", 9).alias("score"))


@register(
    "search_all_columns",
    f"""WITH {bm25_sql('b1', 'documents', 'doc_id', 'text', _ONE)}, {bm25_sql('b2', 'documents', 'doc_id', 'source', _ONE)}, {_vector_leg('v', 'documents', 'doc_id', 'text')},
k AS (SELECT pk, row_number() OVER (ORDER BY c, r) AS fr FROM (SELECT pk, 0 AS c, row_number() OVER (ORDER BY round(score, 12), pk) AS r FROM b1 QUALIFY r <= 30 UNION ALL SELECT pk, 1, row_number() OVER (ORDER BY round(score, 12), pk) AS r FROM b2 QUALIFY r <= 30)),
w AS (SELECT pk, row_number() OVER (ORDER BY round(dist, 12), pk) AS vr FROM v QUALIFY vr <= 30),
h AS (SELECT pk, sum(s) AS s, min(fr) AS fr, min(vr) AS vr FROM (SELECT pk, 0.5 / (60 + fr) AS s, fr, NULL AS vr FROM k UNION ALL SELECT pk, 0.5 / (60 + vr), NULL, vr FROM w) GROUP BY pk)
SELECT pk AS doc_id, round(s, 9) AS score FROM h ORDER BY round(s, 12) DESC, fr NULLS LAST, vr NULLS LAST, pk LIMIT 15""",
)
def search_all_columns(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents")
    indexes = {c: TextIndex.of(df, "doc_id", c) for c in ("text", "source")}
    found = search.search_all(df, "doc_id", QUERY, ["text", "source"], {"text": None}, limit=15, indexes=indexes)
    return found.select("doc_id", F.round("_score", 9).alias("score"))


@register("search_latest", "SELECT doc_id, source FROM documents ORDER BY doc_id DESC LIMIT 10")
def search_latest(spark: SparkSession, d: str) -> DataFrame:
    return search.search(table(spark, d, "documents"), "doc_id", "text", None, limit=10).select("doc_id", "source")


@register("search_recency", "SELECT doc_id, round(CASE WHEN created_at IS NULL THEN 0 ELSE 1 / (1 + greatest(floor((epoch_us(TIMESTAMPTZ '2026-03-01 00:00:00+00') - epoch_us(created_at)) / 86400000000), 0) / 30) END, 9) AS fresh FROM documents")
def search_recency(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(scoring.recency(F.col("created_at"), F.lit("2026-03-01T00:00:00Z").cast("timestamp")), 9).alias("fresh"))


@register(
    "search_best_chunk_per_document",
    f"""WITH {bm25_sql('b', 'doc_chunks', 'id', 'content', _ONE)}, x AS (SELECT doc_id, min(round(score, 9)) AS s FROM b JOIN doc_chunks ON id = pk GROUP BY doc_id),
y AS (SELECT x.doc_id, s, max(c.id) AS chunk_id FROM x JOIN doc_chunks c ON c.doc_id = x.doc_id JOIN b ON b.pk = c.id AND round(b.score, 9) = s GROUP BY ALL)
SELECT DISTINCT y.doc_id, chunk_id, round(s, 6) + 0.0 AS score FROM y JOIN docs ON docs.id = y.doc_id""",
)
def search_best_chunk(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "doc_chunks")
    hits = search.bm25(c, "id", "content", QUERY, index=TextIndex.of(c, "id", "content")).join(c, F.col("pk") == F.col("id")).select("doc_id", "id", F.round(-F.col("score"), 9).alias("_score"))
    best = hits.groupBy("doc_id").agg(F.max(F.struct("_score", "id")).alias("b"))
    parents = table(spark, d, "docs").select(F.col("id").alias("doc_id")).distinct()
    return parents.join(best, "doc_id").select("doc_id", F.col("b.id").alias("chunk_id"), (F.round(-F.col("b._score"), 6) + 0.0).alias("score"))


@register("chunk_rows")
def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_rows(table(spark, d, "documents"), "doc_id", "text")


@register("chunk_rows_rejoined", f"SELECT doc_id, md5(regexp_replace(text, '{vectors.SPACE}', '', 'g')) AS text FROM documents WHERE regexp_replace(text, '{vectors.SPACE}', '', 'g') <> ''")
def chunk_rows_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Each text put together again from its chunks: but for white space nothing may be lost or come twice."""
    c = chunking.chunk_rows(table(spark, d, "documents"), "doc_id", "text", overlap=False)
    whole = c.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_seq", "content"))).alias("c"))
    return whole.select("doc_id", F.md5(F.regexp_replace(F.array_join(F.transform("c", lambda x: x["content"]), ""), vectors.SPACE, "")).alias("text"))


@register("search_chunks_of_documents", f"SELECT count(DISTINCT doc_id) AS documents, true AS best FROM documents WHERE list_has_any({tokens_sql('text')}, ['zymurgy', 'scheduler'])")
def search_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut into chunks, the chunks ranked by keyword, the best chunk of each document with its document."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    c = materialize(chunking.chunk_rows(docs, "doc_id", "text", overlap=False).withColumn("id", F.concat_ws("#", "doc_id", "chunk_seq")), "chunks")
    hits = search.bm25(c, "id", "content", "zymurgy scheduler").join(c, F.col("pk") == F.col("id")).select("doc_id", "chunk_seq", "content", (-F.col("score")).alias("_score"))
    best = search.best_chunks(hits, docs.withColumnRenamed("doc_id", "parent"), "doc_id", "parent")
    return best.agg(F.count("*").alias("documents"), F.bool_and(F.contains(F.lower("chunk.content"), F.lit("scheduler")) | F.contains(F.lower("chunk.content"), F.lit("zymurgy"))).alias("best"))


_DENSE = f"""SELECT doc_id, unnest([w FOR w IN regexp_split_to_array(lower(coalesce(text, '')), '{vectors.SPACE}') IF w <> '']) AS w FROM documents"""


@register(
    "embed_hash_dense",
    f"""WITH s AS (SELECT doc_id, (('0x' || md5(w))::UHUGEINT % 384)::INT AS slot, count(*)::DOUBLE AS c FROM ({_DENSE}) GROUP BY ALL),
v AS (SELECT doc_id, map_from_entries(list((slot, c / n))) AS m FROM s JOIN (SELECT doc_id, sqrt(sum(c * c)) AS n FROM s GROUP BY doc_id) USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, [round(coalesce(element_at(m, i::INT)[1], 0), 6) FOR i IN range(384)] AS vec FROM documents d LEFT JOIN v USING (doc_id)""",
)
def embed_hash_dense(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.transform(vectors.hash_embedding(F.col("text")), lambda x: F.round(x, 6)).alias("vec"))
