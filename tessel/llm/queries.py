"""Registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm import bpe, mixture, pieces, pii, spans, threads
from tessel.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@register("p6_ids")
def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_column(table(spark, d, "documents"), "doc_id", "text")


@register("p6_round_trip", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return bpe.decode_column(p6_ids(spark, d), "doc_id", "ids")


@register("p7_mix")
def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@register("p7_report")
def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix_report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@register("p7_limits", "SELECT source, count(doc_id) AS documents, true AS within, true AS whole FROM (SELECT DISTINCT source FROM mix_targets WHERE source IS NOT NULL) LEFT JOIN documents USING (source) GROUP BY source")
def p7_limits(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any mix: no document above its cap, and the total that of one pass unless all sources are capped."""
    r = p7_report(spark, d)
    capped = F.min((F.col("rate") >= F.col("max_repeats") - 1e-6) | (F.col("tokens") == 0)).over(Window.partitionBy())
    used, pool = F.sum("used_tokens").over(Window.partitionBy()), F.sum("tokens").over(Window.partitionBy())
    whole = capped | (F.abs(used - pool) <= 0.02 * pool + 20_000)  # a draw of whole documents
    return r.select("source", "documents", (F.col("repeats") <= F.coalesce("max_repeats", F.lit(0))).alias("within"), whole.alias("whole"))


_PASSAGES = """w AS (SELECT doc_id, i, substr(text, i, 200) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
g AS (SELECT s FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1),
h AS (SELECT w.doc_id, w.i, w.s FROM w SEMI JOIN g USING (s))"""


@register("p8_found", f"WITH {_PASSAGES} SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM h a JOIN h b ON a.s = b.s AND a.doc_id < b.doc_id")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.SharedSpans(table(spark, d, "documents")).pairs()


@register(
    "p8_shared",
    f"""WITH {_PASSAGES}, c AS (SELECT doc_id, i, lead(i, 1, i + 200) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM h)
SELECT d.doc_id, coalesce(length(d.text), 0) AS n_chars, coalesce(n, 0)::BIGINT AS shared_chars
FROM documents d LEFT JOIN (SELECT doc_id, sum(least(j - i, 200)) AS n FROM c GROUP BY doc_id) USING (doc_id)""",
)
def p8_shared(spark: SparkSession, d: str) -> DataFrame:
    return spans.SharedSpans(table(spark, d, "documents")).coverage().withColumnRenamed("doc", "doc_id")


@register(
    "p8_classes",
    f"""WITH {_PASSAGES}, d AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class FROM documents WHERE length(text) >= 200),
l AS (SELECT x.class, count(DISTINCT y.class) AS links FROM (SELECT DISTINCT class, s FROM h JOIN d USING (doc_id)) x JOIN (SELECT DISTINCT class, s FROM h JOIN d USING (doc_id)) y ON x.s = y.s AND x.class <> y.class GROUP BY 1)
SELECT doc_id, class, coalesce(links, 0) AS links FROM d LEFT JOIN l USING (class)""",
)
def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """The operator's own result: documents with their class of equal texts and its links to other classes."""
    return spans.SharedSpans(table(spark, d, "documents")).classes().withColumnRenamed("doc", "doc_id")


def _personal(spark: SparkSession, d: str) -> pii.PersonalInformation:
    return pii.PersonalInformation(table(spark, d, "messages"), table(spark, d, "contacts"))


@register("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d).found().withColumnRenamed("key", "id")


@register("p3_redacted")
def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d).redacted().toDF("id", "content")


# cutting after CJK stops and dropping the white space of the boundaries up to each level, the longest stretch left
_STRETCH = r"""l AS (SELECT id, content AS t FROM doc_chunks WHERE length(content) > 1200),
m AS (SELECT id,
  list_max([length(x) FOR x IN regexp_split_to_array(t, '\r?\n(?:[ \t]*\r?\n)+')]) AS m1,
  list_max([length(x) FOR x IN regexp_split_to_array(t, '\r?\n(?:[ \t]*\r?\n)+|\r?\n')]) AS m2,
  list_max([length(x) FOR x IN regexp_split_to_array(regexp_replace(regexp_replace(t, '([.!?])[ \t]+', E'\\1\x01', 'g'), '([。！？])', E'\\1\x01', 'g'), E'\x01|\\r?\\n')]) AS m3,
  list_max([length(x) FOR x IN regexp_split_to_array(regexp_replace(t, '([。！？])', '\1 ', 'g'), '[ \t]+|\r?\n')]) AS m4 FROM l)"""


@register(
    "p2_found",
    f"""WITH {_STRETCH} SELECT id, CASE WHEN m1 <= 1200 THEN 'paragraph' WHEN m2 <= 1200 THEN 'line' WHEN m3 <= 1200 THEN 'sentence' WHEN m4 <= 1200 THEN 'word' ELSE 'hard' END AS boundary FROM m""",
)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    # every oversized chunk has one first piece
    return p2_pieces(spark, d).filter("boundary is not null and piece_no = 0").select("id", "boundary")


@register("p2_pieces")
def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces in order of ``doc_id, chunk_seq, id, piece_no``: each keeps the number of its chunk and has its own after it."""
    return pieces.split_column(table(spark, d, "doc_chunks"), "id", "content", keep=["doc_id", "chunk_seq"])


@register("p2_rejoined", r"SELECT id, chunk_seq, md5(regexp_replace(content, '[ \t\r\n]+', '', 'g')) AS text, true AS within, 0::BIGINT AS bare FROM doc_chunks WHERE length(content) > 1200")
def p2_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Each oversized chunk put together again from its pieces without their overlaps: nothing but white space may be lost,
    no piece be over the limit and no joint without overlap."""
    of_chunk = Window.partitionBy("id").orderBy("piece_no")
    p = p2_pieces(spark, d).filter("boundary is not null").withColumn("_to", F.lag("end").over(of_chunk))
    fresh = F.when(F.col("_to").isNull(), F.col("content")).otherwise(F.expr("substr(content, _to - start + 1)"))
    p = p.withColumns({"_fresh": fresh, "_bare": (F.col("_to") - F.col("start") <= 0).cast("long")})
    g = p.groupBy("id", "chunk_seq").agg(F.array_sort(F.collect_list(F.struct("piece_no", "_fresh"))).alias("_p"), (F.max(F.length("content")) <= pieces.LIMIT).alias("within"), F.coalesce(F.sum("_bare"), F.lit(0)).alias("bare"))
    text = F.array_join(F.transform("_p", lambda x: x["_fresh"]), "")
    return g.select("id", "chunk_seq", F.md5(F.regexp_replace(text, r"[ \t\r\n]+", "")).alias("text"), "within", "bare")


_NOT_BLANK = r"content IS NOT NULL AND NOT regexp_full_match(content, '[ \t\r\n]*')"
_MESSAGES = rf"""m AS (SELECT session_id, id, content, CASE WHEN r IN ('user', 'human') THEN 'user' WHEN r IN ('assistant', 'ai', 'bot', 'model') THEN 'assistant'
  WHEN r = 'system' THEN 'system' WHEN r IN ('tool', 'function') THEN 'tool' END AS speaker,
  CASE WHEN regexp_full_match(ts, '\d{{9,15}}') THEN ts::BIGINT * 1000
    WHEN regexp_full_match(ts, '\d{{4}}-\d\d-\d\d[T ]\d\d:\d\d.*') THEN epoch_us(try_cast(CASE WHEN regexp_matches(ts, '(Z|[+-]\d\d(:?\d\d)?)$') AND regexp_matches(ts[11:], '(Z|[+-]\d\d(:?\d\d)?)$') THEN ts ELSE ts || 'Z' END AS TIMESTAMPTZ)) END AS moment
  FROM (SELECT * REPLACE (regexp_replace(ts, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS ts), lower(regexp_replace(role, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')) AS r FROM messages
    WHERE session_id IS NOT NULL AND {_NOT_BLANK}))"""
_TURNS = f"""{_MESSAGES},
o AS (SELECT session_id, moment, speaker, content, min(id) AS id, bool_or(speaker IS NULL OR moment IS NULL) AS bad FROM m GROUP BY ALL),
s AS (SELECT *, row_number() OVER w - 1 AS turn_no, lag(speaker) OVER w AS prev,
  last_value(CASE WHEN speaker IN ('user', 'assistant') THEN speaker END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY moment, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ua,
  last_value(CASE WHEN speaker IN ('user', 'assistant') THEN speaker END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY moment, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final
  FROM o WINDOW w AS (PARTITION BY session_id ORDER BY moment, id)),
k AS (SELECT session_id FROM s GROUP BY session_id HAVING NOT bool_or(bad) AND bool_or(speaker = 'user')
  AND NOT bool_or(speaker = 'assistant' AND ua IS NULL) AND NOT bool_or(speaker = 'user' AND ua = 'user' AND prev <> 'user') AND bool_and(final = 'assistant'))"""


@register("p5_found", f"WITH {_TURNS} SELECT session_id, turn_no, id FROM s SEMI JOIN k USING (session_id)")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return threads.conversations(table(spark, d, "messages"))


@register(
    "p5_threads",
    f"""WITH {_MESSAGES}, u AS (SELECT session_id, coalesce(moment, 0) AS moment, CASE WHEN moment IS NOT NULL THEN speaker END AS speaker, content, min(id) AS id FROM m GROUP BY ALL)
SELECT id, first_value(id) OVER w AS root, row_number() OVER w - 1 AS depth, 'ok' AS state FROM u WINDOW w AS (PARTITION BY session_id ORDER BY moment, id)""",
)
def p5_threads(spark: SparkSession, d: str) -> DataFrame:
    """Every message with the first one of its session and its place after it."""
    t = threads.threads(table(spark, d, "messages"))
    first = t.filter("depth = 0").select("root", F.col("id").alias("_first"))
    return t.join(first, "root").select("id", F.col("_first").alias("root"), "depth", "state")


@register(
    "p5_orphans",
    f"""WITH {_MESSAGES.replace(_NOT_BLANK, "true")},
n AS (SELECT session_id, id, coalesce(moment, 0) AS moment, content IS NULL OR regexp_full_match(content, '[ \\t\\r\\n]*') AS blank FROM m),
r AS (SELECT *, count(*) FILTER (blank) OVER w AS gap, row_number() OVER w AS pos FROM n WINDOW w AS (PARTITION BY session_id ORDER BY moment, id))
SELECT id, first_value(id) OVER g AS root, row_number() OVER g - 1 AS depth, CASE WHEN gap > 0 THEN 'orphan' ELSE 'ok' END AS state FROM r WHERE NOT blank WINDOW g AS (PARTITION BY session_id, gap ORDER BY pos)""",
)
def p5_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Each row points to the one before it in its session, blank ones included; without these, what follows one is orphaned."""
    rows = threads.message_rows(table(spark, d, "messages"))
    nodes = threads.linked(rows.withColumn("role", F.col("blank").cast("int")), "at", "id").filter("role = 0")
    t = threads.resolve_threads(nodes, "k", "parent", keep=["id"], unique=True)
    first = t.filter("depth = 0").select("root", F.col("id").alias("_first"))
    return t.join(first, "root").select("id", F.col("_first").alias("root"), "depth", "state")


@register("p5_conversations", f"WITH {_TURNS} SELECT session_id, turn_no, speaker AS role, content FROM s SEMI JOIN k USING (session_id)")
def p5_conversations(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages")
    names = F.create_map(*[F.lit(x) for i, r in enumerate(threads.ROLES, 1) for x in (i, r)])
    named = m.select("id", names[threads.speaker(F.col("role"))].alias("role"), "content")
    return threads.conversations(m).join(named, "id").select("session_id", "turn_no", "role", "content")
