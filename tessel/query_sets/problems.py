"""Queries of the general problems: differences of two copies (1) and change feeds (4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessel.operators import changefeed, datadiff
from tessel.query_sets.registry import register
from tessel.sources.tables import table

_SYNC_STATE = r"""
  SELECT store_id, name AS table_name, synced_count, pk_column, synced_at FROM (
    SELECT *, row_number() OVER (PARTITION BY store_id, name ORDER BY sync_seq DESC NULLS LAST, synced_count DESC NULLS LAST, pk_column DESC NULLS LAST, synced_at DESC NULLS LAST) AS rn
    FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(table_name), '^[ \t\r\n"]+|[ \t\r\n"]+$', '', 'g'), '^main[ \t"]*\.', ''), '^[ \t\r\n"]+|[ \t\r\n"]+$', '', 'g') AS name FROM {t})
    WHERE name <> '') WHERE rn = 1"""


@register(
    "p1_found",
    f"""WITH l AS ({_SYNC_STATE.format(t="duckdb_sync")}), r AS ({_SYNC_STATE.format(t="duckdb_sync_replica")}),
j AS (SELECT coalesce(l.store_id, r.store_id) AS store_id, coalesce(l.table_name, r.table_name) AS table_name,
  l.table_name IS NULL AS no_l, r.table_name IS NULL AS no_r,
  l.synced_count IS DISTINCT FROM r.synced_count AS d1, l.pk_column IS DISTINCT FROM r.pk_column AS d2, l.synced_at IS DISTINCT FROM r.synced_at AS d3
  FROM l FULL JOIN r ON l.store_id IS NOT DISTINCT FROM r.store_id AND l.table_name = r.table_name)
SELECT store_id, table_name, 'only_live' AS diff FROM j WHERE no_r
UNION ALL SELECT store_id, table_name, 'only_replica' FROM j WHERE no_l
UNION ALL SELECT store_id, table_name, 'synced_count' FROM j WHERE NOT no_l AND NOT no_r AND d1
UNION ALL SELECT store_id, table_name, 'pk_column' FROM j WHERE NOT no_l AND NOT no_r AND d2
UNION ALL SELECT store_id, table_name, 'synced_at' FROM j WHERE NOT no_l AND NOT no_r AND d3""",
)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = datadiff.sync_diff(table(spark, d, "duckdb_sync"), table(spark, d, "duckdb_sync_replica"))
    return found.select("store_id", "table_name", "diff")


_ENTRIES = r"""
  SELECT * FROM (SELECT *, regexp_replace(lower(op), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS o, regexp_replace(lower(status), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS s,
    row_number() OVER (PARTITION BY id ORDER BY coalesce(retries, 0) DESC, app_table DESC NULLS LAST, row_id DESC NULLS LAST, column_name DESC NULLS LAST, lower(trim(op)) DESC NULLS LAST, lower(trim(status)) DESC NULLS LAST) AS rn FROM journal WHERE id IS NOT NULL)
  WHERE rn = 1 AND row_id IS NOT NULL AND s IS DISTINCT FROM 'failed'"""
LIVE_CELLS = f"""e AS ({_ENTRIES}),
c AS (SELECT app_table, row_id, column_name, max(id) AS id, arg_max(o IN ('add', 'insert', 'update', 'upsert'), id) AS live FROM e
  WHERE column_name IS NOT NULL AND o IN ('add', 'insert', 'update', 'upsert', 'delete', 'remove') GROUP BY ALL),
k AS (SELECT app_table, row_id, max(id) AS cleared FROM e WHERE o = 'row_delete' GROUP BY ALL),
live AS (SELECT c.app_table, c.row_id, c.column_name, c.id FROM c LEFT JOIN k ON c.app_table IS NOT DISTINCT FROM k.app_table AND c.row_id = k.row_id
  WHERE c.live AND (k.cleared IS NULL OR c.id > k.cleared))"""


@register("p4_found", f"WITH {LIVE_CELLS} SELECT * FROM live")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.replay_changes(table(spark, d, "journal"))


@register("p4_rows", f"WITH {LIVE_CELLS} SELECT live.*, e.data AS value FROM live JOIN e USING (id)")
def p4_rows(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.current_rows(table(spark, d, "journal"))
