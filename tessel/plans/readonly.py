"""Recognising statements that only read."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Logical nodes that change something, by the beginning of their class name's parts.
_WRITES = ("Command", "Insert", "Delete", "Update", "Merge", "Create", "Drop", "Alter", "Replace", "Truncate", "SetCatalog", "Append", "Overwrite", "Cache", "Uncache", "Refresh", "Repair", "Load", "AddPartitions", "RenameTable", "Analyze", "SetNamespace", "SetTable", "Write")
_READS = ("DescribeRelation", "DescribeColumn", "ShowTables", "ShowColumns", "ShowFunctions", "ExplainCommand", "DescribeQueryCommand")


def reads_only(spark: SparkSession, sql: str) -> bool:
    """Whether the whole parsed statement, common table expressions and subqueries included, holds no writing node."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    return _clean(plan)


def _clean(node) -> bool:
    name = node.getClass().getSimpleName()
    if name not in _READS and any(w in name for w in _WRITES):
        return False
    for group in (node.children(), node.innerChildren(), node.subqueries()):
        it = group.iterator()
        while it.hasNext():
            child = it.next()
            if not hasattr(child, "children") or not _clean(child):
                return False
    return True
