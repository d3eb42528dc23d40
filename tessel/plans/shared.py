"""Lineage cuts that survive the loss of executors.

An iterative operator, or one that reads an intermediate result more than once, writes that result as Parquet
into the folder every executor shares. Reading it back gives Catalyst the true size of the table, so a later
join is broadcast only when that size is under ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import atexit
import hashlib
import json
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessel.sources.files import Files

_written: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local session without one gets its own, a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = getattr(spark, "_tessel_root", None)
        if root is None:
            own = tempfile.mkdtemp(prefix="tessel-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            root = f"file://{own}"
            spark._tessel_root = root
    return root.rstrip("/")


def materialize(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder once and return a reader of what was written."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/tessel/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


#: Part of the name of what is kept for other sessions; to be raised when the same name would stand for something else.
_FORMAT = 1


def published(spark: SparkSession, tag: str, sources: Sequence[DataFrame], build: Callable[[str], object]) -> str:
    """The folder that ``build`` filled for the present files of ``sources`` (each by name, length and time). It is built aside
    and then published by a text that names it, so nobody reads a half or someone else's: of two builders the first counts."""
    files = Files(spark)
    state = sorted((f, *files.state(f)) for s in sources for f in s.inputFiles())
    at = f"{shared_root(spark)}/tessel/{tag}-{hashlib.sha256(json.dumps([_FORMAT, state, tag]).encode()).hexdigest()[:32]}"
    if not files.has(f"{at}.at"):
        folder = f"{at}-{uuid.uuid4().hex}"
        build(folder)
        try:
            files.write(f"{at}.at", folder)
        except RuntimeError:
            files.delete(folder)
    return files.read(f"{at}.at")


def stored(spark: SparkSession, tag: str, sources: Sequence[DataFrame], make: Callable[[], DataFrame], order: Sequence[str] = ()) -> DataFrame:
    """What ``make`` gives, written to the shared folder once for the present files of ``sources`` and then read from
    there: for data derived from tables that many queries use. With ``order`` the rows lie sorted by these columns."""

    def build(folder: str) -> None:
        df = make()
        df = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
        df.write.parquet(f"{folder}/rows")
        Files(spark).write(f"{folder}/schema.json", df.schema.json())

    folder = published(spark, tag, sources, build)
    return spark.read.schema(T.StructType.fromJson(json.loads(Files(spark).read(f"{folder}/schema.json")))).parquet(f"{folder}/rows")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for heavy work on a table of few files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def discard(df: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote, for results that no later plan reads."""
    if df is None:
        return
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session is gone; the folder belongs to it
            return
