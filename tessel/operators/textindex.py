"""Text columns made ready for search: terms, lengths and vectors, kept as Parquet.

One pass over the texts writes a row a text (its length, terms with counts and vector) and, from these, the postings
clustered by term. A query then reads the row groups that hold its terms, and of the vectors no text. Every row has the
file it came from (``src``), so an index over a table of immutable files grows by segments and leaves out files that went.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessel.functions import text, vectors
from tessel.plans.shared import published, spread
from tessel.sources.files import Files

_TEXTS = "src string, pk {pk}, dl int, terms array<struct<term:string,tf:int>>, slots map<int,double>, vec array<double>"
_POSTINGS = "term string, pk {pk}, src string, tf int, dl int"


def source(file: str) -> str:
    """The name of a file as an index keeps it: its last two parts, whatever the form of the address."""
    return "/".join(file.rsplit("/", 2)[-2:])


def _count(kind: pa.DataType, embed: Callable[[str], Sequence[float]] | None, hashed: bool):
    """Rows ``src, pk, tokens, text`` as rows of ``_TEXTS``: the hash embedding as its slots, a given one as a vector."""
    pair = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, texts = b.column(2).to_pylist(), b.column(3).to_pylist()
            counts = [list(Counter(t).items()) for t in tokens]
            vec = None if embed is None else [[float(x) for x in embed(t or "")] for t in texts]
            slots = [list(vectors.hash_slots(t).items()) for t in texts] if hashed and embed is None else None
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1).cast(kind), pa.array([len(t) for t in tokens], pa.int32()),
                    pa.array([[{"term": t, "tf": n} for t, n in c] for c in counts], pair),
                    pa.nulls(b.num_rows, pa.map_(pa.int32(), pa.float64())) if slots is None else pa.array(slots, pa.map_(pa.int32(), pa.float64())),
                    pa.nulls(b.num_rows, pa.list_(pa.float64())) if vec is None else pa.array(vec, pa.list_(pa.float64())),
                ],
                names=["src", "pk", "dl", "terms", "slots", "vec"],
            )

    return run


class TextIndex:
    """Defined cases: null and empty texts count as rows without terms and have no vector; a text of any length is one row;
    rows repeated under a key are each indexed; columns of the table other than key and text are ignored, whatever their names.

    Segments of one text column: ``path`` of each with the files (``src``) that still count, None for all. ``dense``: the
    texts have vectors of a model, not those of the hash embedding."""

    def __init__(self, spark: SparkSession, kind: str, segments: Iterable[tuple[str, Sequence[str] | None]], dense: bool = False) -> None:
        self.spark, self.kind, self.segments, self.files, self.dense = spark, kind, list(segments), Files(spark), dense

    @staticmethod
    def build(df: DataFrame, key: str, column: str, path: str, embed: Callable[[str], Sequence[float]] | None = None, hashed: bool = True) -> dict:
        """Writes a segment over the rows of ``df`` and gives its statistics: by file the number of rows and of tokens."""
        spark, kind = df.sparkSession, df.schema[key].dataType
        plain = df.select(F.substring_index(F.input_file_name(), "/", -2).alias("src"), F.col(key).alias("pk"), F.col(column).alias("text"))
        rows = spread(plain).select("src", "pk", text.tokens(F.col("text")).alias("tokens"), "text")
        name = kind.simpleString()
        rows.mapInArrow(_count(to_arrow_type(kind), embed, hashed), _TEXTS.format(pk=name)).write.mode("overwrite").parquet(f"{path}/texts")
        texts = spark.read.schema(_TEXTS.format(pk=name)).parquet(f"{path}/texts")
        terms = texts.select("pk", "src", "dl", F.explode("terms").alias("t")).select("t.term", "pk", "src", "t.tf", "dl")
        terms.repartitionByRange("term", "pk").sortWithinPartitions("term", "pk").write.mode("overwrite").parquet(f"{path}/postings")
        stats = {r.src: [r.n, r.t or 0] for r in texts.groupBy("src").agg(F.count("*").alias("n"), F.sum("dl").alias("t")).collect()}
        Files(spark).write(f"{path}/segment.json", json.dumps(stats))
        return stats

    @classmethod
    def of(cls, df: DataFrame, key: str, column: str) -> TextIndex:
        """The index of a plain scan, built when first asked for and kept in the shared folder under what the files are."""
        path = published(df.sparkSession, f"text-{key}-{column}", [df], lambda folder: cls.build(df, key, column, folder))
        return cls(df.sparkSession, df.schema[key].dataType.simpleString(), [(path, None)])

    def _read(self, what: str, schema: str) -> DataFrame:
        parts = []
        for path, live in self.segments:
            p = self.spark.read.schema(schema.format(pk=self.kind)).parquet(f"{path}/{what}")
            parts.append(p if live is None else p.filter(F.col("src").isin(list(live))))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema.format(pk=self.kind))

    def texts(self, among: DataFrame | None = None) -> DataFrame:
        """``src, pk, dl, terms, slots, vec`` of the texts, or of those whose key is in ``among`` (``pk``)."""
        t = self._read("texts", _TEXTS)
        return t if among is None else t.join(among, "pk", "left_semi")

    def postings(self, among: DataFrame | None = None) -> DataFrame:
        """``term, pk, tf, dl``."""
        p = self._read("postings", _POSTINGS).select("term", "pk", "tf", "dl")
        return p if among is None else p.join(among, "pk", "left_semi")

    def stats(self, among: DataFrame | None = None) -> DataFrame:
        """One row ``n, avgdl``."""
        if among is not None:
            return self.texts(among).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        held = [(json.loads(self.files.read(f"{path}/segment.json")), live) for path, live in self.segments]
        kept = [x for h, live in held for f, x in h.items() if live is None or f in set(live)]
        n, tokens = sum(x[0] for x in kept), sum(x[1] for x in kept)
        return self.spark.createDataFrame(pa.table({"n": pa.array([n], pa.int64()), "avgdl": pa.array([tokens / n if n else None], pa.float64())}))

    def distances(self, query: str, among: DataFrame | None = None) -> DataFrame:
        """``pk, distance`` of all texts to one, by the hash embedding: 2 - 2 cos, 1 if one of the two has no words."""
        wanted = vectors.hash_slots(query)
        dot = reduce(lambda a, b: a + b, [F.coalesce(F.try_element_at("slots", F.lit(s)), F.lit(0.0)) * x for s, x in wanted.items()], F.lit(0.0))
        return self.texts(among).select("pk", (F.lit(float(bool(wanted))) + (F.size("slots") > 0).cast("double") - 2 * dot).alias("distance"))
