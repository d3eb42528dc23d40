"""Long exact spans shared between records (problem 8), by recompression.

Each round names runs of one token and then pairs of neighbouring tokens. Which pairs are named is decided by a bit of
the two names alone, and a name is a hash of what it stands for, so names are global without any exchange: equal
substrings get equal symbols but near their ends. Only tokens up to the round's width take part, which bounds how far
from a boundary text can influence it: after all rounds a boundary depends on at most ``reach`` characters on either
side, and neighbouring boundaries are at most twice the last width apart, save inside long periodic runs, whose
inner positions all count as boundaries.

What stands around such a boundary is a high-level symbol, named by the sequence of symbols of the first ``NAMED``
rounds that lie wholly within ``SIDE`` characters of it: these, too, depend on no more than ``CONTEXT`` characters on
either side, so equal passages have equal symbols. Of the symbols in each window of ``length - 2 * CONTEXT + 1`` positions
the one with the least name is kept; a passage of ``length`` characters holds at least one whole such window, so any two
records that share the passage share a kept symbol. Shared symbols reveal candidates, and the text around them is
compared as stored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessel.plans.shared import discard, materialize

LENGTH = 200
WIDTHS = (1, 2, 3, 4, 6)  # of the rounds; each counts for the naming of runs and of pairs
CONTEXT = 40
NAMED = 2  # rounds whose symbols name what stands around a boundary
#: Occurrences of a symbol up to which its passages are compared pair by pair; beyond, they are grouped by windows.
FEW = 16
_CHARS = 1 << 15  # of texts handled at once, so that the arrays stay in the cache
_LAP = 256  # shared by neighbouring parts of a longer text; more than any choice looks at

_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def reach(widths: tuple[int, ...] = WIDTHS) -> int:
    """Characters on either side of a position that decide whether it is a boundary, inner positions of runs included."""
    return 2 * sum(widths) + widths[-1] + 1


assert reach() <= CONTEXT
SIDE = CONTEXT - reach(WIDTHS[:NAMED])


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def recompressed(names: np.ndarray, last: np.ndarray, widths: tuple[int, ...] = WIDTHS, named: int = NAMED) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions at which a symbol begins after all rounds, and the symbols after the first ``named`` ones: name, start and
    end. ``last`` marks separators between texts."""
    size = np.ones(len(names), np.int32)
    size[last] = 1 << 30  # never takes part
    start = np.arange(len(names), dtype=np.int64)
    for k, width in enumerate(widths):
        same = (names[1:] == names[:-1]) & (size[1:] <= width)
        if same.any():
            head = np.flatnonzero(np.concatenate(([True], ~same)))
            n = np.diff(np.append(head, len(names)))
            run = n > 1
            names, size, start = names[head], size[head], start[head]
            names[run] = _mix(names[run] * np.uint64(3) + n[run].astype(np.uint64))
            size[run] = np.minimum(size[run] * n[run], 1 << 29)
        side = _mix(names + np.uint64(_BASE * (k + 1) & (1 << 64) - 1)) >> np.uint64(63)
        side[size > width] = 2
        at = np.flatnonzero((side[:-1] == 0) & (side[1:] == 1))
        names[at] = _mix(names[at] * np.uint64(5) + _mix(names[at + 1]))
        size[at] += size[at + 1]
        keep = np.ones(len(names), bool)
        keep[at + 1] = False
        names, size, start = names[keep], size[keep], start[keep]
        if k == named - 1:
            low = names.copy(), start, start + size
    margin = widths[-1] + 1
    long = np.flatnonzero((size > 2 * margin - 1) & (size < 1 << 30))
    if len(long):
        end = np.append(start[1:], start[-1])[long]
        inner = [np.arange(a + margin, b - margin + 1) for a, b in zip(start[long], end)]
        start = np.concatenate([start, *inner])  # not in order; no position twice
    return start, low


def _least(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each ``width`` neighbouring values, by doubling."""
    n = 1
    while 2 * n <= width:
        x = pick(x[:-n], x[n:])
        n *= 2
    return pick(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(n, np.uint64(base))
            x[0] = 1
            _powers[name] = np.cumprod(x)
    return _powers["up"], _powers["down"]


def _named(chars: np.ndarray, at: np.ndarray, symbol: np.ndarray, begin: np.ndarray, end: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Names of what stands around the positions ``at``: hashes of the symbols wholly within ``SIDE`` characters. Inside a
    run so long that there is none, of the characters as far as that."""
    a, b = np.searchsorted(begin, at - SIDE), np.searchsorted(end, at + SIDE, "right")
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(symbol * up[: len(symbol)])))
    name = (prefix[np.maximum(a, b)] - prefix[a]) * down[a] + chars[at - 1].astype(np.uint64) * _M1 + chars[at].astype(np.uint64)
    bare = np.flatnonzero(b <= a)
    if len(bare):
        c = _mix(chars.astype(np.uint64) + np.uint64(_BASE & (1 << 64) - 1))
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(c * up[: len(c)])))
        x = at[bare]
        name[bare] = (prefix[x + SIDE] - prefix[x - SIDE]) * down[x - SIDE]
    return _mix(name) & ~np.uint64(1) | np.uint64(2)


def _block(parts: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept symbols of some texts: text's number, position in it, name."""
    raw = [p.encode("utf-32-le", "surrogatepass") for p in parts]
    chars = np.frombuffer(b"\xff\xff\xff\xff".join([*raw, b""]), np.uint32)
    n = np.array([len(r) // 4 for r in raw])
    first = np.concatenate(([0], np.cumsum(n + 1)[:-1]))
    names = _mix(chars.astype(np.uint64) + np.uint64(_BASE & (1 << 64) - 1))
    at, (symbol, begin, end) = recompressed(names, first + n)
    up, down = _power(max(len(chars), _CHARS + 4 * _LAP))
    # the positions of text i with their whole context inside it are lo[i] .. hi[i]
    lo, hi = first + CONTEXT, first + n - CONTEXT
    which = np.searchsorted(first, at, "right") - 1
    ok = (at >= lo[which]) & (at <= hi[which])
    at, which = at[ok], which[ok]
    name = _named(chars, at, symbol, begin, end, up, down)
    dense = np.full(len(chars), _MAX)
    dense[at] = name
    width = length - 2 * CONTEXT + 1
    least = _least(dense, width, np.minimum)
    inside = np.zeros(len(chars) + width - 1, np.uint64)  # windows wholly in a text; others keep 0, below any name
    for a, b in zip(lo, hi - width + 2):
        if b > a:
            inside[a + width - 1 : b + width - 1] = least[a:b]
    kept = _least(inside, width, np.maximum)[at] == name
    return which[kept], at[kept] - first[which[kept]], name[kept].view(np.int64)


def symbols(texts: list[str], length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``_block`` over texts of any number and length; a long text goes in overlapping parts with the same outcome."""
    parts: list[str] = []
    meta: list[tuple[int, int, int, int]] = []  # text, offset, first and last position that count in this part
    size = 0

    def flush():
        which, at, name = _block(parts, length)
        m = np.array(meta, np.int64)
        at = at + m[which, 1]
        ok = (at >= m[which, 2]) & (at < m[which, 3])
        return m[which, 0][ok], at[ok], name[ok]

    for i, t in enumerate(texts):
        n = len(t)
        if n < length:
            continue
        for a in range(0, n, _CHARS):
            b = min(n, a + _CHARS)
            parts.append(t[max(0, a - _LAP) : b + _LAP])
            meta.append((i, max(0, a - _LAP), a, b if b < n else n + 1))
            size += len(parts[-1])
            if size >= _CHARS:
                yield flush()
                parts, meta, size = [], [], 0
    if parts:
        yield flush()


def _symbol_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for which, _, name in symbols(b.column(1).to_pylist(), length):
                order = np.lexsort((name, which))
                which, name = which[order], name[order]
                new = np.flatnonzero(np.concatenate(([True], (which[1:] != which[:-1]) | (name[1:] != name[:-1])))[: len(which)])
                n = np.diff(np.append(new, len(which))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(name[new]), b.column(0).take(pa.array(which[new])), pa.array(n)], names=["symbol", "doc", "n"])

    return run


def _window_hashes(text: str, starts: np.ndarray, length: int) -> np.ndarray:
    """128-bit hashes of the passages beginning at ``starts``, as pairs of int64."""
    d = b"".join(hashlib.blake2b(text[s : s + length].encode("utf-32-le", "surrogatepass"), digest_size=16).digest() for s in starts.tolist())
    return np.frombuffer(d, np.int64).reshape(-1, 2)


_EVIDENCE = "symbol long, doc {kind}, pos long, off int, passage string, h1 long, h2 long, before long"


def _evidence_rows(length: int, kind: pa.DataType):
    side = length - CONTEXT
    types = [pa.int64(), kind, pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    names = ["symbol", "doc", "pos", "off", "passage", "h1", "h2", "before"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, wanted = b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()
            many = [{w["symbol"] for w in ws if w["many"]} for ws in wanted]
            few = [{w["symbol"] for w in ws if not w["many"]} for ws in wanted]
            spans: dict[int, list[int]] = {}
            cols: list[list] = [[] for _ in range(5)]
            for which, at, name in symbols(texts, length):
                for i, p, k in zip(which.tolist(), at.tolist(), name.tolist()):
                    if k in few[i]:
                        a = max(0, p - side)
                        for c, v in zip(cols, (k, i, p, p - a, texts[i][a : p + side])):
                            c.append(v)
                    elif k in many[i]:
                        spans.setdefault(i, []).append(p)
            if cols[0]:
                k, i, p, off, text = cols
                none = pa.nulls(len(k), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(k, types[0]), ids.take(pa.array(i)), pa.array(p, types[2]), pa.array(off, types[3]), pa.array(text, types[4]), none, none, none], names=names)
            for i, ps in spans.items():
                p = np.array(ps)
                n = len(texts[i])
                mark = np.zeros(n + 2, np.int32)  # passages around p begin from p - side to p - CONTEXT
                np.add.at(mark, np.maximum(0, p - side), 1)
                np.add.at(mark, np.minimum(p - CONTEXT, n - length) + 1, -1)
                starts = np.flatnonzero(np.cumsum(mark)[: n - length + 1] > 0)
                for j in range(0, len(starts), 50_000):
                    s = starts[max(0, j - 1) : j + 50_000]
                    h = _window_hashes(texts[i], s, length)
                    before = np.concatenate(([0], h[:-1, 0]))
                    lone = np.concatenate(([True], np.diff(s) > 1))
                    if j:
                        s, h, before, lone = s[1:], h[1:], before[1:], lone[1:]
                    m = len(s)
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(m, types[0]), ids.take(pa.array(np.full(m, i))), pa.array(s, types[2]), pa.nulls(m, types[3]), pa.nulls(m, types[4]), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(before, mask=lone)],
                        names=names,
                    )

    return run


def _compare(length: int):
    """Of two passages around one symbol: characters in common to its left and right; pairs with fewer than ``length`` go."""

    def common(a: str, b: str) -> int:
        n = min(len(a), len(b))
        if a[:n] == b[:n]:
            return n
        lo = 0
        while n - lo > 1:
            mid = (lo + n) // 2
            if a[lo:mid] == b[lo:mid]:
                lo = mid
            else:
                n = mid
        return lo

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, left, right = [], [], []
            for i, (x, xo, y, yo) in enumerate(zip(*(b.column(c).to_pylist() for c in (4, 5, 6, 7)))):
                r = common(x[xo:], y[yo:])
                e = common(x[:xo][::-1], y[:yo][::-1])
                if e + r >= length:
                    keep.append(i)
                    left.append(e)
                    right.append(r)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in range(4)), pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["doc_a", "doc_b", "pos_a", "pos_b", "left", "right"])

    return run


class SharedSpans:
    """Passages of at least ``length`` characters that stand verbatim in more than one document.

    Defined cases: null and shorter texts share nothing; rows with a null id are left out; equal texts are one class
    and only its lowest id is searched, so a group of copies costs no more than one text until its pairs are asked for;
    rows repeated under one id are one document; other columns are ignored; empty tables give empty results.
    """

    def __init__(self, documents: DataFrame, key: str = "doc_id", text: str = "text", *, length: int = LENGTH) -> None:
        if length < 2 * CONTEXT + 2 * WIDTHS[-1] + 4:
            raise ValueError(f"length must be at least {2 * CONTEXT + 2 * WIDTHS[-1] + 4}")
        self.length = length
        self.all = documents.select(F.col(key).alias("doc"), F.col(text).alias("text")).filter(F.col("doc").isNotNull())
        self.kind = self.all.schema["doc"].dataType.simpleString()
        long = self.all.filter(F.length("text") >= length)
        hashed = long.select("doc", F.unhex(F.md5("text")).alias("hash"))
        # classes of equal texts with several documents, and the members of these
        classes = hashed.groupBy("hash").agg(F.min("doc").alias("rep"), F.max("doc").alias("_last")).filter("rep <> _last").select("hash", "rep")
        self.members = materialize(hashed.join(classes, "hash").select("doc", "rep").distinct(), "members")
        others = self.members.filter("doc <> rep").select("doc")
        self.distinct = long.join(others, "doc", "left_anti")
        self.evidence = self._evidence()

    def classes(self) -> DataFrame:
        """``doc, class, links`` of every document long enough to share anything: the lowest id with the same text, and how
        many other classes share a passage with it. No copy is expanded."""
        pairs = self.class_pairs()
        links = pairs.select(F.col("doc_a").alias("class")).unionAll(pairs.select("doc_b")).groupBy("class").agg(F.count("*").alias("links"))
        long = self.all.filter(F.length("text") >= self.length).select("doc").distinct()
        of = long.join(self.members, "doc", "left").select("doc", F.coalesce("rep", "doc").alias("class"))
        return of.join(links, "class", "left").select("doc", "class", F.coalesce("links", F.lit(0)).alias("links"))

    def _evidence(self) -> DataFrame:
        kept = materialize(self.distinct.select("doc", "text").mapInArrow(_symbol_rows(self.length), f"symbol long, doc {self.kind}, n int"), "symbols")
        shared = kept.groupBy("symbol").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.sum("n").alias("n")).filter("a <> b")
        shared = materialize(shared.select("symbol", (F.col("n") > FEW).alias("many")), "shared")
        wanted = kept.join(shared, "symbol").groupBy("doc").agg(F.collect_set(F.struct("symbol", "many")).alias("wanted"))
        wanted = materialize(wanted, "wanted")  # read back, so that its true size decides how it is joined
        found = self.distinct.join(wanted, "doc").select("doc", "text", "wanted")
        arrow = to_arrow_type(self.all.schema["doc"].dataType)
        evidence = materialize(found.mapInArrow(_evidence_rows(self.length, arrow), _EVIDENCE.format(kind=self.kind)), "evidence")
        for x in (kept, shared, wanted):
            discard(x)
        return evidence

    def _compared(self) -> DataFrame:
        """Passages around symbols with few occurrences, each two of different documents compared."""
        e = self.evidence.filter(F.col("symbol").isNotNull())
        a = e.select("symbol", F.col("doc").alias("doc_a"), F.col("pos").alias("pos_a"), F.col("passage").alias("text_a"), F.col("off").alias("off_a"))
        b = e.select("symbol", F.col("doc").alias("doc_b"), F.col("pos").alias("pos_b"), F.col("passage").alias("text_b"), F.col("off").alias("off_b"))
        pairs = a.join(b, "symbol").filter("doc_a < doc_b").select("doc_a", "doc_b", "pos_a", "pos_b", "text_a", "off_a", "text_b", "off_b")
        return pairs.mapInArrow(_compare(self.length), f"doc_a {self.kind}, doc_b {self.kind}, pos_a long, pos_b long, left long, right long")

    def _windows(self) -> DataFrame:
        return self.evidence.filter(F.col("h1").isNotNull()).select("h1", "h2", "doc", "pos", "before")

    def class_pairs(self) -> DataFrame:
        """``doc_a < doc_b`` between the lowest ids of classes of equal texts."""
        w = self._windows().select("h1", "h2", "doc", "before").distinct()
        # a pair is emitted at the first window of a common passage: where the windows before differ or are unknown
        g = w.groupBy("h1", "h2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min("before").alias("p"), F.max("before").alias("q"), F.count("*").alias("n"), F.count("before").alias("m"))
        g = g.filter("lo <> hi and (m < n or p <> q)").select("h1", "h2")
        first = w.join(g, ["h1", "h2"])
        a = first.select("h1", "h2", F.col("doc").alias("doc_a"), F.col("before").alias("before_a"))
        b = first.select("h1", "h2", F.col("doc").alias("doc_b"), F.col("before").alias("before_b"))
        many = a.join(b, ["h1", "h2"]).filter("doc_a < doc_b and (before_a is null or before_b is null or before_a <> before_b)")
        return self._compared().select("doc_a", "doc_b").union(many.select("doc_a", "doc_b")).distinct()

    def pairs(self) -> DataFrame:
        """All pairs of documents, ``doc_a < doc_b``, with a common passage; copies of a text are expanded here only."""
        p = self.class_pairs()
        m = self.members
        expand = lambda df, c: (
            df.join(m.select(F.col("rep").alias(c), F.col("doc").alias("_m")), c, "left").withColumn(c, F.coalesce("_m", c)).drop("_m")
        )
        between = expand(expand(p, "doc_a"), "doc_b")
        within = m.select("rep", F.col("doc").alias("doc_a")).join(m.select("rep", F.col("doc").alias("doc_b")), "rep").filter("doc_a < doc_b")
        both = between.select("doc_a", "doc_b").union(within.select("doc_a", "doc_b"))
        return both.select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"))

    def coverage(self) -> DataFrame:
        """Every document: ``doc, n_chars, shared_chars``, the characters inside passages that another one shares."""
        c = self._compared()
        end = F.col("pos_a") + F.col("right")
        spans = c.select(F.col("doc_a").alias("doc"), (F.col("pos_a") - F.col("left")).alias("s"), end.alias("e")).union(
            c.select("doc_b", F.col("pos_b") - F.col("left"), F.col("pos_b") + F.col("right"))
        )
        w = self._windows()
        shared = w.groupBy("h1", "h2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo <> hi").select("h1", "h2")
        spans = spans.union(w.join(shared, ["h1", "h2"]).select("doc", F.col("pos"), F.col("pos") + self.length))
        spans = spans.groupBy("doc", "s").agg(F.max("e").alias("e"))  # at most one a position
        so_far = Window.partitionBy("doc").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
        fresh = F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.coalesce(F.max("e").over(so_far), F.lit(0))))
        sums = spans.select("doc", fresh.alias("n")).groupBy("doc").agg(F.sum("n").alias("shared"))
        copies = self.members.select("doc", F.lit(True).alias("copied"))
        every = self.all.select("doc", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
        return (
            every.join(sums, "doc", "left").join(copies, "doc", "left")
            .select("doc", "n_chars", F.when(F.col("copied"), F.col("n_chars")).otherwise(F.coalesce("shared", F.lit(0))).cast("long").alias("shared_chars"))
        )
