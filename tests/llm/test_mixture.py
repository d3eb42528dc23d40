import pytest

from tessel.llm.mixture import copies, mix, mix_plan, mix_report, repetition_rates
from pyspark.sql import functions as F


def brute(sizes, targets):
    """Water level by bisection."""
    total = sum(sizes.get(s, 0) for s in targets)
    use = {s: (w, sizes[s] * c) for s, (w, c) in targets.items() if sizes.get(s, 0) > 0 and w > 0 and c > 0}
    if sum(c for _, c in use.values()) <= total:
        return {s: c for s, (_, c) in use.items()}
    lo, hi = 0.0, 1e15
    for _ in range(300):
        mid = (lo + hi) / 2
        if sum(min(w * mid, c) for w, c in use.values()) < total:
            lo = mid
        else:
            hi = mid
    return {s: min(w * hi, c) for s, (w, c) in use.items()}


@pytest.mark.parametrize("targets", [
    {"a": (0.5, 2), "b": (0.3, 1), "c": (0.1, 3), "gone": (0.1, 9)},
    {"a": (0.1, 1), "b": (0.8, 2), "c": (0.1, 1)},
    {"a": (0.3, 0), "c": (0.7, 3)},
    {"c": (1.0, 1)},
])
def test_rates(spark, targets):
    sizes = {"a": 900, "b": 100, "c": 30, "other": 500}
    s = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(sizes.items())] + [(9, None, 70)], "doc_id long, source string, tokens long")
    t = spark.createDataFrame([(k, *v) for k, v in targets.items()], "source string, target_share double, max_repeats long")
    got = {r.source: r.rate * r.tokens for r in repetition_rates(s, t).collect()}
    want = brute(sizes, targets)
    assert set(got) == set(targets)
    for k in targets:
        assert got[k] == pytest.approx(want.get(k, 0), rel=1e-6)


def test_copies_follow_the_rate(spark):
    df = spark.range(20_000).select(copies(F.col("id"), F.lit(2.3), F.lit(5)).alias("c"))
    n = {r.c: r["count"] for r in df.groupBy("c").count().collect()}
    assert set(n) == {2, 3} and abs(n[3] / 20_000 - 0.3) < 0.02


def test_mix_and_report(spark):
    docs = spark.createDataFrame(
        [(i, f"some words here {i}", "a") for i in range(300)] + [(1000 + i, "tiny", "b") for i in range(20)] + [(2000, None, "a"), (2001, "", None), (2002, "text", "none")],
        "doc_id long, text string, source string",
    ).withColumn("tokens", F.lit("clash"))
    t = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 4), ("missing", 0.0, 1)], "source string, target_share double, max_repeats long")
    m = mix(docs, t)
    n = {(r.doc_id): r["count"] for r in m.groupBy("doc_id").count().collect()}
    assert all(n[1000 + i] == 4 for i in range(20)) and 2002 not in n and 2001 not in n
    rep = {r.source: r for r in mix_report(docs, t).collect()}
    assert rep["b"].repeats == 4 and rep["missing"].used_tokens == 0
    assert rep["a"].used_tokens == m.filter("source = 'a'").agg(F.sum("tokens")).first()[0]
    assert mix_plan(docs.limit(0).select("doc_id", "source", F.lit(1).alias("tokens")), t).count() == 0
    assert {r.actual_share for r in mix_report(docs.limit(0), t).collect()} == {None}
