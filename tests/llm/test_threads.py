import random

import pytest
from pyspark.sql import functions as F

from tessel.llm.threads import conversations, instant, resolve_threads, speaker

ROLE = {"user": "u", "human": "u", "assistant": "a", "ai": "a", "bot": "a", "model": "a", "system": "s", "tool": "t", "function": "t"}


def walk(parents):
    out = {}
    for k in parents:
        seen, x, d = {k}, k, 0
        while True:
            p = parents[x]
            if p is None or p not in parents:
                out[k] = (x, d, "ok" if p is None else "orphan")
                break
            if p in seen:
                out[k] = (None, None, "cycle")
                break
            seen.add(p)
            x, d = p, d + 1
    return out


def test_pointer_jumping(spark):
    rnd = random.Random(1)
    parents = {i: rnd.choice([None, 9999, i - 1, i - 1, i - 1, rnd.randrange(120)]) for i in range(120)}
    parents |= {200 + i: 199 + i if i else None for i in range(70)} | {300: 300, 301: 302, 302: 303, 303: 301, 304: 301}
    df = spark.createDataFrame([(k, p, "x") for k, p in parents.items()] + [(None, 3, "x"), (205, 204, "again")], "id long, parent long, depth string")
    got = {r.id: (r.root, r.depth, r.state) for r in resolve_threads(df).collect()}
    assert got == walk(parents)
    assert resolve_threads(df.limit(0)).count() == 0
    # with values, here the keys: the path of each row that arrives, and columns that come along
    got = {r.id: (r.path, r.note) for r in resolve_threads(df.dropDuplicates(["id"]).filter("id is not null").withColumn("note", F.col("id") * 2), value=F.array("id"), join=F.concat, keep=["note"], unique=True).collect()}

    def path(k):
        return [] if k is None or k not in parents else [*path(parents[k]), k]

    assert got == {k: (None if v[2] == "cycle" else path(k), 2 * k) for k, v in walk(parents).items()}


def test_instants_and_roles(spark):
    given = {
        "2026-01-05T02:35:22.656+02:00": 1767573322656000, "2026-01-06T09:27:50.074Z": 1767691670074000, "1767695555181": 1767695555181000, " 2026-03-04 09:29:18.510 ": 1772616558510000,
        "2026-01-05T17:04:13": 1767632653000000, "2026-01-05T17:04:13.123456+00:00": 1767632653123456, "yesterday": None, "": None, "n/a": None, None: None, "2026-13-05T17:04:13Z": None, "now": None, "2026": None, "2026-01-05T25:00:00": None,
    }
    df = spark.createDataFrame([(k,) for k in given], "t string")
    assert {r.t: r.i for r in df.select("t", instant(F.col("t")).alias("i")).collect()} == given
    df = spark.createDataFrame([(x,) for x in (" Human", "AI\n", "system", "FUNCTION", "agent2", "", None)], "r string")
    assert [r.s for r in df.select(speaker(F.col("r")).alias("s")).collect()] == [1, 2, 3, 4, None, None, None]


def brute(rows):
    sessions, out = {}, set()
    for i, s, r, c, t in rows:
        if s is None or i is None or c is None or not c.strip(" \t\r\n"):
            continue
        sessions.setdefault(s, []).append((t, i, ROLE.get((r or "").strip().lower()), c))
    for s, ms in sessions.items():
        if any(t is None or r is None for t, _, r, _ in ms):
            continue
        seen, kept = set(), []
        for t, i, r, c in sorted(ms):
            if (t, r, c) not in seen:
                seen.add((t, r, c))
                kept.append((i, r))
        roles = "".join(r for _, r in kept)
        open_, bad, begun = False, "u" not in roles, False
        for k, r in enumerate(roles):
            if r == "u":
                bad |= open_ and roles[k - 1] != "u"
                open_ = begun = True
            elif r == "a":
                bad |= not begun
                open_ = False
        if not bad and not open_:
            out |= {(s, n, i) for n, (i, _) in enumerate(kept)}
    return out


@pytest.mark.parametrize("seed, parts", [(1, 1), (2, 5), (3, 40)])
def test_against_brute_force(spark, seed, parts):
    """With many partitions sessions run over their edges; one session holds a third of the rows."""
    rnd = random.Random(seed)
    rows, n = [], 0
    for s in range(120):
        t = 1_767_000_000_000
        for role in rnd.choice(["uaua", "ua", "uuata", "suatuua", "au", "uau", "uatu", "utua", "uuta", "st", "ua?", "uaXa", ""]) * rnd.choice([1, 1, 2, 5]):
            n += 1
            t += rnd.choice([0, 0, 1000, 5000])
            name = {"u": rnd.choice(["user", " Human"]), "a": rnd.choice(["assistant", "BOT"]), "s": "system", "t": "tool", "?": rnd.choice([None, "narrator"]), "X": "assistant"}[role]
            rows.append((n, f"s{s}", name, rnd.choice(["hi", "ok", f"m{n}"]), None if role == "X" and rnd.random() < 0.5 else t))
    for k in range(500):
        rows.append((10_000 + k, "hot", ["user", "assistant"][k % 2], f"h{k}", 1_767_000_000_000 + k))
    rows += [(20_000, None, "user", "x", 1), (20_001, "s1", "user", " \n", None), (None, "s1", "user", "x", None), (20_002, "s3", "nobody", None, 5)]
    rows += [(30_000 + i, *r[1:]) for i, r in enumerate(rnd.sample(rows[:400], 50))]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(i, s, r, c, None if t is None else str(t), "x", 1) for i, s, r, c, t in rows], "id long, session_id string, role string, content string, ts string, session string, idx int")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", str(parts == 1).lower())
        spark.conf.set("spark.sql.shuffle.partitions", str(max(2, parts)))
        got = [tuple(r) for r in conversations(df).collect()]
        assert conversations(df.limit(0)).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert sum(s == "hot" for s, _, _ in got) == 500
