import random

import pytest

from tessel.operators.changefeed import current_rows, replay_changes

SCHEMA = "id long, app_table string, row_id long, column_name string, op string, data string, metadata string, status string, error string, created_at string, retries long"


def feed(spark, entries):
    return spark.createDataFrame([(i, t, r, c, op, data, None, st, None, None, n) for i, t, r, c, op, data, st, n in entries], SCHEMA)


def brute(entries):
    best = {}
    for e in entries:
        if e[0] is not None and (e[0] not in best or (e[7] or 0) > (best[e[0]][7] or 0)):
            best[e[0]] = e
    cells = {}
    for i in sorted(best):
        _, t, r, c, op, _, st, _ = best[i]
        op, st = (op or "").strip().lower(), (st or "").strip().lower()
        if r is None or st == "failed":
            continue
        if op == "row_delete":
            for k in [k for k in cells if k[:2] == (t, r)]:
                del cells[k]
        elif c is not None and op in ("add", "insert", "update", "upsert"):
            cells[t, r, c] = i
        elif c is not None and op in ("delete", "remove"):
            cells.pop((t, r, c), None)
    return {(*k, i) for k, i in cells.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    pick = rnd.choice
    entries = [
        (i * 500, pick(["a", "b", None]), pick([1, 1, 1, 1, 2, 3, None]), pick(["x", "y", "z", None]),
         pick(["add", "Update ", "DELETE", "row_delete", "noop", "remove", "upsert", "insert", None, "row_update"]), f"v{i}", pick(["done", "FAILED", None, " pending"]), 0)
        for i in range(1, 400)
    ]
    entries += [(*e[:6], pick(["failed", "done"]), pick([1, 2])) for e in rnd.sample(entries, 60)] + rnd.sample(entries, 30)
    seen, unique = set(), []
    for e in entries:  # one outcome per id and number of retries
        if (e[0], e[7]) not in seen:
            seen.add((e[0], e[7]))
            unique.append(e)
    unique += unique[:20]
    rnd.shuffle(unique)
    got = {tuple(r) for r in replay_changes(feed(spark, unique).repartition(5)).collect()}
    assert got == brute(unique)


def test_applied_entries_are_skipped(spark):
    f = feed(spark, [(1, "t", 1, "a", "add", "x", None, 0), (2, "t", 1, "b", "add", "y", None, None), (3, "t", 2, "a", "add", "z", None, 0)])
    done = spark.createDataFrame([("t", 1, 1)], "app_table string, row_id long, applied_id long")
    assert {tuple(r) for r in replay_changes(f, applied=done).collect()} == {("t", 1, "b", 2), ("t", 2, "a", 3)}


def test_values_and_empty(spark):
    f = feed(spark, [(1, "t", 1, "a", "add", "x", "failed", 0), (1, "t", 1, "a", "add", "x2", "done", 1), (None, "t", 1, "a", "add", "q", "done", 1)])
    assert [tuple(r) for r in current_rows(f).collect()] == [("t", 1, "a", 1, "x2")]
    assert replay_changes(f.limit(0)).count() == 0
