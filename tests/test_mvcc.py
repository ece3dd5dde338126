"""Hand-written cases of the resolution and compaction rules, and a random model."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions.merge import REGISTRY, by_name, stringappend
from tidelog.operators import compaction, mvcc, overlay, ranges, scan

SCHEMA = "key long, seq long, op string, value long"


def log_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def as_map(df):
    return {r.key: r.value for r in df.collect()}


CASES = {
    "overwrite": ([(1, 1, "PUT", 5), (1, 2, "PUT", 6)], {1: 6}),
    "delete": ([(1, 1, "PUT", 5), (1, 2, "DELETE", None)], {}),
    "put again": ([(1, 1, "PUT", 5), (1, 2, "DELETE", None), (1, 3, "PUT", 7)], {1: 7}),
    "merge on put": ([(1, 1, "PUT", 5), (1, 2, "MERGE", 2), (1, 3, "MERGE", 3)], {1: 10}),
    "merge on delete": ([(1, 1, "PUT", 5), (1, 2, "DELETE", None), (1, 3, "MERGE", 3)], {1: 3}),
    "merge without base": ([(1, 3, "MERGE", 3)], {1: 3}),
    "merge below put is hidden": ([(1, 1, "MERGE", 9), (1, 2, "PUT", 4)], {1: 4}),
}


@pytest.mark.parametrize("name", CASES)
def test_resolution(spark, name):
    rows, want = CASES[name]
    assert {k: int(v) for k, v in as_map(mvcc.resolve(log_of(spark, rows), by_name("uint64add"))).items()} == want


def test_uint64_wraps(spark):
    top = 2**63 - 1
    got = mvcc.resolve(log_of(spark, [(1, 1, "PUT", top), (1, 2, "MERGE", top), (1, 3, "MERGE", 5)]), by_name("uint64add")).first()
    assert int(got.value) == (2 * top + 5) % 2**64


def test_random_log_equals_model(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(12), s, rng.choice(["PUT", "MERGE", "MERGE", "DELETE"]), rng.randrange(100)) for s in range(400)]
    stones = [(b, b + rng.randrange(1, 5), s) for b, s in ((rng.randrange(12), rng.randrange(400)) for _ in range(15))]
    for snapshot in (100, 250, 399):
        want = {}
        for key in range(12):
            value, found = None, False
            for k, s, op, v in rows:
                if k != key or s > snapshot or any(b <= k < e and s < t <= snapshot for b, e, t in stones):
                    continue
                if op == "PUT":
                    value, found = str(v), True
                elif op == "DELETE":
                    value, found = None, False
                else:
                    value, found = (f"{value},{v}" if found else str(v)), True
            if found:
                want[key] = value
        tomb = spark.createDataFrame(stones, "begin long, end long, seq long")
        assert as_map(mvcc.resolve(log_of(spark, rows), stringappend(","), snapshot, tomb)) == want


def test_tombstone_fragments(spark):
    t = spark.createDataFrame([(1, 5, 10), (3, 8, 20), (3, 3, 30), (10, 12, 5), (1, 5, 11)], "begin long, end long, seq long")
    got = {(r.begin, r.end): r.seqs for r in ranges.fragments(t).collect()}
    assert got == {(1, 3): [11, 10], (3, 5): [20, 11, 10], (5, 8): [20], (10, 12): [5]}


def test_single_deletes(spark):
    rows = [(1, 1, "PUT", 1), (1, 2, "SINGLE_DELETE", None), (2, 1, "SINGLE_DELETE", None), (3, 1, "PUT", 1), (3, 2, "PUT", 2), (3, 3, "SINGLE_DELETE", None)]
    assert [tuple(r) for r in compaction.pair_single_deletes(log_of(spark, rows)).collect()] == [(3, 1, "PUT", 1)]


def test_empty_log(spark):
    empty = log_of(spark, [])
    for name in REGISTRY:
        assert mvcc.resolve(empty, by_name(name)).count() == 0
    assert mvcc.latest(empty).count() == 0
    assert compaction.keep_newest(empty, [5]).count() == 0


def test_unknown_merge_operator():
    with pytest.raises(ValueError):
        by_name("nonsense")


def test_operands_newest_first(spark):
    rows = [(1, 1, "PUT", 1), (1, 2, "MERGE", 2), (1, 3, "MERGE", 3), (2, 1, "MERGE", 9), (2, 2, "DELETE", None), (2, 3, "MERGE", 8)]
    got = {r.key: (r.status, r.operands) for r in mvcc.operands(log_of(spark, rows), 2).collect()}
    assert got == {1: ("Incomplete", None), 2: ("OK", [8])}


def test_seeks(spark):
    current = spark.createDataFrame([(k, k * 10) for k in (2, 4, 9, 70)], "key long, value long")
    assert [r.key for r in scan.seek(current, 3, 2).collect()] == [4, 9]
    assert [r.key for r in scan.seek_for_prev(current, 8, 2).collect()] == [4, 2]
    probes = spark.createDataFrame([(1,), (2,), (8,), (69,), (500,)], "key long")
    assert {r.key: r.found for r in scan.seek_for_prev_each(current, probes).collect()} == {1: None, 2: 2, 8: 4, 69: 9, 500: 70}


def test_deadlocks(spark):
    waits = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 5), (6, 7)], "waiter long, holder long")
    assert sorted(r.txn for r in overlay.deadlocked(waits).collect()) == [1, 2, 3, 5]


def test_deadlocks_on_long_cycles(spark):
    waits = spark.createDataFrame([(i, (i + 1) % 150) for i in range(150)] + [(150 + i, 149 + i) for i in range(30)], "waiter long, holder long")
    assert sorted(r.txn for r in overlay.deadlocked(waits).collect()) == list(range(150))


def test_deadlocks_equal_brute_force(spark):
    rng = random.Random(3)
    for n, m in ((40, 45), (60, 70), (30, 60)):
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)} | {(100 + i, 100 + (i + 1) % 7) for i in range(7)} | {(103, 5)}
        reach = {x: {b for a, b in edges if a == x} for x in {a for a, _ in edges}}
        for _ in range(n + 10):
            reach = {x: r | {z for y in r for z in reach.get(y, ())} for x, r in reach.items()}
        got = sorted(r.txn for r in overlay.deadlocked(spark.createDataFrame(sorted(edges), "waiter long, holder long")).collect())
        assert got == sorted(x for x, r in reach.items() if x in r)


def test_a_ring_of_ten_thousand(spark):
    waits = spark.range(10_000).selectExpr("id AS waiter", "(id + 1) % 10000 AS holder")
    assert overlay.deadlocked(waits).count() == 10_000


def test_skip_until(spark):
    rows = spark.createDataFrame([(k, 6 if k == 3 else None) for k in range(10)], "key long, u long")
    assert sorted(r.key for r in compaction.skip_until(rows, F.col("u")).collect()) == [0, 1, 2, 6, 7, 8, 9]


def test_filter_decisions(spark):
    rows = spark.createDataFrame([(k, k) for k in range(12)], "key long, value long")
    v = F.col("value")
    decision = F.when(v == 2, "skip").when(v == 7, "remove").when(v == 9, "change").otherwise("keep")
    got = compaction.decide(rows, decision, F.lit(90).cast("long"), F.col("key") + 3).collect()
    assert sorted((r.key, r.value) for r in got) == [(0, 0), (1, 1), (5, 5), (6, 6), (8, 8), (9, 90), (10, 10), (11, 11)]


def test_recovery_filter(spark):
    log = log_of(spark, [(k, k, "PUT", k) for k in range(10)])
    verdict = F.when(F.col("seq") == 6, "stop").when(F.col("seq") == 2, "ignore")
    assert sorted(r.seq for r in compaction.recover(log, verdict).collect()) == [0, 1, 3, 4, 5]
    with pytest.raises(Exception, match="corrupt record"):
        compaction.recover(log, F.when(F.col("seq") == 3, "corrupt")).collect()


def test_user_fold_in_order(spark):
    rows = [(1, 1, "PUT", 5), (1, 3, "MERGE", 2), (1, 2, "MERGE", 7), (2, 1, "DELETE", None), (3, 9, "MERGE", 4)]
    got = as_map(mvcc.resolve_with(log_of(spark, rows), lambda key, base, xs: int("".join(map(str, [base or 0, *xs])))))
    assert got == {1: 572, 3: 4}


def test_overlay_hides_and_replaces(spark):
    base = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "key long, value long")
    delta = log_of(spark, [(1, 1, "PUT", 11), (2, 2, "DELETE", None), (4, 3, "PUT", 40), (4, 4, "PUT", 41)])
    assert as_map(overlay.overlay(base, delta)) == {1: 11, 3: 30, 4: 41}
