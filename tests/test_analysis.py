"""Brute-force checks of prefix sums, reuse distance, simulators, scalars and files."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import scalars, stats
from tidelog.operators import advisor, blocks, ordering, simulate, trace, workload
from tidelog.sources import formats
from tidelog.sources.scratch import new_path


def test_prefix_sums_equal_one_window(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3), rng.randrange(50), i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g long, k long, i long, v long")
    for descending in (False, True):
        got = {(r.g, r.i): r.s for r in ordering.prefix_sums(df, ["k", "i"], {"s": F.col("v")}, ["g"], descending).collect()}
        for g in range(3):
            total = 0
            for _, k, i, v in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1] if descending else r[1], r[2])):
                total += v
                assert got[(g, i)] == total


def trace_of(spark, n=700, seed=5):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, 20) for _ in range(60)]
    rows = [(b, sizes[b], i + 1, i, b % 3 == 0) for i, b in enumerate(min(rng.randrange(60), rng.randrange(60)) for _ in range(n))]
    return rows, spark.createDataFrame(rows, "block long, size long, seq long, sec long, high boolean")


@pytest.mark.parametrize("leaf", [4, 15])
def test_reuse_distance_equals_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(blocks, "LEAF", leaf)
    rows, df = trace_of(spark)
    last, want = {}, {}
    for b, _, seq, *_ in rows:
        if b in last:
            want[seq] = sum({r[0]: r[1] for r in rows[last[b] : seq - 1]}.values())
        last[b] = seq
    assert {r.seq: r.distance for r in blocks.reuse_distance(df).collect()} == want


def test_lru_curve_equals_simulation(spark):
    rows, df = trace_of(spark)
    unit = df.withColumn("size", F.lit(1).cast("long"))
    curve = {r.capacity: r.misses for r in simulate.lru_curve(blocks.reuse_distance(unit), len(rows), [5, 20, 60]).collect()}
    simulated = {r.capacity: r.misses for r in simulate.simulate(df, [("lru", c) for c in (5, 20, 60)], unit_sizes=True, shards=1).collect()}
    assert curve == simulated


def test_policies_hold_their_capacity_and_opt_is_best(spark):
    rows, _ = trace_of(spark, 2000)
    upcoming, after = {}, {}
    for b, _, seq, *_ in reversed(rows):
        upcoming[seq], after[b] = after.get(b, 1 << 60), seq
    hits = {}
    for name, make in simulate.POLICIES.items():
        cache = make(20)
        hits[name] = sum(cache.access(b, 1, seq, upcoming[seq], high) for b, _, seq, _, high in rows)
        assert cache.used <= 20
    assert all(hits["opt"] >= h for name, h in hits.items() if name not in ("hybrid", "thompson", "linucb"))
    assert hits["lru"] > 0


def test_simulation_goes_by_batches_and_equals_brute_force(spark):
    rows, df = trace_of(spark)
    upcoming, after = {}, {}
    for b, _, seq, *_ in reversed(rows):
        upcoming[seq], after[b] = after.get(b, 1 << 60), seq
    configs = [(p, c) for p in simulate.POLICIES for c in (20, 90)]
    want = {}
    for policy, capacity in configs:
        cache = simulate.POLICIES[policy](capacity)
        for b, size, seq, sec, high in rows:
            miss = not cache.access(b, size, seq, upcoming[seq], high)
            if seq > 30:
                n = want.setdefault((policy, capacity, sec // 100), [0, 0, 0])
                n[:] = n[0] + 1, n[1] + miss, n[2] + miss * size
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = simulate.simulate(df, configs, shards=1, warmup=30, slot=100)
        assert {(r.policy, r.capacity, r.slot): [r.accesses, r.misses, r.miss_bytes] for r in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()  # that holds a whole shard in a Python worker


@pytest.mark.parametrize("policy", ["lfu", "opt", "gdsize"])
def test_scored_policies_keep_no_entry_per_access(policy):
    rng, cache, after, upcoming = random.Random(3), simulate.POLICIES[policy](60), {}, {}
    trace = [min(rng.randrange(40), rng.randrange(40)) for _ in range(6000)]
    for at in range(len(trace), 0, -1):
        upcoming[at], after[trace[at - 1]] = after.get(trace[at - 1], 1 << 60), at
    held, floor, got, want = {}, 0.0, [], []  # key -> (score, at of that score, key, size, hits)
    for at, key in enumerate(trace, 1):
        size, hit = 1 + key % 9, key in held
        got.append(cache.access(key, size, at, upcoming[at], False))
        assert len(cache.heap) <= 2 * len(cache.held) + 64
        while not hit and sum(h[3] for h in held.values()) + size > 60:
            out = min(held.values())
            floor = max(floor, out[0])
            del held[out[2]]
        hits = held[key][4] + 1 if hit else 1
        score = {"lfu": float(hits), "opt": -float(upcoming[at]), "gdsize": floor + 1.0 / size}[policy]
        held[key] = (score, held[key][1] if hit and held[key][0] == score else at, key, size, hits)
        want.append(hit)
    assert got == want


def test_histogram_limits():
    limits = stats.bucket_limits(10_000)
    assert limits[:8] == (1, 2, 3, 4, 6, 9, 13, 19)
    assert all(a < b for a, b in zip(limits, limits[1:]))


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.parse_number(F.lit("3k")).alias("k"), scalars.parse_number(F.lit("x")).alias("bad"), scalars.parse_boolean(F.lit(" True ")).alias("b"),
        scalars.human_number(F.lit(12_345_678)).alias("n"), scalars.human_bytes(F.lit(3 << 20)).alias("mb"), scalars.human_micros(F.lit(5)).alias("us"),
        scalars.difference_offset(F.lit("abcd"), F.lit("abxd")).alias("d"), scalars.varint_hex(F.lit(300).cast("long")).alias("v"),
        scalars.length_prefixed(F.lit("ab")).alias("p"), scalars.unzigzag(scalars.zigzag(F.lit(-7).cast("long"))).alias("z"),
        scalars.xor_bytes(F.array(F.lit(b"\x01\x02"), F.lit(b"\x03"))).alias("x"), scalars.from_hex(scalars.to_hex(F.lit("hé"))).cast("string").alias("h"),
    ).first()
    assert (row.k, row.bad, row.b, row.n, row.mb, row.us) == (3072, None, True, "12M", "3.00 MB", "5 us")
    assert (row.d, row.v, row.p, row.z, bytes(row.x), row.h) == (2, "AC02", "026162", -7, b"\x02\x02", "hé")


def test_files_and_backups(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("key"), F.col("id").alias("value"))
    path = new_path(spark)
    formats.write_sorted(rows, path, files=4)
    files = formats.file_properties(spark, path).orderBy("smallest").collect()
    assert sum(f.entries for f in files) == 1000
    assert all(a.largest < b.smallest for a, b in zip(files, files[1:]))
    root = new_path(spark)
    for i in (1, 2):
        formats.backup(rows.where(F.col("key") < 100 * i), root, i)
    assert {r.backup_id: r.rows for r in formats.backups(spark, root).collect()} == {1: 100, 2: 200}
    assert formats.restore(spark, root, 2).count() == 200


def test_expressions_are_checked():
    for bad in ("click; drop", "system('x')", "other > 1", "click > 'a'"):
        with pytest.raises(ValueError):
            advisor.checked(bad, {"click"})


def test_zipfian_is_skewed_and_repeatable(spark):
    a = workload.zipfian(spark, 5000, 100)
    assert a.groupBy("key").count().orderBy(F.col("count").desc()).first()["key"] == 0
    assert a.agg(F.sum("key")).first() == workload.zipfian(spark, 5000, 100).agg(F.sum("key")).first()


def test_correlation_fails_on_too_many_types(spark):
    rows = spark.range(65).selectExpr("concat('t', id) AS type", "0 AS cf", "1 AS key", "id AS us", "id AS seq")
    with pytest.raises(ValueError, match="operation types"):
        trace.correlation(rows)
    assert trace.correlation(rows.where("seq < 64")).count() == 64 * 63 // 2
