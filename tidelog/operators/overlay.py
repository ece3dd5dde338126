"""Joins of a key space with pending writes, snapshots and transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.merge import MergeOperator
from ..sources.scratch import cut
from .mvcc import newest, resolve


def overlay(base: DataFrame, delta: DataFrame) -> DataFrame:
    """key, value of the base with a batch of puts and deletes over it; the batch wins, its deletes hide."""
    d = newest(delta).select("key", F.col("op").alias("_op"), F.col("value").alias("_value"))
    joined = base.select("key", "value").join(d, "key", "full_outer")
    return joined.where("_op IS NULL OR _op NOT IN ('DELETE', 'SINGLE_DELETE')").select("key", F.when(F.col("_op").isNotNull(), F.col("_value")).otherwise(F.col("value")).alias("value"))


def overlay_get(base_log: DataFrame, delta: DataFrame, keys: DataFrame, merge: MergeOperator) -> DataFrame:
    """Reads of keys through a batch: its merges fold on the base's value."""
    wanted = keys.select("key").distinct()
    both = base_log.join(wanted, "key", "left_semi").unionByName(delta.join(wanted, "key", "left_semi"))
    return keys.join(resolve(both, merge), "key", "left")


def conflicts(tracked: DataFrame, log: DataFrame) -> DataFrame:
    """The tracked(key, seq) rows whose key was written after the tracked seq."""
    last = log.groupBy("key").agg(F.max("seq").alias("_last"))
    return tracked.join(last, "key").where("_last > seq").select("key", "seq", F.col("_last").alias("written_at"))


def as_of_snapshot(probes: DataFrame, log: DataFrame) -> DataFrame:
    """For probes(key, at): the newest version of the key with seq <= at (null if none).

    Probes and versions of a key are ordered together, so the join never multiplies rows."""
    value = log.schema["value"].dataType
    versions = log.select("key", F.col("seq").alias("at"), F.lit(0).alias("_kind"), F.struct("seq", "op", "value").alias("_v"))
    asked = probes.select("key", "at", F.lit(1).alias("_kind"), F.lit(None).cast(versions.schema["_v"].dataType).alias("_v"))
    w = Window.partitionBy("key").orderBy("at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    got = versions.unionByName(asked).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_kind = 1")
    live = F.col("_v.op") != "DELETE"
    return got.select("key", "at", F.when(live, F.col("_v.seq")).alias("seq"), F.when(live, F.col("_v.value")).cast(value).alias("value"))


def committed(log: DataFrame, commits: DataFrame, snapshot) -> DataFrame:
    """Rows of the log whose transaction committed at or before the snapshot (commits: txn, commit_seq)."""
    return log.join(commits.where(F.col("commit_seq") <= snapshot).select("txn"), "txn", "left_semi")


def two_phase(marks: DataFrame) -> DataFrame:
    """txn, state: prepared transactions without an outcome are in doubt (marks: txn, mark)."""
    seen = marks.groupBy("txn").agg(*(F.max(F.when(F.col("mark") == m, True)).alias(m) for m in ("prepare", "commit", "rollback")))
    state = F.when(F.col("commit"), "committed").when(F.col("rollback"), "rolled back").otherwise("in doubt")
    return seen.where("prepare").select("txn", state.alias("state"))


def deadlocked(waits: DataFrame) -> DataFrame:
    """txn of waits(waiter, holder) that wait for themselves over any number of waits.

    A transaction that waits for one other is passed over by pointer doubling: after k rounds its pointer is 2^k waits on,
    or at the end of its chain, a transaction that waits for several (or, by the last round, on a ring of such transactions, each of which is deadlocked). Only
    those that wait for several are searched by squared reachability; what lies on the chains between
    two of them that reach each other is marked by the same pointers. So rounds grow with the logarithm of the longest cycle, and pairs only
    with the transactions that wait for several."""
    edges = cut(waits.where("waiter IS NOT NULL AND holder IS NOT NULL").select("waiter", "holder").distinct())
    for _ in range(6):  # only speed: tails that wait for nobody or that nobody waits for
        edges = cut(edges.join(edges.select(F.col("holder").alias("waiter")).distinct(), "waiter", "left_semi").join(edges.select(F.col("waiter").alias("holder")).distinct(), "holder", "left_semi").select("waiter", "holder"))
    out = edges.groupBy("waiter").agg(F.count("*").alias("n"), F.min("holder").alias("holder"))
    single = out.where("n = 1").select(F.col("waiter").alias("at"), F.col("holder").alias("to"))
    several = out.where("n > 1").select(F.col("waiter").alias("txn"))
    jumps, rounds = [cut(single)], max(1, single.count()).bit_length() + 1
    for _ in range(rounds):  # a pointer that leaves the single ones stays where it left them
        now = jumps[-1]
        onward = now.select(F.col("at").alias("to"), F.col("to").alias("next"))
        jumps.append(cut(now.join(onward, "to", "left").select("at", F.coalesce("next", "to").alias("to"))))
    ends = jumps[-1]
    ring = cut(ends.join(single.select(F.col("at").alias("to")), "to", "left_semi").select(F.col("to").alias("txn")).distinct())  # after more steps than there are
    branch = edges.join(several.select(F.col("txn").alias("waiter")), "waiter", "left_semi")
    whole = branch.join(ends.select(F.col("at").alias("holder"), F.col("to").alias("end")), "holder", "left").select("waiter", "holder", F.coalesce("end", "holder").alias("end"))
    whole = cut(whole.join(several.select(F.col("txn").alias("end")), "end", "left_semi").select("waiter", "holder", "end"))
    reach = cut(whole.select("waiter", F.col("end").alias("holder")).distinct())
    before = -1
    while (n := reach.count()) != before:
        before = n
        longer = reach.alias("a").join(reach.alias("b"), F.col("a.holder") == F.col("b.waiter")).select(F.col("a.waiter"), F.col("b.holder"))
        reach = cut(reach.union(longer).distinct())
    # A wait of a branch is on a cycle if its chain's end reaches the branch again (or is it); so is all of that chain.
    back = reach.select(F.col("waiter").alias("end"), F.col("holder").alias("waiter"))
    closed = whole.join(back, ["end", "waiter"], "left_semi").unionByName(whole.where("end = waiter"))
    marked = cut(closed.select(F.col("waiter").alias("txn")).union(closed.select(F.col("holder").alias("txn"))).distinct())
    if not marked.isEmpty():
        for jump in jumps[:-1]:
            marked = cut(marked.union(marked.join(jump.select(F.col("at").alias("txn"), "to"), "txn").select(F.col("to").alias("txn"))).distinct())
    return ring.union(marked).distinct()
