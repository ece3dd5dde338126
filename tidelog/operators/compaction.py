"""Dataset rewriting: which versions a compaction keeps, and what file pickers would choose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.merge import MergeOperator
from .ordering import prefix_sums

#: The stripe above the newest snapshot.
LATEST = (1 << 62) - 1


def with_stripe(log: DataFrame, snapshots: list[int]) -> DataFrame:
    """Add stripe: the least snapshot that sees a version, LATEST above all (snapshots are few and held by readers)."""
    stripe: Column = F.lit(LATEST)
    for s in sorted(snapshots, reverse=True):
        stripe = F.when(F.col("seq") <= s, F.lit(s)).otherwise(stripe)
    return log.withColumn("stripe", stripe.cast("long"))


def keep_newest(log: DataFrame, snapshots: list[int], bottommost: bool = False) -> DataFrame:
    """key, stripe, seq, op, value: the newest version per key and stripe. At the bottom level, deletes of the earliest stripe have nothing to hide and go, and seq is zeroed there."""
    v = with_stripe(log, snapshots)
    kept = v.groupBy("key", "stripe").agg(F.max("seq").alias("seq"), F.max_by(F.struct("op", "value"), "seq").alias("_v")).select("key", "stripe", "seq", "_v.op", "_v.value")
    if not bottommost:
        return kept
    earliest = F.lit(min(snapshots) if snapshots else LATEST)
    kept = kept.where(~((F.col("stripe") == earliest) & F.col("op").isin("DELETE", "SINGLE_DELETE")))
    return kept.withColumn("seq", F.when((F.col("stripe") == earliest) & (F.col("op") == "PUT"), F.lit(0).cast("long")).otherwise(F.col("seq")))


def merge_stripes(log: DataFrame, snapshots: list[int], merge: MergeOperator) -> DataFrame:
    """key, stripe, op, value: merges collapse per stripe; on a base of the same stripe they become a put, else stay a merge."""
    v = with_stripe(log, snapshots)
    if merge.reduces:
        return _reduced_stripes(v, merge)
    rows = v.groupBy("key", "stripe").agg(
        F.max(F.when(F.col("op") != "MERGE", F.col("seq"))).alias("base_seq"),
        F.max_by(F.struct("op", "value"), F.when(F.col("op") != "MERGE", F.col("seq"))).alias("base"),
        F.array_sort(F.collect_list(F.when(F.col("op") == "MERGE", F.struct("seq", "value")))).alias("m"),
    )
    after = F.transform(F.filter("m", lambda o: F.col("base_seq").isNull() | (o["seq"] > F.col("base_seq"))), lambda o: o["value"])
    rows = rows.select("key", "stripe", "base_seq", "base", after.alias("operands"))
    base_value = F.when(F.col("base.op") == "PUT", F.col("base.value"))
    op = F.when(F.col("base_seq").isNull(), "MERGE").when(F.size("operands") > 0, "PUT").otherwise(F.col("base.op"))
    value = F.when((F.size("operands") > 0) | (F.col("base.op") == "PUT"), merge.fold(base_value, F.col("operands")))
    return rows.select("key", "stripe", op.alias("op"), value.alias("value"))


def _reduced_stripes(v: DataFrame, merge: MergeOperator) -> DataFrame:
    """merge_stripes of a commutative operator: operands are reduced before the shuffle, whatever their number."""
    bases = v.where("op <> 'MERGE'").groupBy("key", "stripe").agg(F.max("seq").alias("base_seq"), F.max_by(F.struct("op", "value"), "seq").alias("base"))
    after = v.where("op = 'MERGE'").join(bases.select("key", "stripe", "base_seq"), ["key", "stripe"], "left").where("base_seq IS NULL OR seq > base_seq")
    folded = after.groupBy("key", "stripe").agg(merge.reduces(F.col("value")).alias("operands"), F.count("*").alias("n"))
    rows = bases.join(folded, ["key", "stripe"], "full_outer")
    op = F.when(F.col("base_seq").isNull(), "MERGE").when(F.col("n") > 0, "PUT").otherwise(F.col("base.op"))
    value = merge.combine(F.when(F.col("base.op") == "PUT", F.col("base.value")), F.col("operands"))
    return rows.select("key", "stripe", op.alias("op"), value.alias("value"))


def pair_single_deletes(log: DataFrame, bottommost: bool = True) -> DataFrame:
    """Within a key, newest first: a single delete and the put right below it vanish together; of single deletes in a row only the last counts; at the bottom one without a put goes."""
    newest_first = Window.partitionBy("key").orderBy(F.col("seq").desc())
    v = log.withColumns({"_below": F.lead("op").over(newest_first), "_above": F.lag("op").over(newest_first)})
    single = F.col("op") == "SINGLE_DELETE"
    gone = (single & (F.col("_below").isin("PUT", "SINGLE_DELETE"))) | ((F.col("op") == "PUT") & (F.col("_above") == "SINGLE_DELETE"))
    if bottommost:
        gone = gone | (single & F.col("_below").isNull())
    return v.where(~F.coalesce(gone, F.lit(False))).select(*log.columns)


def filter_newest(log: DataFrame, remove: Column, change: Column | None = None) -> DataFrame:
    """A compaction filter sees only the newest version of a key: it may drop it or change its value."""
    tops = log.groupBy("key").agg(F.max("seq").alias("_top"))  # partial aggregation, so a hot key is no one task's window
    v = log.join(tops, "key").withColumn("_newest", F.col("seq") == F.col("_top")).where(~(F.col("_newest") & F.coalesce(remove, F.lit(False))))
    if change is not None:
        v = v.withColumn("value", F.when(F.col("_newest"), change).otherwise(F.col("value")))
    return v.select(*log.columns)


def skip_until(rows: DataFrame, until: Column) -> DataFrame:
    """Rows in key order where a row with a non-null `until` removes itself and all keys below it. Keys are unique numbers.

    The running maximum is taken per range of keys and carried over from the ranges before."""
    from .ordering import running

    v = running(rows.withColumn("_until", until), ["key"], F.col("_until"), "_bar", False, inclusive=False)
    return v.where(F.col("_until").isNull() & (F.col("_bar").isNull() | (F.col("key") >= F.col("_bar")))).select(*rows.columns)


def live_by_ttl(rows: DataFrame, ttl: int, now: Column | int, seconds: Column) -> DataFrame:
    """Rows that are not stale: with a positive ttl, seconds + ttl >= now."""
    return rows if ttl <= 0 else rows.where(~(seconds + ttl < now))


def drop_statistics(log: DataFrame, snapshots: list[int], remove: Column) -> DataFrame:
    """What a full compaction does with versions: hidden by a newer one, obsolete deletes, removed by the filter, kept."""
    v = with_stripe(log, snapshots)
    earliest = F.col("stripe") == F.lit(min(snapshots) if snapshots else LATEST)
    of_stripe = v.groupBy("key", "stripe").agg(F.max("seq").alias("_s"))
    tops = of_stripe.groupBy("key").agg(F.max("_s").alias("_k"))
    v = v.join(of_stripe, ["key", "stripe"]).join(tops, "key")
    fate = F.when(F.col("seq") < F.col("_s"), "hidden").when(earliest & (F.col("op") == "DELETE"), "obsolete").when((F.col("seq") == F.col("_k")) & remove, "user").otherwise("kept")
    return v.groupBy(fate.alias("fate")).agg(F.count("*").alias("n"))


def fifo_pick(files: DataFrame, most_bytes: int) -> DataFrame:
    """Files that first-in-first-out compaction deletes: all that would not fit with the newer ones."""
    running = prefix_sums(files, ["created", "file"], {"_total": F.col("bytes")}, descending=True)
    return running.where(F.col("_total") > most_bytes).select("file", "created", "bytes")


def fifo_ttl_pick(files: DataFrame, ttl: int, now: Column | int) -> DataFrame:
    return files.where(F.col("created") < now - ttl)


def min_overlap_order(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """file, ratio of upper-level files by overlapping lower bytes * 1024 / own bytes, least first."""
    from .ranges import overlapping

    asked = upper.select(F.col("file").alias("up"), F.col("bytes").alias("own"), F.col("smallest").alias("begin"), (F.col("largest") + 1).alias("end"))
    met = overlapping(lower, asked).groupBy("up").agg(F.sum("bytes").alias("met"))
    return asked.join(met, "up", "left").select(F.col("up").alias("file"), F.floor(F.coalesce("met", F.lit(0)) * 1024 / F.col("own")).cast("long").alias("ratio"))


def delete_triggers(rows: DataFrame, window: int, deletes: int, file: str = "file", order: str = "seq") -> DataFrame:
    """file, most: files in which some `window` consecutive entries hold `deletes` deletes or more."""
    w = Window.partitionBy(file).orderBy(order).rowsBetween(1 - window, 0)
    counted = rows.withColumn("_d", F.sum(F.col("op").isin("DELETE", "SINGLE_DELETE").cast("long")).over(w))
    return counted.groupBy(file).agg(F.max("_d").alias("most")).where(F.col("most") >= deletes)


def squeeze(log: DataFrame, cap: int = 127) -> DataFrame:
    """key, seq, value, inserts: the newest put per key and how often it was written, capped."""
    return log.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value"), F.least(F.count("*"), F.lit(cap).cast("long")).alias("inserts"))


def hot_split(squeezed: DataFrame, threshold: int) -> DataFrame:
    """Keys written over the threshold are rewritten to fast memory, the others are flushed."""
    return squeezed.withColumn("fate", F.when(F.col("inserts") > threshold, "rewrite").otherwise("flush"))


def tier_reward(levels: DataFrame) -> DataFrame:
    """The deterministic part of a learned compaction choice, per level(level, bytes, runs, written, read): write and read amplification and their negated sum."""
    wa = F.when(F.col("bytes") > 0, F.col("written") / F.col("bytes")).otherwise(0.0)
    return levels.select("level", wa.alias("write_amp"), F.col("runs").cast("double").alias("read_amp"), (-(wa + F.col("runs"))).alias("reward"))


def decide(rows: DataFrame, decision: Column, new_value: Column, until: Column) -> DataFrame:
    """A filter with four decisions per row in key order: keep, remove, change (to new_value), skip (remove it and all keys below until)."""
    v = rows.withColumns({"_decision": decision, "_new": new_value, "_until": F.when(decision == "skip", until)})
    kept = skip_until(v, F.col("_until")).where("_decision <> 'remove'")
    return kept.withColumn("value", F.when(F.col("_decision") == "change", F.col("_new")).otherwise(F.col("value"))).select(*rows.columns)


def recover(log: DataFrame, verdict: Column) -> DataFrame:
    """A filter on log batches during recovery: ignore drops a row's batch, stop ends at the first batch it names, corrupt fails, all else is kept."""
    v = log.withColumn("_verdict", verdict)
    end = v.where("_verdict = 'stop'").agg(F.min("seq").alias("_end"))
    v = v.join(F.broadcast(end)).where("_end IS NULL OR seq < _end")  # one row
    checked = F.when(F.col("_verdict") == "corrupt", F.raise_error(F.lit("corrupt record"))).otherwise(F.col("seq"))
    return v.withColumn("seq", checked).where("_verdict IS NULL OR _verdict <> 'ignore'").select(*log.columns)


def drop_buried(log: DataFrame, tombstones: DataFrame) -> DataFrame:
    """A full compaction applies range tombstones: versions that a newer one covers go, and so do the tombstones."""
    from .ranges import buried

    return log.join(buried(log, tombstones), ["key", "seq"], "left_anti")


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    """Sorted runs as one, in key order and newest first."""
    every = runs[0]
    for r in runs[1:]:
        every = every.unionByName(r)
    return every.orderBy("key", F.col("seq").desc())
