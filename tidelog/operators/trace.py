"""Reports on an operation trace (type, cf, key, size, us, seq): keys, sizes, rates, correlations.

Statistics are per (type, cf). Everything aggregates partially by key or second before a
shuffle; ranks over keys use range-dealt positions instead of one sorted partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import positions

BY = ["type", "cf"]
#: Operation types that correlation takes (each is a column there); more are an error.
MOST_TYPES = 64


def sampled(trace: DataFrame, every: int) -> DataFrame:
    """Systematic sampling: of each type the first of every so many operations, in order."""
    return positions(trace, ["seq"], "_n", ["type"]).where((F.col("_n") - 1) % every == 0).select(*trace.columns)


def with_second(trace: DataFrame) -> DataFrame:
    """Add sec, whole seconds since the trace began."""
    began = trace.agg(F.min("us").alias("_began"))
    return trace.join(F.broadcast(began)).withColumn("sec", F.floor((F.col("us") - F.col("_began")) / 1_000_000)).drop("_began")  # one row


def key_stats(trace: DataFrame) -> DataFrame:
    """Accesses, hits (a get of size 0 misses), bytes and the first access of each key."""
    hit = (~((F.col("type") == "get") & (F.col("size") == 0))).cast("long")
    return trace.groupBy(*BY, "key").agg(F.count("*").alias("n"), F.sum(hit).alias("hits"), F.sum("size").alias("bytes"), F.min("seq").alias("first_seq"))


def key_ids(stats: DataFrame) -> DataFrame:
    """Add key_id: the key's place in byte order, from 0, per (type, cf)."""
    return positions(stats, ["key"], "_k", BY).withColumn("key_id", F.col("_k") - 1).drop("_k")


def access_distribution(stats: DataFrame, over: int = 0) -> DataFrame:
    """How many keys have each access count above a threshold."""
    return stats.where(F.col("n") > over).groupBy(*BY, "n").agg(F.count("*").alias("keys"))


def size_distribution(trace: DataFrame, size: Column, width: int = 1) -> DataFrame:
    """bucket (size div width), n, and whether the median, the first bucket at half of all, is there."""
    b = trace.groupBy(*BY, F.floor(size / width).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    group = Window.partitionBy(*BY)  # buckets of sizes are few
    upto = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    half = F.sum("n").over(group) / 2.0
    return b.select(*BY, "bucket", "n", ((upto >= half) & (upto - F.col("n") < half)).alias("median"))


def size_moments(trace: DataFrame, size: Column) -> DataFrame:
    x = size.cast("long")
    n, s, q = F.count("*"), F.sum(x).cast("double"), F.sum(x * x).cast("double")
    return trace.groupBy(*BY).agg((s / n).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), q / n - (s / n) * (s / n))).alias("deviation"))


def prefix_stats(stats: DataFrame, length: int) -> DataFrame:
    """By the first characters of the key: accesses, keys, accesses per key, share of hits. Every prefix has its row, the last one, too."""
    prefix = F.substring(F.col("key").cast("string"), 1, length)
    g = stats.groupBy(*BY, prefix.alias("prefix")).agg(F.sum("n").alias("n"), F.count("*").alias("keys"), F.sum("hits").alias("hits"))
    return g.select(*BY, "prefix", "n", "keys", (F.col("n") / F.col("keys")).alias("per_key"), (F.col("hits") / F.col("n")).alias("hit_share"))


def top(rows: DataFrame, k: int, by: Column, tie: list[str], group: list[str] = BY) -> DataFrame:
    """The k highest rows of each group; Spark cuts each task's rows to k per group before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(by.desc(), *tie))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def per_second(trace: DataFrame) -> DataFrame:
    """Operations of each second of the trace, empty seconds included."""
    timed = with_second(trace)
    n = timed.groupBy(*BY, "sec").agg(F.count("*").alias("n"))
    span = timed.agg(F.max("sec").alias("last"))
    slots = n.select(*BY).distinct().join(F.broadcast(span)).select(*BY, F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("sec"))
    return slots.join(n, [*BY, "sec"], "left").select(*BY, "sec", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def peak_and_average(trace: DataFrame) -> DataFrame:
    """Most operations in a second, and all over the whole seconds that the trace lasts."""
    timed = with_second(trace)
    n = timed.groupBy(*BY, "sec").agg(F.count("*").alias("n"))
    span = trace.agg(F.floor((F.max("us") - F.min("us")) / 1_000_000).alias("duration"))
    return n.groupBy(*BY).agg(F.max("n").alias("peak"), F.sum("n").alias("total")).join(F.broadcast(span)).select(*BY, "peak", "total", (F.col("total") / F.greatest("duration", F.lit(1))).alias("average"))


def busiest_seconds(trace: DataFrame, k: int, length: int) -> DataFrame:
    """The k busiest seconds of each (type, cf), with what each key prefix had in them."""
    timed = with_second(trace).withColumn("prefix", F.substring(F.col("key").cast("string"), 1, length))
    by_prefix = timed.groupBy(*BY, "sec", "prefix").agg(F.count("*").alias("n"))
    best = top(by_prefix.groupBy(*BY, "sec").agg(F.sum("n").alias("total")), k, F.col("total"), ["sec"])
    return by_prefix.join(best, [*BY, "sec"]).select(*BY, "place", "sec", "total", "prefix", "n")


def unique_growth(trace: DataFrame, seconds: int) -> DataFrame:
    """Distinct keys seen up to each time slot that has any, and their share of all in the end."""
    first = with_second(trace).groupBy(*BY, "key").agg(F.floor(F.min("sec") / seconds).alias("slot"))
    new = first.groupBy(*BY, "slot").agg(F.count("*").alias("new"))
    group = Window.partitionBy(*BY)
    seen = F.sum("new").over(group.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
    return new.select(*BY, "slot", seen.alias("keys"), (seen / F.sum("new").over(group)).alias("share"))


def correlation(trace: DataFrame) -> DataFrame:
    """For types X then Y on one key: how often, and the mean gap between the latest X and a Y (equal times are skipped)."""
    types = [r[0] for r in trace.select("type").distinct().orderBy("type").limit(MOST_TYPES + 1).collect()]  # the operation types, eight in all
    if len(types) > MOST_TYPES:
        raise ValueError(f"a trace of more than {MOST_TYPES} operation types")
    before = Window.partitionBy("cf", "key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = trace.withColumns({f"_at_{i}": F.max(F.when(F.col("type") == t, F.col("us"))).over(before) for i, t in enumerate(types)})
    pairs = F.array(*(F.struct(F.lit(t).alias("first_type"), F.col(f"_at_{i}").alias("at")) for i, t in enumerate(types)))
    each = seen.select(F.col("type").alias("second_type"), "us", F.explode(pairs).alias("p")).where("p.at IS NOT NULL AND p.at <> us")
    return each.groupBy(F.col("p.first_type").alias("first_type"), "second_type").agg(F.count("*").alias("n"), F.sum(F.col("us") - F.col("p.at")).cast("decimal(38,0)").alias("gap")).select("first_type", "second_type", "n", (F.col("gap").cast("double") / F.col("n")).alias("mean_gap_us"))


def time_series(trace: DataFrame) -> DataFrame:
    """type, cf, sec, key_id of every operation."""
    ids = key_ids(key_stats(trace)).select(*BY, "key", "key_id")
    return with_second(trace).join(ids, [*BY, "key"]).select("seq", *BY, "sec", "key_id")


def keyspace_join(keys: DataFrame, stats: DataFrame) -> DataFrame:
    """Every key of the whole key space with its accesses, 0 for those that none touched."""
    n = stats.groupBy("key").agg(F.sum("n").alias("n"))
    return keys.join(n, "key", "left").select("key", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def summary(trace: DataFrame) -> DataFrame:
    """Operations and accessed keys by (cf, type), by cf and in all."""
    pre = trace.groupBy("cf", "type", "key").agg(F.count("*").alias("n"))
    return pre.rollup("cf", "type").agg(F.sum("n").alias("n"), F.countDistinct("key").alias("keys"))


def readable(trace: DataFrame) -> DataFrame:
    line = F.concat_ws(" ", F.lower(F.hex(F.col("key").cast("string").cast("binary"))), "type", F.col("cf").cast("string"), F.col("size").cast("string"), F.col("us").cast("string"))
    return trace.select("seq", line.alias("line"))


def replay_schedule(trace: DataFrame, speed: int) -> DataFrame:
    """seq and the microsecond, from the start, at which a replay `speed` times as fast issues it."""
    began = trace.agg(F.min("us").alias("_began"))
    return trace.join(F.broadcast(began)).select("seq", "type", "key", F.floor((F.col("us") - F.col("_began")) / speed).alias("due_us"))
