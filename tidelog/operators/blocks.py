"""Reports on a block-access trace (block, sst, level, bt, caller, size, sec, hit, seq)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import upper_bucket
from ..sources.code import ship
from .ordering import positions, prefix_sums

LIMITS = [1, 2, 3, 5, 10, 20, 50, 100, 1000, 10_000, 100_000, 1_000_000, 10_000_000, 100_000_000]


def percent(n: Column, d: Column) -> Column:
    """100 n / d, -1 where d is 0."""
    return F.when(d == 0, -1.0).otherwise(100.0 * n / d)


def _misses() -> Column:
    return F.sum((~F.col("hit")).cast("long"))


def block_stats(trace: DataFrame) -> DataFrame:
    """Per block: accesses, misses, size, first and last access."""
    return trace.groupBy("sst", "bt", "block").agg(F.count("*").alias("n"), _misses().alias("misses"), F.max("size").alias("size"), F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"))


def miss_ratio(trace: DataFrame, users: list[str]) -> DataFrame:
    """Miss ratio of all accesses, and of those by user callers."""
    user = F.col("caller").isin(*users)
    g = trace.agg(F.count("*").alias("n"), _misses().alias("m"), F.sum(user.cast("long")).alias("un"), F.sum((user & ~F.col("hit")).cast("long")).alias("um"))
    return g.select(percent(F.col("m"), F.col("n")).alias("all_ratio"), percent(F.col("um"), F.col("un")).alias("user_ratio"))


def miss_timeline(trace: DataFrame, unit: int, labels: list[str]) -> DataFrame:
    """Accesses, misses and miss ratio per time unit and label."""
    g = trace.groupBy(*labels, F.floor(F.col("sec") / unit).alias("slot")).agg(F.count("*").alias("n"), _misses().alias("misses"))
    return g.withColumn("ratio", percent(F.col("misses"), F.col("n")))


def access_timeline(trace: DataFrame, unit: int, labels: list[str]) -> DataFrame:
    return trace.groupBy(*labels, F.floor(F.col("sec") / unit).alias("slot")).agg(F.count("*").alias("n"))


def skew(trace: DataFrame, label: str, slices: list[int]) -> DataFrame:
    """Accesses and their share in each slice of labels by accesses, most first: slices end at percent * labels div 100."""
    counts = trace.groupBy(label).agg(F.count("*").alias("n"))
    placed = positions(counts.withColumn("_neg", -F.col("n")), ["_neg", label], "place")
    whole = counts.agg(F.count("*").alias("labels"), F.sum("n").alias("all"))
    slice_of = F.array_min(F.filter(F.array(*map(F.lit, slices)), lambda p: F.floor(p * F.col("labels") / 100) >= F.col("place")))
    g = placed.join(F.broadcast(whole)).groupBy(slice_of.alias("slice"), "all").agg(F.count("*").alias("labels"), F.sum("n").alias("n"))
    return g.where("slice IS NOT NULL").select("slice", "labels", "n", percent(F.col("n"), F.col("all")).alias("share"))


def reuse_gaps(trace: DataFrame) -> DataFrame:
    """Every access with the seq and second of the block's previous one (null at the first)."""
    w = Window.partitionBy("block").orderBy("seq")
    return trace.withColumns({"before_seq": F.lag("seq").over(w), "before_sec": F.lag("sec").over(w)})


#: Log2 of the trace positions whose dominance sums one task takes together.
LEAF = 15


def _leaf_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each row the bytes of rows before it (by seq) in the leaf whose prev is not larger: merge levels, bottom up."""
    pdf = pdf.sort_values("seq")
    x, y, size = (pdf[c].to_numpy(np.int64) for c in ("seq", "prev", "size"))
    at = x & ((1 << LEAF) - 1)
    out = np.zeros(len(pdf), np.int64)
    for level in range(LEAF):
        parent = at >> (level + 1)
        order = np.lexsort((x, y, parent))
        left = (at[order] >> level & 1) == 0
        run = np.cumsum(np.where(left, size[order], 0))
        new = np.append(True, parent[order][1:] != parent[order][:-1])
        start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        before = np.where(start > 0, run[start - 1], 0)
        out[order] += np.where(left, 0, run - before)
    return pd.DataFrame({"seq": x, "below": out})


def reuse_distance(trace: DataFrame) -> DataFrame:
    """seq, block, distance: distinct bytes accessed between this access and the previous one of the block.

    With x the place of an access and y that of its block's previous one (0 if none), the
    bytes wanted at n with previous p are those of x < n and y <= p, less all up to p. The
    first is a dominance sum, taken as in a merge sort: leaves of 2^LEAF places each in a
    task, and above them one prefix sum by y per pair of neighbouring halves, for all levels
    in one pass. Work is n log n, and no task sees more than a leaf or a range of y."""
    ship(trace.sparkSession)
    points = reuse_gaps(trace).select("seq", "block", "size", F.coalesce("before_seq", F.lit(0)).cast("long").alias("prev"))
    leaf = points.groupBy(F.shiftright("seq", LEAF).alias("leaf")).applyInPandas(lambda pdf: _leaf_sums(pdf), "seq long, below long")
    top = max(0, int(points.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]).bit_length())
    below = leaf
    if top > LEAF:
        each = points.select("seq", "prev", "size", F.explode(F.array(*map(F.lit, range(LEAF, top)))).alias("level"))
        each = each.withColumns({"parent": F.expr("shiftright(seq, level + 1)"), "left": F.expr("shiftright(seq, level) & 1") == 0})
        summed = prefix_sums(each, ["prev", "seq"], {"run": F.when(F.col("left"), F.col("size")).otherwise(0)}, ["level", "parent"])
        below = leaf.unionByName(summed.where(~F.col("left")).select("seq", F.col("run").alias("below"))).groupBy("seq").agg(F.sum("below").alias("below"))
    upto = prefix_sums(points, ["seq"], {"upto": F.col("size")}).select(F.col("seq").alias("prev"), "upto")
    asked = points.where("prev > 0").join(below, "seq").join(upto, "prev")
    return asked.select("seq", "block", (F.col("below") - F.col("upto")).cast("long").alias("distance"))


def bucketed_share(rows: DataFrame, value: str, limits: list[int] = LIMITS, labels: tuple[str, ...] = ()) -> DataFrame:
    """How many rows, and what share, fall under each limit (the first strictly above)."""
    g = rows.groupBy(*labels, upper_bucket(F.col(value), limits).alias("bucket")).agg(F.count("*").alias("n"))
    return g.withColumn("share", percent(F.col("n"), F.sum("n").over(Window.partitionBy(*labels) if labels else Window.partitionBy(F.lit(0)))))


def reuse_intervals(trace: DataFrame, labels: tuple[str, ...] = ()) -> DataFrame:
    """Seconds between accesses of a block, bucketed; repeats within a second are 0."""
    gaps = reuse_gaps(trace).where("before_sec IS NOT NULL").withColumn("gap", F.col("sec") - F.col("before_sec"))
    return bucketed_share(gaps, "gap", LIMITS, labels)


def lifetimes(trace: DataFrame) -> DataFrame:
    """Seconds between a block's first and last access, bucketed; blocks accessed once apart (-1)."""
    b = block_stats(trace).groupBy("block").agg(F.sum("n").alias("n"), F.min("first_sec").alias("f"), F.max("last_sec").alias("l"))
    life = F.when(F.col("n") == 1, F.lit(-1).cast("long")).otherwise(upper_bucket(F.col("l") - F.col("f"), LIMITS))
    return b.groupBy(life.alias("bucket")).agg(F.count("*").alias("n"))


def reuse_matrix(trace: DataFrame, windows: int) -> DataFrame:
    """Blocks accessed both in window i and in window j >= i; the last window takes the rest of the time.

    A block gives a pair of windows at most once, windows squared over two rows."""
    span = trace.agg(F.min("sec").alias("_a"), F.max("sec").alias("_z"))
    unit = F.greatest(F.floor((F.col("_z") - F.col("_a")) / windows), F.lit(1))
    w = F.least(F.floor((F.col("sec") - F.col("_a")) / unit), F.lit(windows - 1)).cast("long")
    seen = trace.join(F.broadcast(span)).select("block", w.alias("w")).groupBy("block").agg(F.collect_set("w").alias("ws"))
    pairs = seen.select(F.explode("ws").alias("i"), "ws").select("i", F.explode("ws").alias("j")).where("j >= i")
    return pairs.groupBy("i", "j").agg(F.count("*").alias("blocks"))


def access_share(trace: DataFrame, labels: list[str]) -> DataFrame:
    g = trace.groupBy(*labels).agg(F.count("*").alias("n"))
    return g.withColumn("share", percent(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(0)))))  # a row per label


def detailed_share(trace: DataFrame) -> DataFrame:
    """Accesses by caller and level, and by caller and block type, in one pass."""
    return trace.groupingSets([["caller", "level"], ["caller", "bt"]], "caller", "level", "bt").agg(F.grouping_id().alias("kind"), F.count("*").alias("n"))


def access_count_summary(trace: DataFrame) -> DataFrame:
    """How many blocks of each type have an access count under each limit."""
    return block_stats(trace).groupBy("bt", upper_bucket(F.col("n"), LIMITS).alias("bucket")).agg(F.count("*").alias("blocks"))


def spatial_locality(trace: DataFrame, key: str, keys_in_block: Column, exists: Column) -> DataFrame:
    """Per block: share of its keys that were referenced, and of accesses that met existing keys, in tenths."""
    b = trace.groupBy("block").agg(F.countDistinct(F.when(exists, F.col(key))).alias("keys"), F.sum(exists.cast("long")).alias("met"), F.count("*").alias("n"), F.max(keys_in_block).alias("of"))
    tenth = lambda n, d: F.least(F.floor(10 * n / d), F.lit(9)).cast("long")
    return b.groupBy(tenth(F.col("keys"), F.col("of")).alias("referenced"), tenth(F.col("met"), F.col("n")).alias("existing")).agg(F.count("*").alias("blocks"))


def correlation_features(trace: DataFrame, label: str) -> DataFrame:
    """Per access: accesses before it, seconds since the previous and until the next access, of its block under its label."""
    w = Window.partitionBy(label, "block").orderBy("seq")
    return trace.select("seq", label, "block", (F.row_number().over(w) - 1).cast("long").alias("past"), (F.col("sec") - F.lag("sec").over(w)).alias("since"), (F.lead("sec").over(w) - F.col("sec")).alias("until"))


def block_sizes(trace: DataFrame) -> DataFrame:
    """Blocks and bytes by type, and in all."""
    b = block_stats(trace).groupBy("bt", "block").agg(F.max("size").alias("size"))
    return b.rollup("bt").agg(F.count("*").alias("blocks"), F.sum("size").alias("bytes"), F.min("size").alias("least"), F.max("size").alias("most"))


def end_shares(trace: DataFrame, k: int) -> DataFrame:
    """Per type, the share of accesses that its k most and k least accessed blocks have."""
    b = block_stats(trace).groupBy("bt", "block").agg(F.sum("n").alias("n"))
    up, down = Window.partitionBy("bt").orderBy(F.col("n").desc(), "block"), Window.partitionBy("bt").orderBy("n", "block")
    all_n = b.groupBy("bt").agg(F.sum("n").alias("all"))
    high = b.withColumn("r", F.row_number().over(up)).where(F.col("r") <= k).groupBy("bt").agg(F.sum("n").alias("high"))
    low = b.withColumn("r", F.row_number().over(down)).where(F.col("r") <= k).groupBy("bt").agg(F.sum("n").alias("low"))
    return all_n.join(high, "bt").join(low, "bt").select("bt", percent(F.col("high"), F.col("all")).alias("high_share"), percent(F.col("low"), F.col("all")).alias("low_share"))


def rollup_summary(trace: DataFrame) -> DataFrame:
    return trace.rollup("level", "bt", "caller").agg(F.count("*").alias("n"), _misses().alias("misses"))
