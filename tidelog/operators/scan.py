"""Reads over a resolved key space or a version log: gets, seeks, range and prefix scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mvcc import newest, visible
from .ordering import prefix_sums, running
from .ranges import range_join


def get(current: DataFrame, key) -> DataFrame:
    """The row of one key."""
    return current.where(F.col("key") == key)


def multi_get(current: DataFrame, keys: DataFrame) -> DataFrame:
    """Every key of keys(pos, key) with status OK or NotFound and value, from one snapshot."""
    found = keys.join(current.select("key", "value", F.lit(True).alias("_found")), "key", "left")
    return found.select("pos", "key", F.when(F.col("_found"), "OK").otherwise("NotFound").alias("status"), "value")


def multi_get_capped(current: DataFrame, keys: DataFrame, soft_limit: int, size: Column) -> DataFrame:
    """multi_get whose keys are Aborted once the sizes of the values before add up to over the limit."""
    got = multi_get(current, keys).withColumn("_size", F.coalesce(size, F.lit(0)).cast("long"))
    total = prefix_sums(got, ["pos"], {"_total": F.col("_size")})
    aborted = F.col("_total") - F.col("_size") > soft_limit
    return total.select("pos", "key", F.when(aborted, "Aborted").otherwise(F.col("status")).alias("status"), F.when(~aborted, F.col("value")).alias("value"))


def scan(current: DataFrame, lower=None, upper=None, prefix: str | None = None, limit: int | None = None, reverse: bool = False, keys_only: bool = False) -> DataFrame:
    """Keys of [lower, upper) that start with the prefix, in order; with a limit Spark keeps a top list per task."""
    if lower is not None:
        current = current.where(F.col("key") >= lower)
    if upper is not None:
        current = current.where(F.col("key") < upper)
    if prefix is not None:
        current = current.where(F.col("key").cast("string").startswith(prefix))
    if keys_only:
        current = current.select("key")
    current = current.orderBy(F.col("key").desc() if reverse else F.col("key"))
    return current if limit is None else current.limit(limit)


def seek(current: DataFrame, target, n: int) -> DataFrame:
    """The first n keys at or after the target."""
    return scan(current, lower=target, limit=n)


def seek_for_prev(current: DataFrame, target, n: int = 1) -> DataFrame:
    """The last n keys at or before the target."""
    return scan(current.where(F.col("key") <= target), limit=n, reverse=True)


def seek_for_prev_each(current: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe key the greatest key at or before it (null if none): an as-of join.

    Keys and probes are ordered together in ranges; the greatest key of the ranges before is carried into each."""
    rows = current.select("key", F.lit(0).alias("_kind")).unionByName(probes.select("key", F.lit(1).alias("_kind")))
    met = running(rows, ["key", "_kind"], F.when(F.col("_kind") == 0, F.col("key")), "found", True)
    return met.where("_kind = 1").select("key", "found")


def incremental(log: DataFrame, since) -> DataFrame:
    """The newest version of every key if its seq is `since` or later, deletes included."""
    return newest(log).where(F.col("seq") >= since)


def updates_since(log: DataFrame, since) -> DataFrame:
    """All writes from a sequence number on, in order."""
    return log.where(F.col("seq") >= since).orderBy("seq")


def versions_between(log: DataFrame, ts_from, ts_to, all_versions: bool) -> DataFrame:
    """Versions with ts in [ts_from, ts_to], all or the newest of each key."""
    v = visible(log, None, ts_from, ts_to)
    return v.select("key", "seq", "op", "value") if all_versions else newest(v)


def multi_family(log: DataFrame, family: Column, snapshot) -> DataFrame:
    """The live keys of all column families at one snapshot."""
    v = visible(log.withColumn("cf", family), snapshot)
    return newest(v, ("cf", "key")).where("op <> 'DELETE'").select("cf", "key", "value")


def may_exist(current: DataFrame, keys: DataFrame) -> DataFrame:
    """Whether each key may exist; this answer is exact, which the contract allows."""
    return keys.join(current.select("key", F.lit(True).alias("_e")), "key", "left").select("key", F.coalesce("_e", F.lit(False)).alias("may_exist"))


def approximate_sizes(rows: DataFrame, ranges: DataFrame, size: Column) -> DataFrame:
    """n and bytes of the rows whose key lies in each range(begin, end)."""
    inside = range_join(rows.select("key", size.cast("long").alias("_size")), ranges, "key")
    sums = inside.groupBy("begin", "end").agg(F.count("*").alias("n"), F.sum("_size").alias("bytes"))
    return ranges.join(sums, ["begin", "end"], "left").select("begin", "end", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def may_hold(files: DataFrame, lower, upper) -> DataFrame:
    """Files whose key range meets [lower, upper)."""
    return files.where((F.col("smallest") < upper) & (F.col("largest") >= lower))
