"""Access heat of keys and of key groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import heat
from .ordering import prefix_sums


def heat_by_key(log: DataFrame, unit: float) -> DataFrame:
    """key, heat: the sum over accesses of a weight that halves every 32 units of seq, zero beyond 512."""
    top = log.agg(F.max("seq").alias("_top"))
    aged = log.join(F.broadcast(top)).select("key", ((F.col("seq") - F.col("_top")) / F.lit(unit)).alias("age"))  # one row
    return aged.groupBy("key").agg(F.round(F.sum(heat(F.col("age"))), 6).alias("heat"))


def groups(log: DataFrame, size: int) -> DataFrame:
    """grp, first_key, last_key, keys, n: neighbouring keys grouped so that a group starts in every `size` accesses of the key order."""
    per_key = log.groupBy("key").agg(F.count("*").alias("n"))
    placed = prefix_sums(per_key, ["key"], {"upto": F.col("n")})
    return placed.groupBy(F.floor((F.col("upto") - F.col("n")) / size).alias("grp")).agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("keys"), F.sum("n").alias("n"))


def coldest(grouped: DataFrame, k: int) -> DataFrame:
    """The k groups with the fewest accesses per key."""
    return grouped.orderBy(F.col("n") / F.col("keys"), "grp").limit(k)
