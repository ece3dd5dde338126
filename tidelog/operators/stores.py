"""Time-to-live blobs, value-log segments and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mvcc import newest
from .ordering import prefix_sums


def ttl_buckets(blobs: DataFrame, seconds: int) -> DataFrame:
    """Blobs (expires, size) gathered by expiry range: bucket, blobs, bytes."""
    return blobs.groupBy(F.floor(F.col("expires") / seconds).alias("bucket")).agg(F.count("*").alias("blobs"), F.sum("size").alias("bytes"))


def evicted(buckets: DataFrame, most_bytes: int) -> DataFrame:
    """Buckets that go, earliest expiry first, until the rest fits."""
    run = prefix_sums(buckets.select("bucket", "bytes"), ["bucket"], {"_r": F.col("bytes")}, descending=True)
    return run.where(F.col("_r") > most_bytes).select("bucket", "bytes")


def segment_liveness(log: DataFrame, records: int) -> DataFrame:
    """Per segment of so many records: how many are still the newest of a live key."""
    live = newest(log).where("op <> 'DELETE'").select("key", "seq", F.lit(1).alias("_live"))
    g = log.join(live, ["key", "seq"], "left").groupBy(F.floor(F.col("seq") / records).alias("segment")).agg(F.count("*").alias("records"), F.count("_live").alias("live"))
    return g.withColumn("live_share", F.col("live") / F.col("records"))


def retention(events: DataFrame, days: int) -> DataFrame:
    """Per id: rows, first row and how many are past retention."""
    top = events.agg(F.max("ts").alias("_top"))
    old = F.col("ts") < F.col("_top") - F.expr(f"INTERVAL {int(days)} DAY")
    return events.join(F.broadcast(top)).groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_seq"), F.sum(old.cast("long")).alias("expired"))  # one row
