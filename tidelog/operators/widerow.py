"""Wide rows: cells (row_id, col, ts, value) with row tombstones and expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(cells: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The newest cell of each column, if the row was not deleted at or after it (tombstones: row_id, dead)."""
    newest = cells.groupBy("row_id", "col").agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))
    return newest.join(tombstones, "row_id", "left").where("dead IS NULL OR dead < ts").select("row_id", "col", "ts", "value")


def expire(cells: DataFrame, now: int, grace: int) -> DataFrame:
    """Cells past ts + ttl become tombstones, and go `grace` later."""
    over = F.col("ts") + F.col("ttl")
    kept = cells.where(over + grace >= now)
    return kept.select("row_id", "col", "ts", F.when(over < now, "tombstone").otherwise("live").alias("kind"), F.when(over >= now, F.col("value")).alias("value"))
