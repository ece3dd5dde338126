"""Input shapes built from plain tables: version logs, traces, metric series.

A version log has one row per write: key, seq (unique, ascending in time), op (PUT, DELETE,
SINGLE_DELETE, MERGE), value, ts. Range deletes are a table of their own: begin, end, seq.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(events: DataFrame) -> DataFrame:
    """Views and sign-ups put, clicks and purchases merge, errors delete; values are whole cents."""
    op = F.when(F.col("event_type") == "error", "DELETE").when(F.col("event_type").isin("view", "signup"), "PUT").otherwise("MERGE")
    return events.select(
        F.col("user_id").alias("key"), F.col("event_id").alias("seq"), op.alias("op"),
        F.round(F.col("value") * 100).cast("long").alias("value"), "ts",
    )


def event_tombstones(events: DataFrame) -> DataFrame:
    """Every fiftieth error deletes ten keys from its user on."""
    e = events.where((F.col("event_type") == "error") & (F.col("event_id") % 50 == 0))
    return e.select(F.col("user_id").alias("begin"), (F.col("user_id") + 10).alias("end"), F.col("event_id").alias("seq"))


def operation_trace(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_type").alias("type"), (F.col("user_id") % 4).alias("cf"), F.col("user_id").alias("key"), F.length("props").cast("long").alias("size"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("seq"),
    )


#: The total order of the block trace.
BLOCK_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def block_trace(lineitem: DataFrame) -> DataFrame:
    """Block accesses without a sequence number; see positions() for one."""
    return lineitem.select(
        F.col("l_partkey").alias("block"), F.col("l_suppkey").alias("sst"), F.col("l_linenumber").cast("long").alias("level"), F.col("l_returnflag").alias("bt"), F.col("l_linestatus").alias("caller"),
        F.col("l_quantity").cast("long").alias("size"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("sec"), (F.col("l_discount") < 0.05).alias("hit"), *BLOCK_ORDER,
    )


def metric_series(events: DataFrame) -> DataFrame:
    """entity, stat, ts (day), value: daily sums of whole cents."""
    cents = F.round(F.col("value") * 100).cast("long")
    return events.groupBy((F.col("user_id") % 8).alias("entity"), F.col("event_type").alias("stat"), F.to_date("ts").alias("day")).agg(F.sum(cents).alias("value"))


def file_stats(part: DataFrame) -> DataFrame:
    """One file per brand: its key range, rows and bytes."""
    size = F.length("p_name") + F.length("p_type")
    return part.groupBy(F.col("p_brand").alias("file")).agg(F.min("p_partkey").alias("smallest"), F.max("p_partkey").alias("largest"), F.count("*").alias("n"), F.sum(size).cast("long").alias("bytes"))
