"""Streams over a growing log directory, run to the end of what is there.

availableNow makes a stream process all files present and stop, so its result must equal
the batch answer. The state of a stream is keyed and lives in the state store, and its
checkpoint in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import new_path
from ..sources.shapes import event_log


def source(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream of a Parquet file or directory of events."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(_directory(path))


def _directory(path: str) -> str:
    """The file source wants a directory or a glob; a glob of one name serves a single file, too."""
    head, _, name = path.rpartition("/")
    return f"{head}/{name[:-1]}[{name[-1]}]"


def run(stream: DataFrame, mode: str, after: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream to its end into the shared folder; complete and update results are written per batch and read back."""
    spark = stream.sparkSession
    out = new_path(spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/rows/_b={batch_id}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
    writer.foreachBatch(write).start().awaitTermination()
    rows = spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows").drop("_b")
    return (after(rows) if after else rows).drop("_batch")


def windowed_counts(spark: SparkSession, path: str) -> DataFrame:
    """Events by day and type: a watermarked tumbling window."""
    events = source(spark, path).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 day")
    counted = events.groupBy(F.window("at", "1 day"), "event_type").agg(F.count("*").alias("n"))
    shaped = counted.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")
    newest = lambda r: r.groupBy("day", "event_type").agg(F.max_by("n", "_batch").alias("n"))
    return run(shaped, "update", lambda r: newest(r).withColumn("_batch", F.lit(0)))


def latest_versions(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of every key, deletes included: a stateful aggregate."""
    log = event_log(source(spark, path))
    g = log.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by(F.struct("op", "value"), "seq").alias("v")).select("key", "seq", "v.op", "v.value")
    newest = lambda r: r.groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("v")).select("key", "v.*").withColumn("_batch", F.lit(0))
    return run(g, "update", newest)


def tail(spark: SparkSession, path: str, since: int) -> DataFrame:
    """Writes from a sequence number on, as they come."""
    return run(event_log(source(spark, path)).where(F.col("seq") >= since).select("key", "seq", "op", "value"), "append")
