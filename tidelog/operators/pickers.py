"""What level and universal compaction would pick, and how a compaction is split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def level_scores(files: DataFrame, base_bytes: int, multiplier: int, first_files: int) -> DataFrame:
    """level, score: of the first level its files over first_files, of the others bytes over a target that grows by the multiplier."""
    g = files.groupBy("level").agg(F.count("*").alias("_files"), F.sum("bytes").alias("_bytes"))
    target = base_bytes * F.pow(F.lit(float(multiplier)), F.col("level") - 1)
    return g.select("level", F.when(F.col("level") == 0, F.col("_files") / first_files).otherwise(F.col("_bytes") / target).alias("score"))


def level_pick(files: DataFrame, base_bytes: int, multiplier: int, first_files: int) -> DataFrame:
    """level, file: the level of the highest score of 1 or more, and its largest file; nothing if no level is full."""
    best = level_scores(files, base_bytes, multiplier, first_files).where("score >= 1").agg(F.max(F.struct("score", (-F.col("level")).alias("_up"))).alias("_b")).select((-F.col("_b._up")).alias("_level"))
    mine = files.join(F.broadcast(best), F.col("level") == F.col("_level"))  # one row
    return mine.groupBy("level").agg(F.min(F.struct((-F.col("bytes")).alias("_n"), "file")).alias("_f")).select("level", F.col("_f.file").alias("file"))


def universal_pick(runs: DataFrame, ratio: int, least: int) -> DataFrame:
    """run, bytes of the newest runs (run 0 first) that merge: each next one joins while it is no larger than (100 + ratio) % of those before in all; none if fewer than `least`.

    There are as many rows as sorted runs, some dozens, so one window orders them."""
    w = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    v = runs.withColumn("_sum", F.sum("bytes").over(w)).withColumn("_stop", (F.col("_sum").isNotNull() & (F.col("bytes") * 100 > F.col("_sum") * (100 + ratio))).cast("int"))
    v = v.withColumn("_stopped", F.max("_stop").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, 0))).where("_stopped = 0")
    return v.withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(0)))).where(F.col("_n") >= least).select("run", "bytes")


def subcompactions(files: DataFrame, parts: int) -> DataFrame:
    """begin, bytes of at most `parts` ranges of about equal bytes that start at files' least keys (a row per file is ordered)."""
    total = files.agg(F.sum("bytes").alias("_all"))
    w = Window.orderBy("smallest", "file").rowsBetween(Window.unboundedPreceding, -1)
    v = files.withColumn("_before", F.coalesce(F.sum("bytes").over(w), F.lit(0))).join(F.broadcast(total))  # one row
    part = F.floor(F.col("_before") * parts / F.col("_all"))
    return v.groupBy(part.alias("_p")).agg(F.min("smallest").alias("begin"), F.sum("bytes").alias("bytes")).select("begin", "bytes")


def ratio_triggers(rows: DataFrame, ratio: float, file: str = "file") -> DataFrame:
    """file, share of files in which deletes make up that share of entries or more."""
    share = F.avg(F.col("op").isin("DELETE", "SINGLE_DELETE").cast("double"))
    return rows.groupBy(file).agg(share.alias("share")).where(F.col("share") >= ratio)
