"""Bulk files, dumps, batches, backups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_sorted(rows: DataFrame, path: str, key: str = "key", files: int | None = None, codec: str = "snappy") -> None:
    """Files of disjoint, ascending key ranges, sorted within, so that readers skip files and row groups by key."""
    dealt = rows.repartitionByRange(files, key) if files else rows.repartitionByRange(key)
    dealt.sortWithinPartitions(key).write.option("compression", codec).parquet(path)


def read_sorted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def file_properties(spark: SparkSession, path: str, key: str = "key") -> DataFrame:
    """Per file: rows, least and greatest key, a fingerprint of its rows."""
    rows = spark.read.parquet(path)
    names = rows.columns
    return rows.select("*", F.col("_metadata.file_name").alias("file")).groupBy("file").agg(F.count("*").alias("entries"), F.min(key).alias("smallest"), F.max(key).alias("largest"), F.bit_xor(F.xxhash64(*names)).alias("fingerprint"))


def ingest(log: DataFrame, external: DataFrame, behind: bool) -> DataFrame:
    """Add external (key, value) puts to a log: ahead they get one seq above all and win, behind they get -1 and lose."""
    if behind:
        rows = external.select("key", F.lit(-1).cast("long").alias("seq"), F.lit("PUT").alias("op"), "value")
    else:
        top = log.agg((F.coalesce(F.max("seq"), F.lit(-1)) + 1).alias("seq"))
        rows = external.join(F.broadcast(top)).select("key", "seq", F.lit("PUT").alias("op"), "value")  # one row
    return log.select("key", "seq", "op", "value").unionByName(rows)


def rolled_back(ops: DataFrame, savepoints: DataFrame) -> DataFrame:
    """Operations of batches cut back to their save point (null: none)."""
    return ops.join(savepoints, "batch", "left").where("savepoint IS NULL OR pos < savepoint").drop("savepoint")


def iterate_batches(batches: DataFrame, first_seq: Column) -> DataFrame:
    """One row per operation of batch(ops array<struct<pos,...>>), with its sequence number."""
    return batches.select("batch", first_seq.alias("_first"), F.explode("ops").alias("o")).select((F.col("_first") + F.col("o.pos")).alias("seq"), "batch", "o.*")


def dump_lines(rows: DataFrame) -> DataFrame:
    """One line per row: key ==> value."""
    return rows.select(F.concat(F.col("key").cast("string"), F.lit(" ==> "), F.col("value").cast("string")).alias("line"))


def load_lines(lines: DataFrame) -> DataFrame:
    parts = F.split("line", " ==> ", 2)
    return lines.where(F.col("line").contains(" ==> ")).select(F.get(parts, 0).alias("key"), F.get(parts, 1).alias("value"))


def backup(rows: DataFrame, root: str, backup_id: int) -> None:
    """A full copy under root/backup_id=N."""
    rows.write.parquet(f"{root}/backup_id={backup_id}")


def restore(spark: SparkSession, root: str, backup_id: int) -> DataFrame:
    return spark.read.parquet(f"{root}/backup_id={backup_id}")


def backups(spark: SparkSession, root: str) -> DataFrame:
    """backup_id, rows, fingerprint of every copy."""
    rows = spark.read.option("basePath", root).parquet(f"{root}/backup_id=*")
    names = [c for c in rows.columns if c != "backup_id"]
    return rows.groupBy("backup_id").agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*names)).alias("fingerprint"))


def keep_last(manifest: DataFrame, n: int) -> DataFrame:
    """The n newest entries of a manifest; a limit over a sort keeps n rows per task."""
    return manifest.orderBy(F.col("id").desc()).limit(n)


def follow(spark: SparkSession, path: str, schema, since: int) -> DataFrame:
    """A stream of the log's rows from a sequence number on."""
    return spark.readStream.schema(schema).parquet(path).where(F.col("seq") >= since)


def write_table(rows: DataFrame, path: str, kind: str = "parquet", codec: str = "snappy") -> None:
    """One table in a file format: parquet, orc, json or csv (with a header)."""
    writer = rows.write.format(kind).option("compression", codec)
    (writer.option("header", True) if kind == "csv" else writer).save(path)


def read_table(spark: SparkSession, path: str, kind: str, schema) -> DataFrame:
    reader = spark.read.format(kind).schema(schema)
    return (reader.option("header", True) if kind == "csv" else reader).load(path)


def export_files(rows: DataFrame, path: str, key: str = "key", files: int = 4) -> None:
    """Sorted files under path/data and, under path/manifest, their properties and sums."""
    write_sorted(rows, f"{path}/data", key, files)
    file_properties(rows.sparkSession, f"{path}/data", key).write.parquet(f"{path}/manifest")


def verify_files(spark: SparkSession, path: str, key: str = "key") -> DataFrame:
    """file, status of the manifest's files: OK, Corruption (rows or sums differ from the stored ones) or NotFound."""
    then = spark.read.parquet(f"{path}/manifest")
    now = file_properties(spark, f"{path}/data", key).select("file", F.col("entries").alias("_n"), F.col("fingerprint").alias("_sum"))
    met = then.join(now, "file", "left")
    same = (F.col("entries") == F.col("_n")) & (F.col("fingerprint") == F.col("_sum"))
    return met.select("file", F.when(F.col("_n").isNull(), "NotFound").when(same, "OK").otherwise("Corruption").alias("status"))


def import_files(spark: SparkSession, path: str, key: str = "key") -> DataFrame:
    """The rows of an exported table; an error if a file is not as its manifest says."""
    if bad := verify_files(spark, path, key).where("status <> 'OK'").limit(5).collect():
        raise ValueError(f"Corruption: {', '.join(f'{r.file} {r.status}' for r in bad)}")
    return spark.read.parquet(f"{path}/data")


def read_pruned(spark: SparkSession, path: str, wanted: Column) -> tuple[DataFrame, int, int]:
    """The rows of those files of an exported table whose manifest properties pass, how many files that are, and of how many."""
    manifest = spark.read.parquet(f"{path}/manifest")
    names = [r.file for r in manifest.where(wanted).select("file").collect()]  # a row per file
    schema = spark.read.parquet(f"{path}/data").schema
    rows = spark.read.schema(schema).parquet(*(f"{path}/data/{n}" for n in names)) if names else spark.createDataFrame([], schema)
    return rows, len(names), manifest.count()


def purge(spark: SparkSession, root: str, keep: int) -> list[int]:
    """Delete all backups but the `keep` newest; the ids that are left."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    ids = sorted(int(x.getPath().getName().split("=")[1]) for x in system.listStatus(folder) if x.getPath().getName().startswith("backup_id="))
    for i in ids[:-keep] if keep else ids:
        system.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/backup_id={i}"), True)
    return ids[-keep:] if keep else []


def newest_marks(log: DataFrame) -> DataFrame:
    """key, seq of the newest version, for a follower to compare."""
    return log.groupBy("key").agg(F.max("seq").alias("seq"))
