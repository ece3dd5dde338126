"""Tables in the folder that all executors share, to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the context's checkpoint folder; where
    neither is set and the master is local, a folder under /tmp/checkpoints."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        before = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = before.get() if before.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "/tmp/checkpoints"
    return found.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A path in the application's own folder there. The file system deletes that folder when the
    driver's JVM ends, whether the session has been stopped before or not."""
    root = f"{shared_dir(spark)}/tidelog-{spark.sparkContext.applicationId}"
    context = spark.sparkContext
    if getattr(context, "_tidelog_scratch", None) != root:
        folder = context._jvm.org.apache.hadoop.fs.Path(root)
        system = folder.getFileSystem(context._jsc.hadoopConfiguration())
        system.mkdirs(folder)  # only what is there can be marked
        system.deleteOnExit(folder)
        context._tidelog_scratch = root
    return f"{root}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: later stages recompute nothing and
    survive lost executors."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
