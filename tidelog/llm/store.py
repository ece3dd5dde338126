"""Stable row keys, bounded Arrow batches and exchange sizes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..sources.code import ship
from ..sources.scratch import cut

__all__ = ["bound_batches", "cut", "exchange_parts", "schema_of", "unpacked", "with_row_key"]

#: Rows in one Arrow batch handed to a Python worker; bounds worker memory.
ARROW_ROWS = 1000


def with_row_key(docs: DataFrame) -> DataFrame:
    """_doc (a struct of all columns of docs, whatever their names), _file and _row (bigint), which
    together name one physical row and stay the same in every scan, so that repeated rows
    and repeated ids remain distinct. A frame that is no file scan is written to the shared folder first."""
    packed = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc")

    def keyed(df: DataFrame) -> DataFrame:
        at = df.metadataColumn("_metadata")
        return df.select(packed, F.xxhash64(at["file_path"]).alias("_file"), at["row_index"].alias("_row"))

    try:
        return keyed(docs)
    except AnalysisException:
        return keyed(cut(docs))


def schema_of(fields: list[StructField], ddl: str) -> StructType:
    """Carried fields, by whatever names, and those that are made."""
    return StructType([*(StructField(f.name, f.dataType) for f in fields), *StructType.fromDDL(ddl).fields])


def unpacked(names: list[str], packed: str = "_doc") -> list:
    """The columns that with_row_key packed."""
    return [F.col(packed).getField(c).alias(c) for c in names]


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts; the workers get this package."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


#: Input bytes that one exchange partition stands for, and the most partitions.
PART_BYTES, MAX_PARTS = 64 << 20, 50_000


def exchange_parts(df: DataFrame, values: int = 0, per_part: int = 2_000_000) -> int:
    """Partitions for an exchange of what is derived from df: Spark's own number, and more where the input's size or so many fixed-width values ask for it."""
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(max(least, -(-values // per_part), -(-min(size, 1 << 60) // PART_BYTES)), max(least, MAX_PARTS))
