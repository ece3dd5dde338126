"""Prefix sums and positions over a global order without a one-partition window.

Rows are dealt to ranges of the whole order by Spark's range partitioner, which weighs its bounds
by a sample of rows and splits ties of one column by the next. The dealt table is written to the
shared folder, so a row's range is the same wherever it is read. Each range is summed by itself and
the totals of the ranges before are added. The number of ranges follows the input's size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut

#: Input bytes that one range stands for; small inputs still use the session's tasks from LEAST_BYTES each.
RANGE_BYTES, LEAST_BYTES = 64 << 20, 1 << 20


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that df reads (joins don't multiply them); sources that don't know theirs count nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def range_count(df: DataFrame) -> int:
    size = input_bytes(df)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(tasks, -(-size // LEAST_BYTES)), -(-size // RANGE_BYTES))


def ranged(df: DataFrame, order: Sequence[str], group: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """df with _range: ranges are in the order (leading column descending if asked), group by group."""
    first = F.col(order[0]).desc() if descending else F.col(order[0]).asc()
    return cut(df.repartitionByRange(range_count(df), *group, first, *order[1:]).withColumn("_range", F.spark_partition_id()))


def prefix_sums(df: DataFrame, order: Sequence[str], sums: dict[str, Column], group: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Add, per group, the sums of each expression over this row and all before it in the order.

    The leading column orders descending if asked; the others ascending. Rows must be told
    apart by order."""
    keyed = ranged(df.withColumns({f"_add_{k}": v for k, v in sums.items()}), order, group, descending)
    first = F.col(order[0]).desc() if descending else F.col(order[0]).asc()
    w = Window.partitionBy(*group, "_range").orderBy(first, *order[1:]).rowsBetween(Window.unboundedPreceding, 0)
    own = keyed.withColumns({f"_own_{k}": F.sum(f"_add_{k}").over(w) for k in sums})
    totals = keyed.groupBy(*group, "_range").agg(*(F.sum(f"_add_{k}").alias(f"_add_{k}") for k in sums))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = totals.select(*(F.col(g).alias(f"_g_{g}") for g in group), F.col("_range").alias("_r"), *(F.coalesce(F.sum(f"_add_{k}").over(before), F.lit(0)).alias(f"_off_{k}") for k in sums))
    match = F.col("_range") == F.col("_r")
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return own.join(offsets, match).select(*df.columns, *((F.col(f"_own_{k}") + F.col(f"_off_{k}")).alias(k) for k in sums))


def positions(df: DataFrame, order: Sequence[str], name: str = "seq", group: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Add the position from 1 on of each row in the order, per group."""
    return prefix_sums(df, order, {name: F.lit(1).cast("long")}, group, descending)


def running(df: DataFrame, order: Sequence[str], value: Column, name: str, latest: bool, group: Sequence[str] = (), inclusive: bool = True) -> DataFrame:
    """Add, per group, the last non-null (or the greatest) value of the rows up to this one, or before it, in the order."""
    keyed = ranged(df.withColumn("_v", value), order, group)
    over = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    take = (lambda c, w: F.last(c, ignorenulls=True).over(w)) if latest else (lambda c, w: F.max(c).over(w))
    whole = F.struct(*order)
    tops = keyed.where("_v IS NOT NULL").groupBy(*group, "_range").agg((F.max_by("_v", whole) if latest else F.max("_v")).alias("_top"))
    every = keyed.select(*group, "_range").distinct().join(tops, [*group, "_range"], "left")  # a row per range and group
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(*group, "_range", take("_top", before).alias("_carried"))
    own = keyed.withColumn("_own", take("_v", over)).join(carried, [*group, "_range"])
    found = F.coalesce("_own", "_carried") if latest else F.greatest("_own", "_carried")
    return own.select(*df.columns, found.alias(name))
