"""Interval computations: range tombstones, fragments, overlaps.

A range of n keys stands in the cells of width 2^k >= n that it meets, two at most, so no range is
dealt to many cells however wide it is. A point looks into one cell of each width in use, 63 at most.
Cells of wide ranges hold many points; those points are dealt to SALTS tasks and their few ranges
copied to each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import positions

#: Copies of ranges whose width is at least 2^WIDE times the narrowest in use.
SALTS, WIDE = 32, 6


def _level(n: Column) -> Column:
    """The least k with 2^k >= n, of whole numbers."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin((n - 1).cast("long")))).cast("int")


def levels_of(*sides: DataFrame) -> list[int]:
    """The distinct levels, in order: 64 at most are collected."""
    found: set[int] = set()
    for side in sides:
        found |= {r[0] for r in side.distinct().collect()}
    return sorted(found)


def _salts(level: Column, levels: list[int]) -> Column:
    return F.when(level >= levels[0] + WIDE, SALTS).otherwise(1)


def range_join(points: DataFrame, ranges: DataFrame, point: str, begin: str = "begin", end: str = "end", how: str = "inner", extra: Column | None = None) -> DataFrame:
    """points joined with the ranges [begin, end) that hold them, where `extra` holds, too (whole-number columns); how is inner or left_semi."""
    real = ranges.where(F.col(begin) < F.col(end)).withColumn("_level", _level(F.col(end) - F.col(begin)))
    levels = levels_of(real.select("_level"))
    if not levels:
        return points.join(ranges.where("false"), F.lit(False), how)
    cells = F.array_distinct(F.array(shift(F.col(begin), "_level"), shift(F.col(end) - 1, "_level")))
    binned = real.withColumn("_cell", F.explode(cells)).withColumn("_salt", F.explode(F.sequence(F.lit(0), _salts(F.col("_level"), levels) - 1)))
    asked = points.withColumn("_plevel", F.explode(F.array(*map(F.lit, levels))))
    asked = asked.withColumns({"_pcell": shift(F.col(point), "_plevel"), "_psalt": F.pmod(F.xxhash64(*points.columns), _salts(F.col("_plevel"), levels)).cast("int")})
    on = (F.col("_plevel") == F.col("_level")) & (F.col("_pcell") == F.col("_cell")) & (F.col("_psalt") == F.col("_salt")) & (F.col(point) >= F.col(begin)) & (F.col(point) < F.col(end))
    met = asked.join(binned, on if extra is None else on & extra, how).drop("_plevel", "_pcell", "_psalt", "_level", "_cell", "_salt")
    return met.distinct() if how == "left_semi" else met  # a point may meet ranges of several levels


def shift(x: Column, level: str) -> Column:
    """The cell of width 2^level that a whole number lies in."""
    return F.call_function("shiftright", x.cast("long"), F.col(level))


def buried(log: DataFrame, tombstones: DataFrame) -> DataFrame:
    """key, seq of the versions that a newer range tombstone covers."""
    t = tombstones.select(F.col("begin").alias("_begin"), F.col("end").alias("_end"), F.col("seq").alias("_seq"))
    return range_join(log.select("key", "seq"), t, "key", "_begin", "_end", "left_semi", F.col("_seq") > F.col("seq"))


def fragments(tombstones: DataFrame) -> DataFrame:
    """begin, end, seqs (descending): disjoint fragments of overlapping tombstones."""
    t = tombstones.where("begin < end")
    points = t.select(F.col("begin").alias("p")).union(t.select(F.col("end").alias("p"))).distinct()
    placed = positions(points, ["p"], "k")
    after = placed.select(F.col("p").alias("end"), (F.col("k") - 1).alias("k"))
    pieces = placed.select(F.col("p").alias("begin"), "k").join(after, "k").select("begin", "end")
    cover = t.select(F.col("begin").alias("_b"), F.col("end").alias("_e"), "seq")
    joined = range_join(pieces, cover, "begin", "_b", "_e")
    return joined.groupBy("begin", "end").agg(F.sort_array(F.collect_set("seq"), asc=False).alias("seqs"))


def overlapping(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """Every range with the files whose [smallest, largest] meets its [begin, end).

    Of two that meet, the narrower one stands in two cells of the wider one's width at most; each side looks up the other's wider widths."""
    f = files.withColumn("_level", _level(F.col("largest") - F.col("smallest") + 1))
    r = ranges.where("begin < end").withColumn("_level", _level(F.col("end") - F.col("begin")))
    levels = levels_of(f.select("_level"), r.select("_level"))
    if not levels:
        return ranges.join(files, F.lit(False))

    def own(df: DataFrame, low: Column, high: Column) -> DataFrame:
        return df.withColumn("_cell", F.explode(F.array_distinct(F.array(shift(low, "_level"), shift(high, "_level")))))

    def wider(df: DataFrame, low: Column, high: Column, also: bool) -> DataFrame:
        up = df.withColumn("_up", F.explode(F.array(*map(F.lit, levels)))).where(F.col("_up") >= F.col("_level") if also else F.col("_up") > F.col("_level"))
        return up.drop("_level").withColumnRenamed("_up", "_level").withColumn("_cell", F.explode(F.array_distinct(F.array(shift(low, "_level"), shift(high, "_level")))))

    fs, rs = (F.col("smallest"), F.col("largest")), (F.col("begin"), F.col("end") - 1)
    near = (F.col("smallest") < F.col("end")) & (F.col("largest") >= F.col("begin"))
    met = [wider(r, *rs, True).join(own(f, *fs), ["_level", "_cell"]), own(r, *rs).join(wider(f, *fs, False), ["_level", "_cell"])]
    return met[0].unionByName(met[1]).where(near).drop("_level", "_cell").distinct()
