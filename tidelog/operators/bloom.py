"""Bloom filters of keys or key prefixes, per file.

A filter is a table (file, word, bits): 64 bits a row, so that building is one aggregation with
partial bit-or, however many keys a file has, and a probe joins its words only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _places(key: Column, bits: int, probes: int) -> Column:
    """The bit positions of a key, by double hashing."""
    a, b = F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2))
    return F.array(*(F.pmod(F.try_add(a, F.lit(i) * F.pmod(b, F.lit(1 << 31))), F.lit(bits)) for i in range(probes)))


def build(rows: DataFrame, key: Column, bits: int, probes: int, file: str = "file") -> DataFrame:
    """file, word, bits of the filters of `bits` bits with `probes` positions a key."""
    at = rows.select(file, F.explode(_places(key, bits, probes)).alias("_at"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_at") % 64).cast("int"))
    return at.groupBy(file, F.floor(F.col("_at") / 64).alias("word")).agg(F.bit_or(one).alias("bits"))


def may_match(filters: DataFrame, probes: DataFrame, key: Column, bits: int, count: int, file: str = "file") -> DataFrame:
    """Each row of probes (told apart by its columns) with each file that may hold its key: no file that holds it is missing."""
    asked = probes.withColumn("_at", F.explode(F.array_distinct(_places(key, bits, count)))).withColumns({"word": F.floor(F.col("_at") / 64), "_of": F.size(F.array_distinct(_places(key, bits, count)))})
    met = asked.join(filters, "word").where(F.call_function("shiftright", F.col("bits"), (F.col("_at") % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
    return met.groupBy(*probes.columns, file, "_of").agg(F.count("*").alias("_hit")).where("_hit = _of").select(*probes.columns, file)
