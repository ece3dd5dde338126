"""Generated workloads: key distributions and operation mixes, all from spark.range."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .mvcc import latest

#: The exponent of the zipfian distribution.
THETA = 0.99


def uniform01(seed: int) -> Column:
    """A number in [0, 1) from the row's id; the same on every run."""
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 53)).cast("double") / float(1 << 53)


def _zeta(n: int, theta: float) -> float:
    """sum of i^-theta; beyond 10000 by the Euler-Maclaurin tail."""
    m = min(n, 10_000)
    head = math.fsum(i**-theta for i in range(1, m + 1))
    if n == m:
        return head
    return head + (n ** (1 - theta) - m ** (1 - theta)) / (1 - theta) + (n**-theta - m**-theta) / 2


def zipfian_rank(u: Column, keys: int, theta: float = THETA) -> Column:
    """Rank 0..keys-1 of a zipfian draw, by the closed-form inverse."""
    zeta, zeta2 = _zeta(keys, theta), _zeta(2, theta)
    alpha, eta = 1 / (1 - theta), (1 - (2 / keys) ** (1 - theta)) / (1 - zeta2 / zeta)
    uz = u * zeta
    rest = F.floor(keys * F.pow(eta * u - eta + 1, F.lit(alpha)))
    return F.when(uz < 1, 0).when(uz < 1 + 0.5**theta, 1).otherwise(F.least(rest, F.lit(keys - 1))).cast("long")


def zipfian(spark: SparkSession, n: int, keys: int, seed: int = 1) -> DataFrame:
    return spark.range(n).select("id", zipfian_rank(uniform01(seed), keys).alias("key"))


def scrambled(spark: SparkSession, n: int, keys: int, seed: int = 1) -> DataFrame:
    """Zipfian popularity spread over the key space by hash."""
    return spark.range(n).select("id", F.pmod(F.xxhash64(zipfian_rank(uniform01(seed), keys)), F.lit(keys)).alias("key"))


def skewed_latest(spark: SparkSession, n: int, keys: int, seed: int = 1) -> DataFrame:
    """The newest keys are the most popular."""
    return spark.range(n).select("id", (F.lit(keys - 1) - zipfian_rank(uniform01(seed), keys)).alias("key"))


def uniform(spark: SparkSession, n: int, keys: int, seed: int = 1) -> DataFrame:
    return spark.range(n).select("id", F.floor(uniform01(seed) * keys).alias("key"))


DISTRIBUTIONS = {"zipfian": scrambled, "latest": skewed_latest, "uniform": uniform}


def operations(spark: SparkSession, n: int, keys: int, mix: dict[str, float], distribution: str, seed: int = 7) -> DataFrame:
    """id, op, key: operations drawn by proportion, keys by distribution."""
    drawn = DISTRIBUTIONS[distribution](spark, n, keys, seed)
    u = uniform01(seed + 1)
    bounds, total = [], 0.0
    for name, share in mix.items():
        total += share
        bounds.append((name, total))
    op = F.lit(bounds[-1][0])
    for name, bound in reversed(bounds[:-1]):
        op = F.when(u < bound, name).otherwise(op)
    return drawn.select("id", op.alias("op"), "key")


def reads(ops: DataFrame, log: DataFrame) -> DataFrame:
    """Every read with the value it finds (null if none)."""
    return ops.join(latest(log).select("key", "value"), "key", "left").select("op_id", "key", "value")


def read_modify_write(ops: DataFrame, log: DataFrame) -> DataFrame:
    """Values after each operation added one to its key's."""
    n = ops.groupBy("key").agg(F.count("*").alias("_n"))
    return latest(log).select("key", "value").join(n, "key", "full_outer").select("key", (F.coalesce("value", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("value"))
