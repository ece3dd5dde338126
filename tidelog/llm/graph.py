"""Connected components of a link table, by alternating large-star and small-star steps.

First each task hangs the nodes of its own links, a bounded number at a time, on the smallest node
that these links lead to; that needs no exchange and leaves less than a link per node. Then each step hangs neighbours on the smallest node known. A node's minimum is taken, and met with its
links, in cells of (node, hash of the neighbour), so a hub's links are dealt to SALTS tasks. The link
table is rewritten to the shared folder each round and its number of rounds grows with the
logarithm of the longest chain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .store import cut

MAX_ROUNDS = 60
#: Cells that one node's links are dealt to.
SALTS = 64
#: Links that a task contracts at a time.
CONTRACTED = 1 << 20


def spread_join(big: DataFrame, small: DataFrame, on: str, by: Column) -> DataFrame:
    """big joined with small, which has a row per key: a hot key's rows of big are dealt to SALTS cells by the hash of `by`."""
    dealt = big.withColumn("_s", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    return dealt.join(small.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [on, "_s"]).drop("_s")


def _with_least(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links with m, the least v of their u; and (u, m) itself. The minimum is aggregated before the shuffle, with the cells (SALTS at most) that it then goes to."""
    dealt = links.select("u", "v", F.pmod(F.xxhash64("v"), F.lit(SALTS)).alias("s"))
    least = dealt.groupBy("u").agg(F.min("v").alias("m"), F.collect_set("s").alias("cells"))
    return dealt.join(least.select("u", F.explode("cells").alias("s"), "m"), ["u", "s"]).select("u", "v", "m"), least.select("u", "m")


def _large(links: DataFrame) -> DataFrame:
    """Hang each node's larger neighbours on its smallest neighbour (itself included)."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both)[0].where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small(links: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours on the smallest of them (links go from larger to smaller)."""
    met, least = _with_least(links)
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) that connect what the links (u, v) connect."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low < high
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal size
        found = contract(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(2)))
        held.clear()
        size = 0
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= CONTRACTED:
            yield flush()
    if held:
        yield flush()


def _settled(links: DataFrame) -> bool:
    """Whether every node hangs on one node only, and that on none."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(links.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs + holds > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component), for the nodes of links(u, v) (long, not null) other than the roots themselves.

    Self links and repeated links do no harm; without links the result is empty."""
    now = cut(links.select("u", "v").mapInArrow(kernel.freeing(_contracted), "u bigint, v bigint").distinct())
    for _ in range(MAX_ROUNDS):
        if _settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now = cut(_small(_large(now)))
    raise RuntimeError("components did not converge")
