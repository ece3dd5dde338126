"""Sharding by vector bin packing.

A group (equal texts) is a vector of bytes, tokens and rows. Each group, largest first, goes
to the shard whose residual capacity has the highest dot product with it. Large groups (a
bounded number) are placed on the driver, those of over SPLIT_SHARE of a shard in pieces.
The others are dealt to buckets by hash, with the rows of large groups, and each bucket
places its own against what its share of capacity has left. Slots are counted per bucket and shard and offset
by the buckets before, so no shard's rows meet in one task.

Defined results: a null text has no bytes (size 8) and belongs to the group of empty texts;
repeated rows are placed each; ties in size go by group hash; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.code import ship
from .store import cut, with_row_key

OVERHEAD = 8  # bytes that a shard file spends on each row
#: Rows of one bucket on average, and the most buckets: buckets times shards rows reach the driver.
BUCKET_ROWS, MAX_BUCKETS = 20_000, 8192
#: A group of over this share of a shard is split into pieces of that size; one of over this share of a bucket's part of a shard is large.
SPLIT_SHARE, LARGE_SHARE = 0.25, 0.25
#: Weights of bytes, tokens and rows in the dot product: sizes are the law, the others follow it.
WEIGHTS = np.array([400.0, 1.0, 1.0])


def place(load: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The shard of each vector, in the given order: highest dot product with the residual of room (a row per shard)."""
    scale = np.maximum(np.abs(room).sum(axis=0), 1e-9)
    residual, unit = WEIGHTS * room / scale, load / scale
    out = np.empty(len(load), np.int32)
    for i, v in enumerate(unit):
        b = int(np.argmax(residual @ v))
        out[i] = b
        residual[b] -= WEIGHTS * v
    return out


def _pack_bucket(shards: int, keys: tuple[str, ...]):
    """Places the groups of a bucket, so that with its rows of large groups, whose shard is given, each shard gets an even part."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["group", "doc_id", "size"], kind="stable", na_position="last")
        pdf["rows"] = 1
        parts = ["size", "tokens", "rows"]
        fixed, small = pdf[pdf["shard"].notna()], pdf[pdf["shard"].isna()]
        room = np.tile(pdf[parts].sum().to_numpy(float) / shards, (shards, 1))
        np.subtract.at(room, fixed["shard"].to_numpy(np.int64), fixed[parts].to_numpy(float))
        if len(small):
            groups = small.groupby("group", sort=True)[parts].sum().reset_index()
            order = np.lexsort((groups["group"], -groups["size"]))
            to = np.empty(len(groups), np.int32)
            to[order] = place(groups[parts].to_numpy(float)[order], room)
            pdf["shard"] = pdf["shard"].fillna(pdf["group"].map(dict(zip(groups["group"], to))))
        pdf["shard"] = pdf["shard"].astype("int32")
        pdf["pos"] = pdf.groupby("shard").cumcount().astype("int64")
        return pdf[["bucket", "doc_id", "size", "text_crc32", "shard", "pos", *keys]]

    return pack


def assign(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text: str = "text", keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard), and keys (whole numbers that tell rows apart)."""
    spark = docs.sparkSession
    ship(spark)
    t = F.coalesce(F.col(text), F.lit(""))
    tokens = F.length(t) - F.length(F.translate(t, " \n", "")) + 1  # white space breaks, plus one
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(t) + OVERHEAD).cast("long").alias("size"), tokens.cast("long").alias("tokens"),
        F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"), F.xxhash64(t).alias("group"), *keys,
    )
    rows = cut(rows.withColumn("group", F.xxhash64("group", "text_crc32", "size")))
    totals = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("double") for c in ("size", "tokens")), F.count("*")).first()
    total, n = np.array(totals, float), totals[2]
    buckets = max(1, min(MAX_BUCKETS, -(-n // BUCKET_ROWS)))
    # Groups of over this many bytes: shards * buckets / LARGE_SHARE of them at most, whatever the table's size.
    large_bytes, piece_bytes = max(1, int(LARGE_SHARE * total[0] / shards / buckets)), max(1, int(SPLIT_SHARE * total[0] / shards))
    large = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")).where(F.col("bytes") > large_bytes).toPandas()
    pieces = np.ceil(large["bytes"].to_numpy(float) / piece_bytes).astype(np.int64)
    each = np.repeat(np.arange(len(large)), pieces)
    load = (large[["bytes", "tokens", "n"]].to_numpy(float) / np.maximum(pieces, 1)[:, None])[each]
    order = np.lexsort((large["group"].to_numpy()[each], -load[:, 0])) if len(load) else np.zeros(0, np.int64)
    room = np.tile(total / shards, (shards, 1))
    to = np.empty(len(load), np.int32)
    to[order] = place(load[order], room)
    starts = np.cumsum(pieces) - pieces
    fixed = spark.createDataFrame([(int(g), [int(x) for x in to[a : a + k]]) for g, a, k in zip(large["group"], starts, pieces)], "group long, homes array<int>")
    dealt = rows.join(F.broadcast(fixed), "group", "left")
    home = F.get("homes", F.pmod(F.xxhash64("doc_id", "group"), F.size("homes")).cast("int"))
    spread = F.when(F.col("homes").isNull(), F.col("group")).otherwise(F.xxhash64("group", "doc_id"))  # rows of a placed group need not meet
    dealt = dealt.select("doc_id", "size", "tokens", "text_crc32", "group", home.alias("shard"), F.pmod(F.xxhash64(spread), F.lit(buckets)).cast("int").alias("bucket"), *keys)
    packed = cut(dealt.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_pack_bucket(shards, keys), ", ".join(["bucket int, doc_id long, size long, text_crc32 long, shard int, pos long", *(f"{k} long" for k in keys)])))
    counts = packed.groupBy("bucket", "shard").agg(F.count("*").alias("n"))  # buckets * shards rows at most
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return packed.join(F.broadcast(offsets), ["bucket", "shard"]).select("doc_id", "size", "text_crc32", "shard", (F.col("pos") + F.col("offset")).alias("slot"), *keys)


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id", text: str = "text") -> None:
    """Write documents under path/shard=N, each shard sorted by slot: every physical row once, with its columns in a struct doc, and its slot."""
    keyed = with_row_key(docs)
    narrow = keyed.select(F.col("_doc").getField(id_col).alias("id"), F.col("_doc").getField(text).alias("text"), "_file", "_row")
    placed = assign(narrow, shards, "id", "text", ("_file", "_row")).select("_file", "_row", "shard", "slot")
    joined = keyed.join(placed, ["_file", "_row"]).select(F.col("_doc").alias("doc"), "slot", "shard")
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
