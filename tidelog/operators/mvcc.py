"""Resolution of a version log: what each key holds at a snapshot.

One shuffle by key, with partial aggregation: the newest base (put or delete) by max_by,
merge operands after it folded in seq order. Range tombstones bury versions older than
they; they are joined by key ranges only where there are any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.merge import MergeOperator
from .ranges import buried


def visible(log: DataFrame, snapshot: Column | int | None = None, ts_from=None, ts_to=None) -> DataFrame:
    """Versions with seq up to the snapshot and ts within the bounds, both included."""
    if snapshot is not None:
        log = log.where(F.col("seq") <= snapshot)
    if ts_from is not None:
        log = log.where(F.col("ts") >= ts_from)
    if ts_to is not None:
        log = log.where(F.col("ts") <= ts_to)
    return log


def newest(log: DataFrame, by: tuple[str, ...] = ("key",), carry: tuple[str, ...] = ("op", "value")) -> DataFrame:
    """The newest version of each key: by, seq and the carried columns."""
    return log.groupBy(*by).agg(F.max("seq").alias("seq"), F.max_by(F.struct(*carry), "seq").alias("_v")).select(*by, "seq", *(F.col(f"_v.{c}").alias(c) for c in carry))


def latest(log: DataFrame, snapshot: Column | int | None = None) -> DataFrame:
    """key, seq, value of live keys where a merge counts as a put: newest version wins, deletes hide."""
    return newest(visible(log, snapshot)).where("op NOT IN ('DELETE', 'SINGLE_DELETE')").select("key", "seq", "value")


def resolve(log: DataFrame, merge: MergeOperator, snapshot: Column | int | None = None, tombstones: DataFrame | None = None) -> DataFrame:
    """key, value of live keys, merge operands folded on their base.

    A key is live if its newest base is a put that no newer tombstone covers, or if operands
    stand after its newest base."""
    v = visible(log, snapshot)
    if tombstones is not None:
        dead = buried(v, visible(tombstones, snapshot)).withColumn("_dead", F.lit(True))
        v = v.join(dead, ["key", "seq"], "left").withColumns({"op": F.when(F.col("_dead"), "DELETE").otherwise(F.col("op")), "value": F.when(F.col("_dead").isNull(), F.col("value"))}).drop("_dead")
    base_seq = F.max(F.when(F.col("op") != "MERGE", F.col("seq")))
    base = F.max_by(F.when(F.col("op") == "PUT", F.col("value")), F.when(F.col("op") != "MERGE", F.col("seq")))
    if merge.last_wins:
        return newest(v).where("op IN ('PUT', 'MERGE')").select("key", "value")
    if merge.reduces:
        # A commutative fold: operands after the base are picked by one more pass over the key's base.
        bases = v.where("op <> 'MERGE'").groupBy("key").agg(F.max("seq").alias("base_seq"), F.max_by(F.when(F.col("op") == "PUT", F.col("value")), "seq").alias("base"))
        after = v.where("op = 'MERGE'").join(bases.select("key", "base_seq"), "key", "left").where("base_seq IS NULL OR seq > base_seq")
        folded = after.groupBy("key").agg(merge.reduces(F.col("value")).alias("operands"))
        return bases.join(folded, "key", "full_outer").select("key", merge.combine(F.col("base"), F.col("operands")).alias("value")).where("value IS NOT NULL")
    operands = F.array_sort(F.collect_list(F.when(F.col("op") == "MERGE", F.struct("seq", "value"))))
    g = v.groupBy("key").agg(base_seq.alias("base_seq"), base.alias("base"), operands.alias("operands"))
    after = F.filter("operands", lambda o: F.col("base_seq").isNull() | (o["seq"] > F.col("base_seq")))
    g = g.select("key", "base", F.transform(after, lambda o: o["value"]).alias("operands"))
    return g.where("base IS NOT NULL OR size(operands) > 0").select("key", merge.fold(F.col("base"), F.col("operands")).alias("value"))


def resolve_short(log: DataFrame, merge: MergeOperator, enough: int, snapshot: Column | int | None = None) -> DataFrame:
    """resolve() whose merge asks for no more than `enough` operands: where as many stand above the base, the newest of them fold without a base.

    Spark keeps `enough` rows a key per task before the shuffle."""
    v = visible(log, snapshot)
    bases = v.where("op <> 'MERGE'").groupBy("key").agg(F.max("seq").alias("_base"), F.max_by(F.when(F.col("op") == "PUT", F.col("value")), "seq").alias("base"))
    above = v.where("op = 'MERGE'").join(bases.select("key", "_base"), "key", "left").where("_base IS NULL OR seq > _base")
    newest_first = Window.partitionBy("key").orderBy(F.col("seq").desc())
    few = above.withColumn("_r", F.row_number().over(newest_first)).where(F.col("_r") <= enough)
    folded = few.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda o: o["value"]).alias("operands"))
    both = bases.join(folded, "key", "full_outer").withColumn("operands", F.coalesce("operands", F.array().cast(folded.schema["operands"].dataType)))
    base = F.when(F.size("operands") < enough, F.col("base"))
    return both.where("base IS NOT NULL OR size(operands) > 0").select("key", merge.fold(base, F.col("operands")).alias("value"))


def resolve_blobs(current: DataFrame, blobs: DataFrame) -> DataFrame:
    """key, status, value: values that are blob references (is_blob) are looked up in blobs(blob, content); a dangling one is Corruption."""
    met = current.join(blobs.withColumn("_there", F.lit(True)), (F.col("value") == F.col("blob")) & F.col("is_blob"), "left")
    bad = F.col("is_blob") & F.col("_there").isNull()
    return met.select("key", F.when(bad, "Corruption").otherwise("OK").alias("status"), F.when(F.col("is_blob"), F.col("content")).otherwise(F.col("value").cast("string")).alias("value"))


def resolve_checked(log: DataFrame, merge: MergeOperator, valid: Column, strict: bool = False) -> DataFrame:
    """key, status, value where a merge fails on an operand that is not valid: the key is Corruption, without a value (with strict the read itself fails)."""
    bases = log.where("op <> 'MERGE'").groupBy("key").agg(F.max("seq").alias("_base"))
    above = log.where("op = 'MERGE'").join(bases, "key", "left").where("_base IS NULL OR seq > _base")
    failed = above.groupBy("key").agg(F.min(F.coalesce(valid, F.lit(False))).alias("_ok")).where("NOT _ok")
    met = resolve(log, merge).join(failed, "key", "left")
    bad = F.col("_ok").isNotNull()
    status = F.when(bad, F.raise_error(F.lit("Corruption: merge failed")) if strict else F.lit("Corruption")).otherwise("OK")
    return met.select("key", status.alias("status"), F.when(~bad, F.col("value")).alias("value"))


def operands(log: DataFrame, most: int, snapshot: Column | int | None = None) -> DataFrame:
    """key, status, operands (newest first) of live keys: the base's value and the merge operands after it, unfolded; with over `most` none and Incomplete."""
    v = visible(log, snapshot)
    bases = v.where("op <> 'MERGE'").groupBy("key").agg(F.max("seq").alias("_base"))  # versions below a key's base are not collected
    above = v.join(bases, "key", "left").where("_base IS NULL OR seq >= _base")
    rows = F.array_sort(F.collect_list(F.when(F.col("op").isin("MERGE", "PUT"), F.struct((-F.col("seq")).alias("back"), "value"))))
    g = above.groupBy("key").agg(rows.alias("rows"))
    values = F.transform("rows", lambda r: r["value"])
    g = g.select("key", values.alias("operands")).where("size(operands) > 0")
    return g.select("key", F.when(F.size("operands") > most, "Incomplete").otherwise("OK").alias("status"), F.when(F.size("operands") <= most, F.col("operands")).alias("operands"), F.size("operands").cast("long").alias("n"))


def resolve_with(log: DataFrame, full_merge, value_type: str = "long") -> DataFrame:
    """key, value by a user's full_merge(key, base or None, [operands, oldest first]) in Python, for folds that columns can't express.

    Each key's visible operands meet in one task, as the fold's order demands."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        base, operands, live = None, [], False
        for op, value in zip(*(pdf.sort_values("seq")[c].tolist() for c in ("op", "value"))):
            if op == "MERGE":
                operands.append(value)
            else:
                base, operands, live = (value if op == "PUT" else None), [], op == "PUT"
        if not live and not operands:
            return pd.DataFrame({"key": [], "value": []})
        key = pdf["key"].iloc[0]
        return pd.DataFrame({"key": [key], "value": [full_merge(key, base, operands) if operands else base]})

    key_type = log.schema["key"].dataType.simpleString()
    return log.groupBy("key").applyInPandas(run, f"key {key_type}, value {value_type}")
