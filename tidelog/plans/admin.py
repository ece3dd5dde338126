"""Properties, command-line style reports, recovery and runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import compaction, mvcc, ranges, scan, simulate
from ..operators.ordering import positions
from ..sources import formats
from ..sources.scratch import new_path
from ..sources.shapes import BLOCK_ORDER, block_trace, event_log, event_tombstones, file_stats, metric_series, table
from .register import FILES, LOG, SERIES, TOMB, Register

query = Register()
QUERIES, SQL = query.queries, query.sql


def _log(spark, d):
    return event_log(table(spark, d, "events"))


@query("SELECT l_linenumber AS level, count(DISTINCT l_suppkey) AS files, sum(l_quantity)::BIGINT AS bytes, min(l_quantity)::BIGINT AS least, max(l_quantity)::BIGINT AS most FROM lineitem GROUP BY 1")
def property_level_stats(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("level")).agg(F.countDistinct("l_suppkey").alias("files"), F.sum(q).cast("long").alias("bytes"), F.min(q).cast("long").alias("least"), F.max(q).cast("long").alias("most"))


@query(f"WITH {LOG} SELECT min(ts) AS oldest_key_time, max(seq) AS latest_sequence, count(DISTINCT key) AS keys, sum(length(key::VARCHAR) + length(value::VARCHAR))::BIGINT AS live_data_size FROM log")
def property_database(spark, d):
    k, v = F.col("key").cast("string"), F.col("value").cast("string")
    return _log(spark, d).agg(F.min("ts").alias("oldest_key_time"), F.max("seq").alias("latest_sequence"), F.countDistinct("key").alias("keys"), F.sum(F.length(k) + F.length(v)).alias("live_data_size"))


@query(f"WITH {FILES} SELECT count(*) AS files, sum(n)::BIGINT AS entries, sum(bytes)::BIGINT AS bytes, min(smallest) AS smallest, max(largest) AS largest FROM files")
def property_aggregated_files(spark, d):
    return file_stats(table(spark, d, "part")).agg(F.count("*").alias("files"), F.sum("n").alias("entries"), F.sum("bytes").alias("bytes"), F.min("smallest").alias("smallest"), F.max("largest").alias("largest"))


@query(f"WITH {FILES} SELECT file, smallest, largest, n, bytes FROM files WHERE smallest < 10 AND largest >= 5")
def files_by_key_range(spark, d):
    return scan.may_hold(file_stats(table(spark, d, "part")), 5, 10)


@query(f"WITH {LOG}, m AS (SELECT key, max(seq) AS seq, arg_max(value, seq) AS value, epoch(arg_max(ts, seq))::BIGINT AS sec FROM log GROUP BY key HAVING arg_max(op, seq) <> 'DELETE') SELECT key, value FROM m WHERE key >= 3 AND key < 120 AND sec >= 1706000000 AND sec < 1706600000 ORDER BY key LIMIT 40")
def cli_scan_ttl_window(spark, d):
    live = mvcc.newest(_log(spark, d).withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp"))), carry=("op", "value", "sec")).where("op <> 'DELETE'")
    inside = live.where("sec >= 1706000000 AND sec < 1706600000").select("key", "value")
    return scan.scan(inside, 3, 120, limit=40)


@query(f'WITH {TOMB} SELECT b AS "begin", e AS "end", tseq AS seq FROM tomb')
def cli_list_range_deletes(spark, d):
    return event_tombstones(table(spark, d, "events"))


@query(f"WITH {LOG} SELECT seq, concat_ws(',', seq::VARCHAR, op, key::VARCHAR, length(value::VARCHAR)::VARCHAR) AS line FROM log")
def cli_dump_wal(spark, d):
    parts = (F.col("seq").cast("string"), F.col("op"), F.col("key").cast("string"), F.length(F.col("value").cast("string")).cast("string"))
    return _log(spark, d).select("seq", F.concat_ws(",", *parts).alias("line"))


@query(f"WITH {LOG} SELECT count(*) AS entries, min(key) AS smallest, max(key) AS largest FROM log")
def cli_file_properties(spark, d):
    path = new_path(spark)
    formats.write_sorted(_log(spark, d), path, files=4)
    files = formats.file_properties(spark, path)
    return files.agg(F.sum("entries").alias("entries"), F.min("smallest").alias("smallest"), F.max("largest").alias("largest"))


@query("SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey < 5000 ORDER BY -(o_orderkey % 100), o_orderkey LIMIT 25")
def custom_order_scan(spark, d):
    """A user's order as a derived sort key."""
    o = table(spark, d, "orders").where("o_orderkey < 5000").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"))
    return o.orderBy(-(F.col("key") % 100), "key").limit(25)


@query("""WITH r AS (SELECT p_partkey AS key, p_size AS value, CASE WHEN p_size = 7 THEN p_partkey + 5 END AS until FROM part), w AS (SELECT *, max(until) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bar FROM r)
SELECT key, CASE WHEN value % 5 = 0 THEN -value ELSE value END AS value FROM w WHERE until IS NULL AND (bar IS NULL OR key >= bar) AND value <> 3""")
def compact_decisions(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("value"))
    v = F.col("value")
    decision = F.when(v == 7, "skip").when(v == 3, "remove").when(v % 5 == 0, "change").otherwise("keep")
    return compaction.decide(rows, decision, -v, F.col("key") + 5)


@query(f"WITH {LOG}, stop AS (SELECT min(seq) AS s FROM log WHERE seq > (SELECT max(seq) // 2 FROM log) AND op = 'DELETE' AND key % 5 = 0) SELECT key, seq, op, value FROM log, stop WHERE (s IS NULL OR seq < s) AND key % 7 <> 0")
def wal_filter(spark, d):
    log = _log(spark, d).select("key", "seq", "op", "value")
    half = log.agg(F.max("seq")).first()[0] // 2
    verdict = F.when((F.col("seq") > half) & (F.col("op") == "DELETE") & (F.col("key") % 5 == 0), "stop").when(F.col("key") % 7 == 0, "ignore")
    return compaction.recover(log, verdict)


@query(f"WITH {LOG}, {TOMB}, dead AS (SELECT DISTINCT l.key, l.seq FROM log l JOIN tomb ON l.key >= b AND l.key < e AND tseq > l.seq) SELECT l.key, l.seq, l.op, l.value FROM log l ANTI JOIN dead ON l.key = dead.key AND l.seq = dead.seq")
def compact_range_tombstones(spark, d):
    return compaction.drop_buried(_log(spark, d).select("key", "seq", "op", "value"), event_tombstones(table(spark, d, "events")))


@query(f"WITH {LOG} SELECT key, seq, op, value FROM log")
def merge_sorted_runs(spark, d):
    log = _log(spark, d).select("key", "seq", "op", "value")
    return compaction.merge_runs([log.where(F.col("seq") % 3 == i) for i in range(3)])


@query(f"WITH {LOG} SELECT key % 10 AS prefix, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM log GROUP BY 1")
def partitioned_output(spark, d):
    """Output cut where the key's prefix changes, one directory per prefix."""
    path = new_path(spark)
    _log(spark, d).withColumn("prefix", F.col("key") % 10).repartition("prefix").write.partitionBy("prefix").parquet(path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("prefix").cast("long").alias("prefix")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query(f"""WITH {LOG}, base AS (SELECT key, max(seq) AS bs, CASE WHEN arg_max(op, seq) = 'PUT' THEN arg_max(value, seq) END AS bv FROM log WHERE op <> 'MERGE' GROUP BY key),
after AS (SELECT l.key, list(l.value ORDER BY l.seq) AS xs FROM log l LEFT JOIN base USING (key) WHERE op = 'MERGE' AND (bs IS NULL OR l.seq > bs) GROUP BY l.key)
SELECT key, CASE WHEN xs IS NULL THEN bv ELSE list_reduce(list_concat([coalesce(bv, 1)], xs), lambda a, x: (a * 31 + x) % 1000003) END AS value FROM base FULL JOIN after USING (key) WHERE bv IS NOT NULL OR xs IS NOT NULL""")
def merge_user_ordered(spark, d):
    """A fold that depends on the operands' order, in Python."""

    def fold(key, base, operands):
        value = 1 if base is None else base
        for x in operands:
            value = (value * 31 + x) % 1000003
        return int(value)

    return mvcc.resolve_with(_log(spark, d), fold)


@query(f"WITH {SERIES}, c AS (SELECT entity, stat, day, sum(value) OVER (PARTITION BY entity, stat ORDER BY day)::BIGINT AS total FROM series), w AS (SELECT *, total - coalesce(lag(total) OVER (PARTITION BY entity, stat ORDER BY day), 0) AS delta FROM c) SELECT * FROM w WHERE day >= DATE '2024-01-05' AND day < DATE '2024-01-15'")
def stats_history(spark, d):
    s = metric_series(table(spark, d, "events"))
    w = Window.partitionBy("entity", "stat").orderBy("day")
    c = s.select("entity", "stat", "day", F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total"))
    return c.withColumn("delta", F.col("total") - F.coalesce(F.lag("total").over(w), F.lit(0))).where("day >= DATE '2024-01-05' AND day < DATE '2024-01-15'")


@query(f"WITH {LOG}, g AS (SELECT key, seq // 1000 AS slot, count(*) AS n FROM log GROUP BY 1, 2) SELECT key, round(sum(n * pow(2.0, -((SELECT max(seq) // 1000 FROM log) - slot))), 6) AS heat FROM g GROUP BY key")
def heat_decay(spark, d):
    """Heat gathered per thousand writes, halved with each thousand since."""
    from ..functions.stats import decayed

    log = _log(spark, d)
    slots = log.groupBy("key", F.floor(F.col("seq") / 1000).alias("slot")).agg(F.count("*").alias("n"))
    last = log.agg(F.floor(F.max("seq") / 1000).alias("_last"))
    return slots.join(F.broadcast(last)).groupBy("key").agg(F.round(F.sum(decayed(F.col("n"), F.col("_last") - F.col("slot"), 1.0)), 6).alias("heat"))  # one row


@query()
def sim_miss_percentiles(spark, d):
    t = positions(block_trace(table(spark, d, "lineitem")), BLOCK_ORDER, "seq").withColumn("high", F.col("bt") == "N")
    return simulate.miss_percentiles(simulate.simulate(t, [("lru", 4_000), ("lfu", 4_000)], shards=4, slot=30 * 86_400), [0.5, 0.9, 0.99])


@query(f'WITH {TOMB}, {FILES} SELECT file, count(*) AS tombstones, min(b)::BIGINT AS first_begin FROM files JOIN tomb ON smallest < e AND largest >= b GROUP BY file')
def file_tombstones(spark, d):
    met = ranges.overlapping(file_stats(table(spark, d, "part")), event_tombstones(table(spark, d, "events")))
    return met.groupBy("file").agg(F.count("*").alias("tombstones"), F.min("begin").alias("first_begin"))
