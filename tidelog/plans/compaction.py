"""Compaction, ingestion and file-picking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.merge import by_name
from ..functions.scalars import epoch_seconds
from ..operators import compaction, mvcc
from ..sources import formats
from ..sources.shapes import event_log, file_stats, table
from .register import FILES, LOG, Register

query = Register()
QUERIES, SQL = query.queries, query.sql
_TOP = (1 << 62) - 1


def _log(spark, d):
    return event_log(table(spark, d, "events"))


def _snapshots(spark, d):
    top = table(spark, d, "events").agg(F.max("event_id")).first()[0]
    return [top // 4, top // 2, top * 3 // 4]


_STRIPED = f"""{LOG}, m AS (SELECT max(seq) AS t FROM log), striped AS (SELECT log.*, CASE WHEN seq <= t // 4 THEN t // 4 WHEN seq <= t // 2 THEN t // 2 WHEN seq <= t * 3 // 4 THEN t * 3 // 4 ELSE {_TOP} END AS stripe FROM log, m)"""


@query(f"WITH {_STRIPED} SELECT key, stripe, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM striped GROUP BY key, stripe")
def compact_stripes(spark, d):
    return compaction.keep_newest(_log(spark, d), _snapshots(spark, d))


@query(f"""WITH {_STRIPED}, k AS (SELECT key, stripe, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM striped GROUP BY key, stripe)
SELECT key, stripe, CASE WHEN stripe = t // 4 AND op = 'PUT' THEN 0 ELSE seq END AS seq, op, value FROM k, m WHERE NOT (stripe = t // 4 AND op = 'DELETE')""")
def compact_bottommost(spark, d):
    return compaction.keep_newest(_log(spark, d), _snapshots(spark, d), True)


@query(f"""WITH {_STRIPED}, b AS (SELECT key, stripe, max(seq) AS bs, arg_max(op, seq) AS bo, arg_max(value, seq) AS bv FROM striped WHERE op <> 'MERGE' GROUP BY 1, 2),
o AS (SELECT s.key, s.stripe, sum(value) AS m FROM striped s LEFT JOIN b USING (key, stripe) WHERE op = 'MERGE' AND (bs IS NULL OR seq > bs) GROUP BY 1, 2)
SELECT key, stripe, CASE WHEN bs IS NULL THEN 'MERGE' WHEN m IS NOT NULL THEN 'PUT' ELSE bo END AS op,
  CASE WHEN m IS NOT NULL OR bo = 'PUT' THEN (coalesce(CASE WHEN bo = 'PUT' THEN bv END, 0) + coalesce(m, 0))::DECIMAL(20, 0) END AS value FROM b FULL JOIN o USING (key, stripe)""")
def compact_merge_stripes(spark, d):
    return compaction.merge_stripes(_log(spark, d), _snapshots(spark, d), by_name("uint64add"))


_SD = "sd AS (SELECT key, seq, CASE op WHEN 'DELETE' THEN 'SINGLE_DELETE' ELSE 'PUT' END AS op, value FROM log)"


def _single(spark, d):
    return _log(spark, d).select("key", "seq", F.when(F.col("op") == "DELETE", "SINGLE_DELETE").otherwise("PUT").alias("op"), "value")


@query(f"""WITH {LOG}, {_SD}, w AS (SELECT *, lead(op) OVER (PARTITION BY key ORDER BY seq DESC) AS below, lag(op) OVER (PARTITION BY key ORDER BY seq DESC) AS above FROM sd)
SELECT key, seq, op, value FROM w WHERE NOT ((op = 'SINGLE_DELETE' AND (below IS NULL OR below IN ('PUT', 'SINGLE_DELETE'))) OR (op = 'PUT' AND coalesce(above, '') = 'SINGLE_DELETE'))""")
def compact_single_delete(spark, d):
    return compaction.pair_single_deletes(_single(spark, d))


@query(f"""WITH {LOG}, w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM log)
SELECT key, seq, op, CASE WHEN r = 1 THEN value + 1 ELSE value END AS value FROM w WHERE NOT (r = 1 AND value < 500)""")
def compact_filter(spark, d):
    return compaction.filter_newest(_log(spark, d), F.col("value") < 500, F.col("value") + 1).select("key", "seq", "op", "value")


@query("SELECT p_partkey AS key, p_size AS size FROM part WHERE length(p_name) > 0")
def compact_remove_empty(spark, d):
    return table(spark, d, "part").where(F.length("p_name") > 0).select(F.col("p_partkey").alias("key"), F.col("p_size").alias("size"))


@query(f"WITH {LOG} SELECT key, seq, value FROM log WHERE NOT (epoch(ts)::BIGINT + 864000 < (SELECT epoch(max(ts))::BIGINT FROM events))")
def compact_ttl(spark, d):
    log = _log(spark, d).withColumn("sec", epoch_seconds(F.col("ts")))
    now = log.agg(F.max("sec")).first()[0]
    return compaction.live_by_ttl(log, 864_000, now, F.col("sec")).select("key", "seq", "value")


@query("""WITH r AS (SELECT p_partkey AS key, CASE WHEN p_size = 7 THEN p_partkey + 5 END AS until FROM part), w AS (SELECT *, max(until) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bar FROM r)
SELECT key FROM w WHERE until IS NULL AND (bar IS NULL OR key >= bar)""")
def skip_until(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("key"), "p_size")
    return compaction.skip_until(rows, F.when(F.col("p_size") == 7, F.col("key") + 5)).select("key")


@query(f"""WITH {_STRIPED}, w AS (SELECT striped.*, row_number() OVER (PARTITION BY key, stripe ORDER BY seq DESC) AS rs, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rk, t FROM striped, m)
SELECT CASE WHEN rs > 1 THEN 'hidden' WHEN stripe = t // 4 AND op = 'DELETE' THEN 'obsolete' WHEN rk = 1 AND value < 500 THEN 'user' ELSE 'kept' END AS fate, count(*) AS n FROM w GROUP BY 1""")
def compact_drop_stats(spark, d):
    return compaction.drop_statistics(_log(spark, d), _snapshots(spark, d), F.col("value") < 500)


@query(f"WITH {LOG}, f AS (SELECT *, key % 16 AS file FROM log), w AS (SELECT file, sum((op = 'DELETE')::INT) OVER (PARTITION BY file ORDER BY seq ROWS BETWEEN 127 PRECEDING AND CURRENT ROW) AS n FROM f) SELECT file, max(n)::BIGINT AS most FROM w GROUP BY file HAVING max(n) >= 30")
def delete_window_trigger(spark, d):
    return compaction.delete_triggers(_log(spark, d).withColumn("file", F.col("key") % 16), 128, 30)


@query(f"WITH {FILES}, c AS (SELECT *, largest AS created FROM files), w AS (SELECT *, sum(bytes) OVER (ORDER BY created DESC, file) AS total FROM c) SELECT file, created, bytes FROM w WHERE total > (SELECT sum(bytes) // 2 FROM files)")
def fifo_size_pick(spark, d):
    files = file_stats(table(spark, d, "part")).withColumn("created", F.col("largest"))
    return compaction.fifo_pick(files, files.agg(F.sum("bytes")).first()[0] // 2)


@query(f"WITH {FILES} SELECT file, smallest, largest, n, bytes, largest AS created FROM files WHERE largest < (SELECT max(largest) FROM files) - 20")
def fifo_ttl_pick(spark, d):
    files = file_stats(table(spark, d, "part")).withColumn("created", F.col("largest"))
    return compaction.fifo_ttl_pick(files, 20, files.agg(F.max("created")).first()[0])


_LOWER = "lower_files AS (SELECT p_type AS file, min(p_partkey) AS smallest, max(p_partkey) AS largest, sum(length(p_name))::BIGINT AS bytes FROM part GROUP BY 1)"


@query(f"WITH {FILES}, {_LOWER} SELECT f.file, floor(coalesce(sum(l.bytes), 0) * 1024 / f.bytes)::BIGINT AS ratio FROM files f LEFT JOIN lower_files l ON l.smallest <= f.largest AND l.largest >= f.smallest GROUP BY f.file, f.bytes")
def min_overlap_order(spark, d):
    part = table(spark, d, "part")
    lower = part.groupBy(F.col("p_type").alias("file")).agg(F.min("p_partkey").alias("smallest"), F.max("p_partkey").alias("largest"), F.sum(F.length("p_name")).cast("long").alias("bytes"))
    return compaction.min_overlap_order(file_stats(part), lower)


@query(f"WITH {LOG} SELECT key, max(seq) AS seq, arg_max(value, seq) AS value, least(count(*), 127) AS inserts, CASE WHEN least(count(*), 127) > 60 THEN 'rewrite' ELSE 'flush' END AS fate FROM log GROUP BY key")
def hot_key_split(spark, d):
    return compaction.hot_split(compaction.squeeze(_log(spark, d)), 60)


@query("WITH l AS (SELECT l_linenumber AS level, sum(l_quantity)::BIGINT AS bytes, count(DISTINCT l_suppkey) AS runs, count(*) AS written FROM lineitem GROUP BY 1) SELECT level, written / bytes AS write_amp, runs::DOUBLE AS read_amp, -(written / bytes + runs) AS reward FROM l")
def tier_reward(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("level")).agg(F.sum("l_quantity").cast("long").alias("bytes"), F.countDistinct("l_suppkey").alias("runs"), F.count("*").alias("written"))
    return compaction.tier_reward(li)


_HALVES = "h AS (SELECT max(seq) // 2 AS c FROM log), base AS (SELECT key, seq, op, value FROM log, h WHERE seq <= c), ext AS (SELECT key, arg_max(value, seq) AS value FROM log, h WHERE seq > c GROUP BY key)"


def _halves(spark, d):
    log = _log(spark, d).select("key", "seq", "op", "value")
    c = log.agg(F.max("seq")).first()[0] // 2
    ext = log.where(F.col("seq") > c).groupBy("key").agg(F.max_by("value", "seq").alias("value"))
    return log.where(F.col("seq") <= c), ext


@query(f"WITH {LOG}, {_HALVES}, u AS (SELECT * FROM base UNION ALL SELECT key, (SELECT max(seq) + 1 FROM base), 'PUT', value FROM ext) SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM u GROUP BY key HAVING arg_max(op, seq) <> 'DELETE'")
def ingest_ahead(spark, d):
    base, ext = _halves(spark, d)
    return mvcc.latest(formats.ingest(base, ext, behind=False))


@query(f"WITH {LOG}, {_HALVES}, u AS (SELECT * FROM base UNION ALL SELECT key, -1, 'PUT', value FROM ext) SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM u GROUP BY key HAVING arg_max(op, seq) <> 'DELETE'")
def ingest_behind(spark, d):
    base, ext = _halves(spark, d)
    return mvcc.latest(formats.ingest(base, ext, behind=True))


_BATCHES = "batches AS (SELECT event_id // 100 AS batch, event_id % 100 AS pos, user_id AS key, CAST(round(value * 100) AS BIGINT) AS value FROM events)"


@query(f"WITH {_BATCHES} SELECT batch, pos, key, value FROM batches WHERE pos < (batch % 7) * 15 OR batch % 7 = 0")
def savepoint_rollback(spark, d):
    e = table(spark, d, "events")
    ops = e.select(F.floor(F.col("event_id") / 100).alias("batch"), (F.col("event_id") % 100).alias("pos"), F.col("user_id").alias("key"), F.round(F.col("value") * 100).cast("long").alias("value"))
    marks = ops.select("batch").distinct().select("batch", F.when(F.col("batch") % 7 != 0, (F.col("batch") % 7) * 15).alias("savepoint"))
    return formats.rolled_back(ops, marks)


@query(f"WITH {_BATCHES} SELECT batch * 100 + pos AS seq, batch, pos, key, value FROM batches")
def batch_iterate(spark, d):
    e = table(spark, d, "events")
    batches = e.groupBy(F.floor(F.col("event_id") / 100).alias("batch")).agg(F.collect_list(F.struct((F.col("event_id") % 100).alias("pos"), F.col("user_id").alias("key"), F.round(F.col("value") * 100).cast("long").alias("value"))).alias("ops"))
    return formats.iterate_batches(batches, F.col("batch") * 100)


@query(f"WITH {LOG} SELECT substr(key::VARCHAR, 1, 1) AS prefix, count(*) AS n, sum(length(key::VARCHAR) + length(value::VARCHAR))::BIGINT AS bytes, sum((op = 'DELETE')::INT)::BIGINT AS deletes FROM log GROUP BY 1")
def internal_dump(spark, d):
    k, v = F.col("key").cast("string"), F.col("value").cast("string")
    return _log(spark, d).groupBy(F.substring(k, 1, 1).alias("prefix")).agg(F.count("*").alias("n"), F.sum(F.length(k) + F.length(v)).alias("bytes"), F.sum((F.col("op") == "DELETE").cast("long")).alias("deletes"))


@query(f"WITH {LOG} SELECT key::VARCHAR || ' ==> ' || value::VARCHAR AS line FROM log WHERE op = 'PUT'")
def dump_text(spark, d):
    return formats.dump_lines(_log(spark, d).where("op = 'PUT'"))


@query(f"WITH {LOG} SELECT key, value FROM log WHERE op = 'PUT'")
def load_text(spark, d):
    return formats.load_lines(formats.dump_lines(_log(spark, d).where("op = 'PUT'"))).select(F.col("key").cast("long").alias("key"), F.col("value").cast("long").alias("value"))


@query(f"WITH {LOG} SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM log GROUP BY key HAVING arg_max(op, seq) <> 'DELETE'")
def sorted_file_round_trip(spark, d):
    from ..sources.scratch import new_path

    path = new_path(spark)
    formats.write_sorted(mvcc.latest(_log(spark, d)), path)
    return formats.read_sorted(spark, path)


@query("SELECT o_orderdate::DATE AS id, count(*) AS rows, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS bytes FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 5")
def backup_retention(spark, d):
    o = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("id")).agg(F.count("*").alias("rows"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("bytes"))
    return formats.keep_last(o, 5)
