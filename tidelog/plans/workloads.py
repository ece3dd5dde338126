"""Generated workloads, time-to-live stores, change streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import epoch_seconds
from ..operators import stores, workload
from ..sources.shapes import event_log, table
from ..streaming import live
from .register import CUR, LOG, Register

query = Register()
QUERIES, SQL = query.queries, query.sql


@query("SELECT (epoch(ts)::BIGINT + 3600 + user_id * 60) // 21600 AS bucket, count(*) AS blobs, sum(length(props))::BIGINT AS bytes FROM events GROUP BY 1")
def blob_ttl_buckets(spark, d):
    e = table(spark, d, "events").select((epoch_seconds(F.col("ts")) + 3600 + F.col("user_id") * 60).alias("expires"), F.length("props").cast("long").alias("size"))
    return stores.ttl_buckets(e, 21_600)


@query("WITH b AS (SELECT (epoch(ts)::BIGINT + 3600 + user_id * 60) // 21600 AS bucket, sum(length(props))::BIGINT AS bytes FROM events GROUP BY 1), w AS (SELECT *, sum(bytes) OVER (ORDER BY bucket DESC) AS r FROM b) SELECT bucket, bytes FROM w WHERE r > 50000")
def blob_fifo_eviction(spark, d):
    e = table(spark, d, "events").select((epoch_seconds(F.col("ts")) + 3600 + F.col("user_id") * 60).alias("expires"), F.length("props").cast("long").alias("size"))
    return stores.evicted(stores.ttl_buckets(e, 21_600), 50_000)


@query(f"WITH {LOG}, l AS (SELECT key, max(seq) AS seq FROM log GROUP BY key HAVING arg_max(op, seq) <> 'DELETE') SELECT log.seq // 512 AS segment, count(*) AS records, count(l.seq) AS live, count(l.seq)::DOUBLE / count(*) AS live_share FROM log LEFT JOIN l ON l.key = log.key AND l.seq = log.seq GROUP BY 1")
def value_log_gc(spark, d):
    return stores.segment_liveness(event_log(table(spark, d, "events")), 512)


@query("WITH m AS (SELECT max(ts) AS top FROM events) SELECT user_id AS id, count(*) AS n, min(event_id) AS first_seq, sum((ts < top - INTERVAL 10 DAY)::INT)::BIGINT AS expired FROM events, m GROUP BY 1")
def time_series_retention(spark, d):
    return stores.retention(table(spark, d, "events"), 10)


@query("WITH p AS (SELECT c_custkey % 10 AS grp, c_custkey % 3 AS part, CAST(round(c_acctbal * 100) AS BIGINT) AS v FROM customer) SELECT grp, sum(CASE WHEN part = 0 THEN v ELSE 0 END)::BIGINT AS s0, sum(CASE WHEN part = 1 THEN v ELSE 0 END)::BIGINT AS s1, sum(CASE WHEN part = 2 THEN v ELSE 0 END)::BIGINT AS s2 FROM p GROUP BY 1")
def transaction_invariant(spark, d):
    c = table(spark, d, "customer")
    v = F.round(F.col("c_acctbal") * 100).cast("long")
    return c.groupBy((F.col("c_custkey") % 10).alias("grp")).agg(*(F.sum(F.when(F.col("c_custkey") % 3 == i, v).otherwise(0)).alias(f"s{i}") for i in range(3)))


@query(f"WITH {LOG}, {CUR} SELECT o_orderkey AS op_id, (o_custkey * 3) % 150 AS key, cur.value FROM orders LEFT JOIN cur ON cur.key = (o_custkey * 3) % 150")
def workload_reads(spark, d):
    ops = table(spark, d, "orders").select(F.col("o_orderkey").alias("op_id"), ((F.col("o_custkey") * 3) % 150).alias("key"))
    return workload.reads(ops, event_log(table(spark, d, "events")))


@query(f"WITH {LOG}, {CUR}, o AS (SELECT o_custkey % 150 AS key, count(*) AS n FROM orders GROUP BY 1) SELECT key, coalesce(value, 0) + coalesce(n, 0) AS value FROM cur FULL JOIN o USING (key)")
def workload_read_modify_write(spark, d):
    ops = table(spark, d, "orders").select((F.col("o_custkey") % 150).alias("key"))
    return workload.read_modify_write(ops, event_log(table(spark, d, "events")))


@query()
def workload_zipfian(spark, d):
    n = table(spark, d, "orders").count()
    return workload.zipfian(spark, n, 1000).groupBy("key").agg(F.count("*").alias("n"))


@query()
def workload_mix(spark, d):
    n = table(spark, d, "orders").count()
    return workload.operations(spark, n, 1000, {"READ": 0.5, "UPDATE": 0.5}, "zipfian").groupBy("op").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_qps(spark, d):
    return live.windowed_counts(spark, f"{d}/events.parquet")


@query(f"WITH {LOG} SELECT key, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM log GROUP BY key")
def stream_latest(spark, d):
    return live.latest_versions(spark, f"{d}/events.parquet")


@query(f"WITH {LOG} SELECT key, seq, op, value FROM log WHERE seq >= 500")
def stream_tail(spark, d):
    return live.tail(spark, f"{d}/events.parquet", 500)
