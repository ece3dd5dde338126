"""Histograms, heat, sketches, wide rows and scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars, stats
from ..operators import heat, widerow
from ..sources.shapes import event_log, table
from .register import LOG, Register

query = Register()
QUERIES, SQL = query.queries, query.sql


def _cents(spark, d):
    return event_log(table(spark, d, "events")).select("key", "seq", "op", "value")


_LIMITS = ", ".join(f"({a}, {b})" for a, b in zip((0, *stats.bucket_limits(2**40)), stats.bucket_limits(2**40)))
_BUCKETED = f"{LOG}, lim(low, bucket) AS (VALUES {_LIMITS}), b AS (SELECT op, bucket, any_value(low) AS low, count(*) AS n, min(value) AS lo, max(value) AS hi FROM log JOIN lim ON value > low AND value <= bucket OR (value <= 0 AND bucket = 1) GROUP BY op, bucket)"


@query(f"WITH {_BUCKETED} SELECT op, bucket, n, 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY op) AS share, 100.0::DOUBLE * sum(n) OVER (PARTITION BY op ORDER BY bucket) / sum(n) OVER (PARTITION BY op) AS cumulative FROM b")
def hist_buckets(spark, d):
    return stats.histogram(_cents(spark, d), "value", ("op",))


@query(f"""WITH {_BUCKETED}, r AS (SELECT *, sum(n) OVER (PARTITION BY op ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY op) AS total, min(lo) OVER (PARTITION BY op) AS mn, max(hi) OVER (PARTITION BY op) AS mx FROM b),
q AS (SELECT r.*, p, total * p / 100.0 AS need FROM r, (VALUES (50.0::DOUBLE), (75.0), (99.0), (99.9), (99.99)) v(p))
SELECT op, p, greatest(mn::DOUBLE, least(mx::DOUBLE, low + (bucket - low) * (need - (upto - n)) / n)) AS value FROM q WHERE upto >= need AND upto - n < need""")
def hist_percentiles(spark, d):
    return stats.percentiles(_cents(spark, d), "value", [50.0, 75.0, 99.0, 99.9, 99.99], ("op",))


@query(f"""WITH {LOG} SELECT op, count(*) AS n, sum(value)::BIGINT AS total, min(value) AS least, max(value) AS most, sum(value)::DOUBLE / count(*) AS average,
  sqrt(greatest(0.0, (sum(value * value)::DOUBLE * count(*) - sum(value)::DOUBLE * sum(value)::DOUBLE) / (count(*) * count(*)))) AS deviation FROM log GROUP BY op""")
def hist_moments(spark, d):
    return _cents(spark, d).groupBy("op").agg(*stats.moments("value"))


@query("SELECT event_type AS ticker, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS total FROM events GROUP BY 1")
def tickers(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("ticker")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total"))


@query(f"WITH {LOG}, h AS (SELECT key, (seq - (SELECT max(seq) FROM log)) / 64.0 AS age FROM log) SELECT key, round(sum(CASE WHEN age < -512 THEN 0.0 ELSE pow(2, age / 32.0) END), 6) AS heat FROM h GROUP BY key")
def heat_by_key(spark, d):
    return heat.heat_by_key(_cents(spark, d), 64.0)


@query(f"WITH {LOG}, h AS (SELECT key, (seq - (SELECT max(seq) FROM log)) / 64.0 AS age FROM log), g AS (SELECT key, round(sum(CASE WHEN age < -512 THEN 0.0 ELSE pow(2, age / 32.0) END), 6) AS heat FROM h GROUP BY key) SELECT key, heat FROM g ORDER BY heat DESC, key LIMIT 10")
def heat_topk(spark, d):
    return heat.heat_by_key(_cents(spark, d), 64.0).orderBy(F.col("heat").desc(), "key").limit(10)


@query(f"WITH {LOG}, g AS (SELECT key, count(*) AS n FROM log GROUP BY key), w AS (SELECT key, n, sum(n) OVER (ORDER BY key) AS r FROM g) SELECT (r - n) // 500 AS grp, min(key) AS first_key, max(key) AS last_key, count(*) AS keys, sum(n)::BIGINT AS n FROM w GROUP BY 1")
def heat_groups(spark, d):
    return heat.groups(_cents(spark, d), 500)


@query(f"WITH {LOG}, g AS (SELECT key, count(*) AS n FROM log GROUP BY key), w AS (SELECT key, n, sum(n) OVER (ORDER BY key) AS r FROM g), t AS (SELECT (r - n) // 500 AS grp, min(key) AS first_key, max(key) AS last_key, count(*) AS keys, sum(n)::BIGINT AS n FROM w GROUP BY 1) SELECT * FROM t ORDER BY n / keys, grp LIMIT 3")
def coldest_groups(spark, d):
    return heat.coldest(heat.groups(_cents(spark, d), 500), 3)


@query(f"WITH {LOG} SELECT key, ((min(value) + arg_min(value, seq)) * ((count(*) + 1) // 2))::BIGINT AS lower_bound, ((arg_min(value, seq) + max(value)) * ((count(*) + 1) // 2))::BIGINT AS upper_bound FROM log GROUP BY key")
def heat_bounds(spark, d):
    g = _cents(spark, d).groupBy("key").agg(F.min("value").alias("h1"), F.min_by("value", "seq").alias("h2"), F.max("value").alias("h3"), F.count("*").alias("n"))
    low, high = stats.heat_bounds(F.col("h1"), F.col("h2"), F.col("h3"), F.col("n"))
    return g.select("key", low.cast("long").alias("lower_bound"), high.cast("long").alias("upper_bound"))


_H58 = "(('0x' || substr(md5(user_id::VARCHAR), 1, 15))::BIGINT)"


@query(f"""WITH h AS (SELECT {_H58} AS h FROM events), r AS (SELECT h % 64 AS r, max(CASE WHEN h // 64 = 0 THEN 59 ELSE 58 - length(bin(h // 64)) + 1 END) AS k FROM h GROUP BY 1),
s AS (SELECT count(*) AS used, sum(pow(2.0, -k)) AS z FROM r), e AS (SELECT 0.709 * 64 * 64 / (z + 64 - used) AS raw, used FROM s)
SELECT round(CASE WHEN raw < 160 AND used < 64 THEN 64 * ln(64.0 / (64 - used)) ELSE raw END, 6) AS estimate FROM e""")
def distinct_estimate(spark, d):
    h = F.conv(F.substring(F.md5(F.col("user_id").cast("string")), 1, 15), 16, 10).cast("long")
    return stats.distinct_of_64(table(spark, d, "events"), h).select(F.round("estimate", 6).alias("estimate"))


@query("""WITH c AS (SELECT user_id AS row_id, event_type AS col, event_id AS ts, CAST(round(value * 100) AS BIGINT) AS value FROM events WHERE event_type <> 'error'),
t AS (SELECT user_id AS row_id, max(event_id) AS dead FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT row_id, col, max(ts) AS ts, arg_max(value, ts) AS value FROM c LEFT JOIN t USING (row_id) GROUP BY row_id, col HAVING coalesce(max(dead), -1) < max(ts)""")
def wide_row_merge(spark, d):
    return widerow.merge(*_cells(spark, d))


def _cells(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("row_id"), F.col("event_type").alias("col"), F.col("event_id").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("value"))
    return e.where("col <> 'error'"), e.where("col = 'error'").groupBy("row_id").agg(F.max("ts").alias("dead"))


@query("""WITH c AS (SELECT user_id AS row_id, event_type AS col, event_id AS ts, 3000 AS ttl, CAST(round(value * 100) AS BIGINT) AS value FROM events), n AS (SELECT max(event_id) AS now FROM events),
g AS (SELECT row_id, col, max(ts) AS ts, arg_max(value, ts) AS value, any_value(ttl) AS ttl FROM c GROUP BY 1, 2)
SELECT row_id, col, ts, CASE WHEN ts + ttl < now THEN 'tombstone' ELSE 'live' END AS kind, CASE WHEN ts + ttl >= now THEN value END AS value FROM g, n WHERE ts + ttl + 2000 >= now""")
def wide_row_ttl(spark, d):
    cells, _ = _cells(spark, d)
    e = table(spark, d, "events")
    cells = e.select(F.col("user_id").alias("row_id"), F.col("event_type").alias("col"), F.col("event_id").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("value"), F.lit(3000).alias("ttl"))
    now = e.agg(F.max("event_id")).first()[0]
    newest = cells.groupBy("row_id", "col").agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"), F.first("ttl").alias("ttl"))
    return widerow.expire(newest, now, 2000)


@query("""SELECT p_partkey AS key, lower(to_base(p_partkey, 16)) AS hexed, CASE WHEN length(p_name) >= 8 THEN substr(p_name, 1, 8) END AS fixed, substr(p_name, 1, 8) AS capped,
  starts_with(p_name, 'p') AS starts, ends_with(p_name, '1') AS ends, (p_partkey << 1) AS zigzag, p_partkey AS unzigzag, p_partkey AS number, (p_partkey * 1024) AS kilo FROM part""")
def scalar_strings(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    return p.select(
        k.alias("key"), F.lower(F.hex(k)).alias("hexed"), scalars.fixed_prefix(F.col("p_name"), 8).alias("fixed"), scalars.capped_prefix(F.col("p_name"), 8).alias("capped"),
        F.startswith("p_name", F.lit("p")).alias("starts"), F.endswith("p_name", F.lit("1")).alias("ends"), scalars.zigzag(k).alias("zigzag"), scalars.unzigzag(scalars.zigzag(k)).alias("unzigzag"),
        scalars.parse_number(k.cast("string")).alias("number"), scalars.parse_number(F.concat(k.cast("string"), F.lit("K"))).alias("kilo"),
    )


@query("""SELECT o_orderkey AS key, CASE WHEN o_orderkey < 128 THEN printf('%02X', o_orderkey) WHEN o_orderkey < 16384 THEN printf('%02X%02X', o_orderkey % 128 + 128, o_orderkey // 128)
  WHEN o_orderkey < 2097152 THEN printf('%02X%02X%02X', o_orderkey % 128 + 128, o_orderkey // 128 % 128 + 128, o_orderkey // 16384) END AS varint,
  printf('%02X%02X%02X', o_orderkey % 256, o_orderkey // 256 % 256, o_orderkey // 65536 % 256) || '0000000000' AS fixed, o_orderkey AS back FROM orders""")
def scalar_encoding(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("key"), scalars.varint_hex(k).alias("varint"), scalars.fixed64(k).alias("fixed"), scalars.unfixed64(scalars.fixed64(k)).alias("back"))


@query("""SELECT o_orderkey AS key, CASE WHEN o_orderkey < 10000 THEN o_orderkey::VARCHAR WHEN o_orderkey < 10000000 THEN (o_orderkey // 1000)::VARCHAR || 'K' ELSE (o_orderkey // 1000000)::VARCHAR || 'M' END AS number FROM orders""")
def scalar_formatting(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), scalars.human_number(F.col("o_orderkey")).alias("number"))
