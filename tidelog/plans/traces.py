"""Operation-trace reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trace as T
from ..sources.shapes import operation_trace, table
from .register import TRACE, Register

query = Register()
QUERIES, SQL = query.queries, query.sql
_STATS = f"{TRACE}, st AS (SELECT type, cf, key, count(*) AS n, count(*) AS hits, sum(size)::BIGINT AS bytes, min(seq) AS first_seq FROM trace GROUP BY 1, 2, 3)"


def _trace(spark, d):
    return operation_trace(table(spark, d, "events"))


@query(f"WITH {TRACE}, w AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY seq) AS r FROM trace) SELECT type, cf, key, size, us, seq FROM w WHERE (r - 1) % 10 = 0")
def trace_sampled(spark, d):
    return T.sampled(_trace(spark, d), 10)


@query(f"WITH {_STATS} SELECT *, row_number() OVER (PARTITION BY type, cf ORDER BY key) - 1 AS key_id FROM st")
def trace_key_stats(spark, d):
    return T.key_ids(T.key_stats(_trace(spark, d)))


@query(f"WITH {_STATS} SELECT type, cf, n, count(*) AS keys FROM st WHERE n > 2 GROUP BY 1, 2, 3")
def trace_access_distribution(spark, d):
    return T.access_distribution(T.key_stats(_trace(spark, d)), 2)


def _dist(bucket: str) -> str:
    return f"""WITH {TRACE}, b AS (SELECT type, cf, {bucket} AS bucket, count(*) AS n FROM trace GROUP BY 1, 2, 3),
w AS (SELECT *, sum(n) OVER (PARTITION BY type, cf ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY type, cf) / 2.0 AS half FROM b) SELECT type, cf, bucket, n, (upto >= half AND upto - n < half) AS median FROM w"""


@query(_dist("length(key::VARCHAR)"))
def trace_key_sizes(spark, d):
    return T.size_distribution(_trace(spark, d), F.length(F.col("key").cast("string")))


@query(_dist("size // 8"))
def trace_value_sizes(spark, d):
    return T.size_distribution(_trace(spark, d), F.col("size"), 8)


@query(f"WITH {TRACE}, s AS (SELECT type, cf, count(*) AS n, sum(size)::DOUBLE AS s, sum(size * size)::DOUBLE AS q FROM trace GROUP BY 1, 2) SELECT type, cf, s / n AS mean, sqrt(greatest(0.0, q / n - (s / n) * (s / n))) AS deviation FROM s")
def trace_size_moments(spark, d):
    return T.size_moments(_trace(spark, d), F.col("size"))


@query(f"WITH {_STATS} SELECT type, cf, substr(key::VARCHAR, 1, 1) AS prefix, sum(n)::BIGINT AS n, count(*) AS keys, sum(n)::DOUBLE / count(*) AS per_key, sum(hits)::DOUBLE / sum(n) AS hit_share FROM st GROUP BY 1, 2, 3")
def trace_prefix_stats(spark, d):
    return T.prefix_stats(T.key_stats(_trace(spark, d)), 1)


@query(f"WITH {_STATS}, w AS (SELECT type, cf, key, n, row_number() OVER (PARTITION BY type, cf ORDER BY n DESC, key) AS place FROM st) SELECT * FROM w WHERE place <= 5")
def trace_top_keys(spark, d):
    return T.top(T.key_stats(_trace(spark, d)).select("type", "cf", "key", "n"), 5, F.col("n"), ["key"])


@query(f"WITH {_STATS}, p AS (SELECT type, cf, substr(key::VARCHAR, 1, 1) AS prefix, sum(n)::DOUBLE / count(*) AS per_key FROM st GROUP BY 1, 2, 3), w AS (SELECT *, row_number() OVER (PARTITION BY type, cf ORDER BY per_key DESC, prefix) AS place FROM p) SELECT * FROM w WHERE place <= 3")
def trace_top_prefixes(spark, d):
    return T.top(T.prefix_stats(T.key_stats(_trace(spark, d)), 1).select("type", "cf", "prefix", "per_key"), 3, F.col("per_key"), ["prefix"])


_HOURS = f"{TRACE}, hourly AS (SELECT type, cf, key, size, us // 3600 AS us, seq FROM trace)"


def _hourly(spark, d):
    """The trace with an hour as its second, so that the month of events has filled seconds."""
    return _trace(spark, d).withColumn("us", F.floor(F.col("us") / 3600))


_HSEC = f"{_HOURS}, hb AS (SELECT min(us) AS b, max(us) AS e FROM hourly), ht AS (SELECT hourly.*, (us - b) // 1000000 AS sec FROM hourly, hb)"


@query(f"""WITH {_HSEC}, g AS (SELECT type, cf, sec, count(*) AS n FROM ht GROUP BY 1, 2, 3), slots AS (SELECT type, cf, unnest(generate_series(0, (SELECT max(sec) FROM ht))) AS sec FROM (SELECT DISTINCT type, cf FROM g))
SELECT type, cf, sec, coalesce(n, 0) AS n FROM slots LEFT JOIN g USING (type, cf, sec)""")
def trace_qps(spark, d):
    return T.per_second(_hourly(spark, d))


@query(f"WITH {_HSEC}, g AS (SELECT type, cf, sec, count(*) AS n FROM ht GROUP BY 1, 2, 3) SELECT type, cf, max(n) AS peak, sum(n)::BIGINT AS total, sum(n)::DOUBLE / greatest((SELECT (e - b) // 1000000 FROM hb), 1) AS average FROM g GROUP BY 1, 2")
def trace_qps_peak(spark, d):
    return T.peak_and_average(_hourly(spark, d))


@query(f"""WITH {_HSEC}, p AS (SELECT type, cf, sec, substr(key::VARCHAR, 1, 1) AS prefix, count(*) AS n FROM ht GROUP BY 1, 2, 3, 4), s AS (SELECT type, cf, sec, sum(n)::BIGINT AS total FROM p GROUP BY 1, 2, 3),
w AS (SELECT *, row_number() OVER (PARTITION BY type, cf ORDER BY total DESC, sec) AS place FROM s) SELECT type, cf, place, sec, total, prefix, n FROM p JOIN w USING (type, cf, sec) WHERE place <= 3""")
def trace_busiest_seconds(spark, d):
    return T.busiest_seconds(_hourly(spark, d), 3, 1)


@query(f"""WITH {TRACE}, f AS (SELECT type, cf, key, min(sec) // 86400 AS slot FROM timed GROUP BY 1, 2, 3), g AS (SELECT type, cf, slot, count(*) AS new FROM f GROUP BY 1, 2, 3)
SELECT type, cf, slot, (sum(new) OVER w)::BIGINT AS keys, (sum(new) OVER w)::DOUBLE / sum(new) OVER (PARTITION BY type, cf) AS share FROM g WINDOW w AS (PARTITION BY type, cf ORDER BY slot)""")
def trace_unique_growth(spark, d):
    return T.unique_growth(_trace(spark, d), 86_400)


@query(f"""WITH {TRACE}, t AS (SELECT DISTINCT type AS first_type FROM trace), x AS (SELECT t.first_type, a.type AS second_type, a.us, max(CASE WHEN a.type = t.first_type THEN a.us END) OVER (PARTITION BY t.first_type, a.cf, a.key ORDER BY a.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM trace a, t)
SELECT first_type, second_type, count(*) AS n, sum(us - was)::DOUBLE / count(*) AS mean_gap_us FROM x WHERE was IS NOT NULL AND was <> us GROUP BY 1, 2""")
def trace_correlation(spark, d):
    return T.correlation(_trace(spark, d))


@query(f"WITH {_STATS}, k AS (SELECT type, cf, key, row_number() OVER (PARTITION BY type, cf ORDER BY key) - 1 AS key_id FROM st) SELECT seq, type, cf, sec, key_id FROM timed JOIN k USING (type, cf, key)")
def trace_time_series(spark, d):
    return T.time_series(_trace(spark, d))


@query(f"WITH {_STATS}, s AS (SELECT key, sum(n) AS n FROM st GROUP BY 1) SELECT c_custkey AS key, coalesce(n, 0)::BIGINT AS n FROM customer LEFT JOIN s ON key = c_custkey")
def trace_keyspace(spark, d):
    return T.keyspace_join(table(spark, d, "customer").select(F.col("c_custkey").alias("key")), T.key_stats(_trace(spark, d)))


@query(f"WITH {TRACE} SELECT cf, type, count(*) AS n, count(DISTINCT key) AS keys FROM trace GROUP BY ROLLUP (cf, type)")
def trace_summary(spark, d):
    return T.summary(_trace(spark, d))


@query(f"WITH {TRACE} SELECT seq, concat_ws(' ', lower(hex(key::VARCHAR)), type, cf::VARCHAR, size::VARCHAR, us::VARCHAR) AS line FROM trace")
def trace_readable(spark, d):
    return T.readable(_trace(spark, d))


@query(f"WITH {TRACE} SELECT seq, type, key, (us - b0) // 4 AS due_us FROM trace, began")
def trace_replay(spark, d):
    return T.replay_schedule(_trace(spark, d), 4)
