"""Rules over metric series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import advisor as A
from ..sources.shapes import metric_series, table
from .register import SERIES, Register

query = Register()
QUERIES, SQL = query.queries, query.sql


def _series(spark, d):
    s = metric_series(table(spark, d, "events"))
    return s.select("entity", "stat", F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long").alias("ts"), "value")


_T = f"{SERIES}, s AS (SELECT entity, stat, day - DATE '1970-01-01' AS ts, value FROM series)"


def _burst_sql(stat: str) -> str:
    return f"SELECT entity, stat, ts, rate FROM (SELECT *, (value - lag(value, 2) OVER w) * 100.0::DOUBLE / lag(value, 2) OVER w * 1 / (ts - lag(ts, 2) OVER w) AS rate FROM s WINDOW w AS (PARTITION BY entity, stat ORDER BY ts)) WHERE rate >= 20{stat}"


@query(f"WITH {_T} {_burst_sql('')}")
def adv_burst(spark, d):
    return A.burst(_series(spark, d), 2, 20.0, 1, True, F.col("ts"))


@query(f"WITH {_T} SELECT entity, stat, arg_max(value, ts)::DOUBLE AS value FROM s GROUP BY 1, 2")
def adv_latest(spark, d):
    return A.aggregate(_series(spark, d), "latest")


@query(f"WITH {_T} SELECT entity, stat, avg(value)::DOUBLE AS value FROM s GROUP BY 1, 2")
def adv_average(spark, d):
    return A.aggregate(_series(spark, d), "avg")


@query(f"WITH {_T}, w AS (SELECT entity, ts, max(value) FILTER (stat = 'click') AS click, max(value) FILTER (stat = 'error') AS error FROM s GROUP BY 1, 2) SELECT entity, ts FROM w WHERE click > error and click + error > 1000")
def adv_expression(spark, d):
    return A.expression(_series(spark, d), "click > error and click + error > 1000", ["click", "error"])


@query(f"WITH {_T}, b AS ({_burst_sql('')}), p AS (SELECT x.entity, x.ts AS t1, y.ts AS t2, row_number() OVER (PARTITION BY x.entity ORDER BY x.ts, y.ts) AS r FROM b x JOIN b y ON x.entity = y.entity AND x.stat = 'error' AND y.stat = 'click' AND abs(x.ts - y.ts) <= 3) SELECT entity, t1, t2 FROM p WHERE r = 1")
def adv_overlap(spark, d):
    b = A.burst(_series(spark, d), 2, 20.0, 1, True, F.col("ts"))
    return A.overlap(b.where("stat = 'error'"), b.where("stat = 'click'"), 3, "ts")


@query(f"WITH {_T}, b AS ({_burst_sql('')}) SELECT entity FROM b WHERE stat = 'error' INTERSECT SELECT entity FROM b WHERE stat = 'view' INTERSECT SELECT entity FROM s WHERE stat = 'click' AND value > 10000")
def adv_rule(spark, d):
    s = _series(spark, d)
    b = A.burst(s, 2, 20.0, 1, True, F.col("ts"))
    return A.rule([b.where("stat = 'error'"), b.where("stat = 'view'"), s.where("stat = 'click' AND value > 10000")])


@query(f"WITH {_T} SELECT entity, stat, ts, value - coalesce(lag(value) OVER (PARTITION BY entity, stat ORDER BY ts), 0) AS value FROM s")
def adv_delta(spark, d):
    return A.deltas(_series(spark, d))


_LINES = "lines AS (SELECT user_id % 8 AS entity, event_id AS ts, event_type || ' COUNT : ' || (event_id % 977) AS line FROM events)"


def _lines(spark, d):
    e = table(spark, d, "events")
    return e.select((F.col("user_id") % 8).alias("entity"), F.col("event_id").alias("ts"), F.concat("event_type", F.lit(" COUNT : "), (F.col("event_id") % 977).cast("string")).alias("line"))


@query(f"WITH {_LINES} SELECT entity, count(*) AS n, min(ts) AS first_ts FROM lines WHERE regexp_matches(line, '^error.*[05]$') GROUP BY 1")
def adv_log_condition(spark, d):
    return A.log_condition(_lines(spark, d), r"^error.*[05]$")


@query(f"WITH {_LINES} SELECT entity, ts, regexp_extract(line, '^(\\w+)', 1) AS stat, regexp_extract(line, '(\\d+)$', 1)::BIGINT AS value FROM lines")
def adv_log_statistics(spark, d):
    return A.parse_statistics(_lines(spark, d))


@query("WITH o AS (SELECT c_nationkey AS entity, max(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS a, max(c_acctbal) FILTER (c_mktsegment = 'MACHINERY') AS b FROM customer GROUP BY 1) SELECT entity FROM o WHERE a > b and b > 0")
def adv_options(spark, d):
    o = table(spark, d, "customer").select(F.col("c_nationkey").alias("entity"), F.col("c_mktsegment").alias("option"), F.col("c_acctbal").alias("value"))
    return A.options_condition(o, "BUILDING > MACHINERY and MACHINERY > 0", ["BUILDING", "MACHINERY"])
