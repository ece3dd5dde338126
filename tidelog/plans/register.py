"""A decorator that collects queries and their SQL."""

from __future__ import annotations

#: Common table expressions of the shapes in sources.shapes.
LOG = """log AS (SELECT user_id AS key, event_id AS seq, CASE WHEN event_type = 'error' THEN 'DELETE' WHEN event_type IN ('view', 'signup') THEN 'PUT' ELSE 'MERGE' END AS op,
  CAST(round(value * 100) AS BIGINT) AS value, ts FROM events)"""
SNAP = "snap AS (SELECT max(event_id) * 3 // 4 AS s FROM events)"
TOMB = "tomb AS (SELECT user_id AS b, user_id + 10 AS e, event_id AS tseq FROM events WHERE event_type = 'error' AND event_id % 50 = 0)"
CUR = "cur AS (SELECT key, arg_max(value, seq) AS value, max(seq) AS seq FROM log GROUP BY key HAVING arg_max(op, seq) <> 'DELETE')"
TRACE = """trace AS (SELECT event_type AS type, user_id % 4 AS cf, user_id AS key, length(props)::BIGINT AS size, epoch_us(ts) AS us, event_id AS seq FROM events),
began AS (SELECT min(us) AS b0, max(us) AS b1 FROM trace), timed AS (SELECT trace.*, (us - b0) // 1000000 AS sec FROM trace, began)"""
BLOCKS = """blk AS (SELECT l_partkey AS block, l_suppkey AS sst, l_linenumber::BIGINT AS level, l_returnflag AS bt, l_linestatus AS caller, l_quantity::BIGINT AS size,
  epoch(l_shipdate)::BIGINT AS sec, l_discount < 0.05 AS hit,
  row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS seq FROM lineitem)"""
SERIES = "series AS (SELECT user_id % 8 AS entity, event_type AS stat, ts::DATE AS day, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS value FROM events GROUP BY 1, 2, 3)"
FILES = "files AS (SELECT p_brand AS file, min(p_partkey) AS smallest, max(p_partkey) AS largest, count(*) AS n, sum(length(p_name) + length(p_type))::BIGINT AS bytes FROM part GROUP BY 1)"


class Register:
    def __init__(self):
        self.queries, self.sql = {}, {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add
