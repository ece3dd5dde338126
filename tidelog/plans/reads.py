"""Reads: gets, scans, MVCC resolution, merges, range deletes, overlays, conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.merge import by_name, stringappend, user
from ..operators import mvcc, overlay, ranges, scan
from ..sources.shapes import event_log, event_tombstones, file_stats, table
from .register import CUR, FILES, LOG, SNAP, TOMB, Register

query = Register()
QUERIES, SQL = query.queries, query.sql


def _log(spark: SparkSession, d: str) -> DataFrame:
    return event_log(table(spark, d, "events"))


def _snapshot(spark: SparkSession, d: str, numerator: int = 3) -> int:
    """A fixed fraction of the newest sequence number."""
    return table(spark, d, "events").agg(F.max("event_id")).first()[0] * numerator // 4


@query(f"WITH {LOG} SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM log GROUP BY key HAVING arg_max(op, seq) <> 'DELETE'")
def mvcc_latest(spark, d):
    return mvcc.latest(_log(spark, d))


@query(f"WITH {LOG}, {SNAP} SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM log, snap WHERE seq <= s GROUP BY key HAVING arg_max(op, seq) <> 'DELETE'")
def mvcc_snapshot(spark, d):
    return mvcc.latest(_log(spark, d), _snapshot(spark, d))


@query(f"WITH {LOG} SELECT key, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM log WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' GROUP BY key")
def mvcc_time_travel(spark, d):
    return scan.versions_between(_log(spark, d), F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz"), False)


@query(f"WITH {LOG} SELECT key, seq, op, value FROM log WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'")
def time_travel_all_versions(spark, d):
    return scan.versions_between(_log(spark, d), F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz"), True)


_FOLD = """base AS (SELECT key, max(seq) AS bs, CASE WHEN arg_max(op, seq) = 'PUT' THEN arg_max(value, seq) END AS bv FROM {v} WHERE op <> 'MERGE' GROUP BY key),
after AS (SELECT l.key, l.seq, l.value FROM {v} l LEFT JOIN base USING (key) WHERE op = 'MERGE' AND (bs IS NULL OR l.seq > bs)),
folded AS (SELECT key, {agg} AS m FROM after GROUP BY key)"""


def _merge_sql(agg: str, result: str, v: str = "log", more: str = "") -> str:
    return f"WITH {LOG}{more}, {_FOLD.format(v=v, agg=agg)} SELECT key, {result} AS value FROM base FULL JOIN folded USING (key) WHERE bv IS NOT NULL OR m IS NOT NULL"


@query(_merge_sql("sum(value)", "(coalesce(bv, 0) + coalesce(m, 0))::DECIMAL(20, 0)"))
def merge_uint64add(spark, d):
    return mvcc.resolve(_log(spark, d), by_name("uint64add"))


@query(_merge_sql("max(value)", "CASE WHEN bv IS NULL THEN m WHEN m IS NULL THEN bv ELSE greatest(bv, m) END"))
def merge_max(spark, d):
    return mvcc.resolve(_log(spark, d), by_name("max"))


@query(_merge_sql("arg_max(value, seq)", "coalesce(m, bv)"))
def merge_put(spark, d):
    return mvcc.resolve(_log(spark, d), by_name("put"))


@query(_merge_sql("string_agg(value::VARCHAR, ',' ORDER BY seq)", "concat_ws(',', bv::VARCHAR, m)"))
def merge_stringappend(spark, d):
    return mvcc.resolve(_log(spark, d), stringappend(","))


@query(_merge_sql("array_to_string(list_sort(list(value)), ',')", "coalesce(m, bv::VARCHAR)"))
def merge_sortlist(spark, d):
    return mvcc.resolve(_log(spark, d), by_name("sortlist"))


@query(_merge_sql("bit_xor(value)", "xor(coalesce(bv, 0), coalesce(m, 0))"))
def merge_bytesxor(spark, d):
    return mvcc.resolve(_log(spark, d), by_name("bytesxor"))


@query(_merge_sql("min(value)", "CASE WHEN bv IS NULL THEN m WHEN m IS NULL THEN bv ELSE least(bv, m) END"))
def merge_user_least(spark, d):
    return mvcc.resolve(_log(spark, d), user("least", lambda a, x: F.least(a, x)))


@query(_merge_sql("sum(value)", "(coalesce(bv, 0) + coalesce(m, 0))::DECIMAL(20, 0)", "vis", f", {SNAP}, vis AS (SELECT log.* FROM log, snap WHERE seq <= s)"))
def merge_at_snapshot(spark, d):
    return mvcc.resolve(_log(spark, d), by_name("uint64add"), _snapshot(spark, d))


@query(f"""WITH {LOG}, lb AS (SELECT key, max(seq) AS bs FROM log WHERE op <> 'MERGE' GROUP BY key),
x AS (SELECT l.key, l.seq, l.op, l.value FROM log l LEFT JOIN lb USING (key) WHERE (op = 'MERGE' AND (bs IS NULL OR seq > bs)) OR (op = 'PUT' AND seq = bs))
SELECT key, CASE WHEN count(*) > 8 THEN 'Incomplete' ELSE 'OK' END AS status, CASE WHEN count(*) <= 8 THEN list(value ORDER BY seq DESC) END AS operands, count(*) AS n FROM x GROUP BY key""")
def get_merge_operands(spark, d):
    return mvcc.operands(_log(spark, d), 8)


@query(f"WITH {LOG}, {CUR} SELECT key, seq, value FROM cur WHERE key = 7")
def point_get(spark, d):
    return scan.get(mvcc.latest(_log(spark, d).where("key = 7")), 7)


_KEYS = "keys AS (SELECT c_custkey AS pos, c_custkey * 3 AS key FROM customer)"


def _keys(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("pos"), (F.col("c_custkey") * 3).alias("key"))


@query(f"WITH {LOG}, {CUR}, {_KEYS} SELECT pos, key, CASE WHEN cur.seq IS NULL THEN 'NotFound' ELSE 'OK' END AS status, value FROM keys LEFT JOIN cur USING (key)")
def multi_get(spark, d):
    return scan.multi_get(mvcc.latest(_log(spark, d)), _keys(spark, d))


@query(f"""WITH {LOG}, {CUR}, {_KEYS}, g AS (SELECT pos, key, cur.seq IS NOT NULL AS f, value, coalesce(length(value::VARCHAR), 0) AS z FROM keys LEFT JOIN cur USING (key)),
r AS (SELECT *, sum(z) OVER (ORDER BY pos) - z AS before FROM g)
SELECT pos, key, CASE WHEN before > 100 THEN 'Aborted' WHEN f THEN 'OK' ELSE 'NotFound' END AS status, CASE WHEN before <= 100 THEN value END AS value FROM r""")
def multi_get_size_cap(spark, d):
    return scan.multi_get_capped(mvcc.latest(_log(spark, d)), _keys(spark, d), 100, F.length(F.col("value").cast("string")))


@query(f"WITH {LOG}, {CUR}, {_KEYS} SELECT key, cur.seq IS NOT NULL AS may_exist FROM keys LEFT JOIN cur USING (key)")
def key_may_exist(spark, d):
    return scan.may_exist(mvcc.latest(_log(spark, d)), _keys(spark, d).select("key"))


@query(f"WITH {LOG}, {CUR} SELECT key, value FROM cur")
def full_scan(spark, d):
    return scan.scan(mvcc.latest(_log(spark, d)).select("key", "value"))


@query(f"WITH {LOG}, {CUR} SELECT key, value FROM cur ORDER BY key DESC LIMIT 20")
def reverse_scan_topn(spark, d):
    return scan.scan(mvcc.latest(_log(spark, d)).select("key", "value"), limit=20, reverse=True)


@query(f"WITH {LOG}, {CUR} SELECT key, value FROM cur WHERE key >= 5 ORDER BY key LIMIT 10")
def seek_first_n(spark, d):
    return scan.seek(mvcc.latest(_log(spark, d)).select("key", "value"), 5, 10)


@query(f"WITH {LOG}, {CUR} SELECT key, value FROM cur WHERE key <= 9 ORDER BY key DESC LIMIT 3")
def seek_for_prev(spark, d):
    return scan.seek_for_prev(mvcc.latest(_log(spark, d)).select("key", "value"), 9, 3)


@query(f"WITH {LOG}, {CUR}, {_KEYS} SELECT k.key, c.key AS found FROM keys k ASOF LEFT JOIN cur c ON k.key >= c.key")
def asof_prev(spark, d):
    return scan.seek_for_prev_each(mvcc.latest(_log(spark, d)), _keys(spark, d).select("key"))


@query(f"WITH {LOG}, {CUR} SELECT key, value FROM cur WHERE key >= 5 AND key < 100")
def range_scan(spark, d):
    return scan.scan(mvcc.latest(_log(spark, d)).select("key", "value"), 5, 100)


@query(f"WITH {LOG}, {CUR} SELECT key, value FROM cur WHERE key::VARCHAR LIKE '1%'")
def prefix_scan(spark, d):
    return scan.scan(mvcc.latest(_log(spark, d)).select("key", "value"), prefix="1")


@query(f"WITH {LOG}, {CUR} SELECT key FROM cur WHERE key < 50")
def keys_only_scan(spark, d):
    return scan.scan(mvcc.latest(_log(spark, d)), upper=50, keys_only=True)


@query(f"WITH {LOG}, {SNAP} SELECT key % 3 AS cf, key, arg_max(value, seq) AS value FROM log, snap WHERE seq <= s GROUP BY key HAVING arg_max(op, seq) <> 'DELETE'")
def multi_family_scan(spark, d):
    return scan.multi_family(_log(spark, d), F.col("key") % 3, _snapshot(spark, d))


@query(f"WITH {LOG}, {SNAP} SELECT key, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM log GROUP BY key HAVING max(seq) >= (SELECT s FROM snap)")
def incremental_scan(spark, d):
    return scan.incremental(_log(spark, d), _snapshot(spark, d))


@query(f"WITH {LOG}, {SNAP} SELECT key, seq, op, value, ts FROM log, snap WHERE seq >= s")
def updates_since(spark, d):
    return scan.updates_since(_log(spark, d), _snapshot(spark, d))


@query("SELECT l_returnflag AS file, sum(l_orderkey)::BIGINT AS total FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1")
def file_pruned_scan(spark, d):
    return table(spark, d, "lineitem").where("l_returnflag <> 'N'").groupBy(F.col("l_returnflag").alias("file")).agg(F.sum("l_orderkey").alias("total"))


_RANGES = "rng AS (SELECT n_nationkey * 7 AS b, n_nationkey * 7 + 20 AS e FROM nation)"


def _ranges(spark, d):
    return table(spark, d, "nation").select((F.col("n_nationkey") * 7).cast("long").alias("begin"), (F.col("n_nationkey") * 7 + 20).cast("long").alias("end"))


@query(f'WITH {LOG}, {CUR}, {_RANGES} SELECT b::BIGINT AS "begin", e::BIGINT AS "end", count(key) AS n, coalesce(sum(length(value::VARCHAR)), 0)::BIGINT AS bytes FROM rng LEFT JOIN cur ON key >= b AND key < e GROUP BY b, e')
def approximate_sizes(spark, d):
    return scan.approximate_sizes(mvcc.latest(_log(spark, d)), _ranges(spark, d), F.length(F.col("value").cast("string")))


@query(f'WITH {LOG}, {SNAP}, {_RANGES}, t AS (SELECT log.* FROM log, snap WHERE seq > s) SELECT b::BIGINT AS "begin", e::BIGINT AS "end", count(key) AS n, coalesce(sum(length(value::VARCHAR)), 0)::BIGINT AS bytes FROM rng LEFT JOIN t ON key >= b AND key < e GROUP BY b, e')
def memtable_stats(spark, d):
    return scan.approximate_sizes(_log(spark, d).where(F.col("seq") > _snapshot(spark, d)), _ranges(spark, d), F.length(F.col("value").cast("string")))


@query(f"WITH {LOG} SELECT op, count(*) AS entries, sum((op = 'DELETE')::INT)::BIGINT AS deletions, sum(length(key::VARCHAR))::BIGINT AS raw_key_size, sum(length(value::VARCHAR))::BIGINT AS raw_value_size, max(seq) AS newest FROM log GROUP BY op")
def table_properties(spark, d):
    k, v = F.length(F.col("key").cast("string")), F.length(F.col("value").cast("string"))
    return _log(spark, d).groupBy("op").agg(F.count("*").alias("entries"), F.sum((F.col("op") == "DELETE").cast("long")).alias("deletions"), F.sum(k).alias("raw_key_size"), F.sum(v).alias("raw_value_size"), F.max("seq").alias("newest"))


@query(f"WITH {LOG} SELECT greatest(sum(CASE WHEN op = 'DELETE' THEN -1 ELSE 1 END), 0)::BIGINT AS estimate, count(*) AS entries FROM log")
def estimate_num_keys(spark, d):
    return _log(spark, d).agg(F.greatest(F.sum(F.when(F.col("op") == "DELETE", -1).otherwise(1)), F.lit(0)).cast("long").alias("estimate"), F.count("*").alias("entries"))


@query(f"WITH {LOG} SELECT op, count(*) AS n, sum(('0x' || substr(md5(concat_ws('|', key, seq, value)), 1, 12))::BIGINT)::DECIMAL(38, 0) AS fingerprint FROM log GROUP BY op")
def verify_checksum(spark, d):
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in ("key", "seq", "value")))), 1, 12), 16, 10).cast("decimal(20,0)")
    return _log(spark, d).groupBy("op").agg(F.count("*").alias("n"), F.sum(h).cast("decimal(38,0)").alias("fingerprint"))


_DEAD = "dead AS (SELECT DISTINCT l.key, l.seq FROM log l JOIN tomb ON l.key >= b AND l.key < e AND tseq > l.seq)"


@query(f"""WITH {LOG}, {TOMB}, {_DEAD}, vis AS (SELECT l.key, l.seq, CASE WHEN dd.seq IS NULL THEN op ELSE 'DELETE' END AS op, CASE WHEN dd.seq IS NULL THEN value END AS value FROM log l LEFT JOIN dead dd ON l.key = dd.key AND l.seq = dd.seq),
{_FOLD.format(v="vis", agg="sum(value)")} SELECT key, (coalesce(bv, 0) + coalesce(m, 0))::DECIMAL(20, 0) AS value FROM base FULL JOIN folded USING (key) WHERE bv IS NOT NULL OR m IS NOT NULL""")
def range_delete(spark, d):
    return mvcc.resolve(_log(spark, d), by_name("uint64add"), None, event_tombstones(table(spark, d, "events")))


@query(f"""WITH {TOMB}, p AS (SELECT b AS x FROM tomb UNION SELECT e FROM tomb), q AS (SELECT x AS f, lead(x) OVER (ORDER BY x) AS t FROM p)
SELECT f AS "begin", t AS "end", list_reverse_sort(list(DISTINCT tseq)) AS seqs FROM q JOIN tomb ON b <= f AND e > f WHERE t IS NOT NULL GROUP BY f, t""")
def tombstone_fragments(spark, d):
    return ranges.fragments(event_tombstones(table(spark, d, "events")))


@query(f"""WITH {LOG}, cutoff AS (SELECT max(seq) * 95 // 100 AS c FROM log), o AS (SELECT key, arg_max(value, seq) AS value FROM log, cutoff WHERE seq <= c GROUP BY key HAVING arg_max(op, seq) <> 'DELETE'),
n AS (SELECT key, arg_max(op, seq) AS op, arg_max(value, seq) AS v FROM log, cutoff WHERE seq > c GROUP BY key)
SELECT key, CASE WHEN n.op IS NULL THEN value ELSE v END AS value FROM o FULL JOIN n USING (key) WHERE n.op IS NULL OR n.op <> 'DELETE'""")
def overlay_join(spark, d):
    log = _log(spark, d)
    c = log.agg(F.max("seq")).first()[0] * 95 // 100
    return overlay.overlay(mvcc.latest(log, c), log.where(F.col("seq") > c))


@query(_merge_sql("sum(value)", "(coalesce(bv, 0) + coalesce(m, 0))::DECIMAL(20, 0)").replace("SELECT key, (coalesce", "SELECT keys.key, (coalesce").replace("FROM base FULL JOIN folded USING (key) WHERE bv IS NOT NULL OR m IS NOT NULL", "FROM base FULL JOIN folded USING (key) RIGHT JOIN (SELECT c_custkey * 3 AS key FROM customer) keys USING (key)").replace("(coalesce(bv, 0) + coalesce(m, 0))::DECIMAL(20, 0)", "CASE WHEN bv IS NOT NULL OR m IS NOT NULL THEN (coalesce(bv, 0) + coalesce(m, 0))::DECIMAL(20, 0) END"))
def overlay_get(spark, d):
    log = _log(spark, d)
    c = log.agg(F.max("seq")).first()[0] * 95 // 100
    return overlay.overlay_get(log.where(F.col("seq") <= c), log.where(F.col("seq") > c), _keys(spark, d).select("key"), by_name("uint64add"))


@query(f"WITH {LOG}, {SNAP}, t AS (SELECT key, min(seq) AS seq FROM log, snap WHERE seq >= s GROUP BY key) SELECT t.key, t.seq, max(l.seq) AS written_at FROM t JOIN log l ON l.key = t.key AND l.seq > t.seq GROUP BY 1, 2")
def txn_conflicts(spark, d):
    log = _log(spark, d)
    tracked = log.where(F.col("seq") >= _snapshot(spark, d)).groupBy("key").agg(F.min("seq").alias("seq"))
    return overlay.conflicts(tracked, log)


@query(f"""WITH {LOG}, p AS (SELECT o_custkey % 150 AS key, o_orderkey % (SELECT max(seq) FROM log) AS at_seq FROM orders),
a AS (SELECT p.key, p.at_seq, l.seq, l.op, l.value FROM p ASOF LEFT JOIN log l ON p.key = l.key AND p.at_seq >= l.seq)
SELECT key, at_seq AS "at", CASE WHEN op <> 'DELETE' THEN seq END AS seq, CASE WHEN op <> 'DELETE' THEN value END AS value FROM a""")
def asof_snapshot(spark, d):
    log = _log(spark, d)
    top = log.agg(F.max("seq")).first()[0]
    probes = table(spark, d, "orders").select((F.col("o_custkey") % 150).alias("key"), (F.col("o_orderkey") % top).alias("at"))
    return overlay.as_of_snapshot(probes, log)


@query("""WITH RECURSIVE w AS (SELECT user_id AS waiter, max(event_id) % (SELECT count(DISTINCT user_id) FROM events) AS holder FROM events WHERE event_type = 'error' GROUP BY 1),
r AS (SELECT waiter, holder FROM w UNION SELECT r.waiter, w.holder FROM r JOIN w ON r.holder = w.waiter) SELECT waiter AS txn FROM r WHERE waiter = holder""")
def deadlock_cycles(spark, d):
    e = table(spark, d, "events")
    n = e.agg(F.countDistinct("user_id")).first()[0]
    return overlay.deadlocked(e.where("event_type = 'error'").groupBy(F.col("user_id").alias("waiter")).agg((F.max("event_id") % n).alias("holder")))


@query(f'WITH {FILES}, rng AS (SELECT n_nationkey * 70 AS b, n_nationkey * 70 + 30 AS e FROM nation) SELECT b::BIGINT AS "begin", e::BIGINT AS "end", file, smallest, largest, n, bytes FROM rng JOIN files ON smallest < e AND largest >= b')
def file_overlap(spark, d):
    r = table(spark, d, "nation").select((F.col("n_nationkey") * 70).cast("long").alias("begin"), (F.col("n_nationkey") * 70 + 30).cast("long").alias("end"))
    return ranges.overlapping(file_stats(table(spark, d, "part")), r)


_COMMITS = "SELECT user_id % 500 AS txn, max(event_id) AS commit_seq FROM events WHERE event_type = 'purchase' GROUP BY 1"


@query(f"WITH {SNAP}, c AS ({_COMMITS}) SELECT event_id AS seq, user_id % 500 AS txn FROM events, snap WHERE user_id % 500 IN (SELECT txn FROM c WHERE commit_seq <= s)")
def committed_only(spark, d):
    e = table(spark, d, "events")
    commits = e.where("event_type = 'purchase'").groupBy((F.col("user_id") % 500).alias("txn")).agg(F.max("event_id").alias("commit_seq"))
    return overlay.committed(e.select(F.col("event_id").alias("seq"), (F.col("user_id") % 500).alias("txn")), commits, _snapshot(spark, d))


_MARKS = "SELECT event_id % 1000 AS txn, CASE event_type WHEN 'view' THEN 'prepare' WHEN 'purchase' THEN 'commit' WHEN 'error' THEN 'rollback' END AS mark FROM events"


@query(f"WITH m AS ({_MARKS}) SELECT txn, CASE WHEN bool_or(mark = 'commit') THEN 'committed' WHEN bool_or(mark = 'rollback') THEN 'rolled back' ELSE 'in doubt' END AS state FROM m GROUP BY txn HAVING bool_or(mark = 'prepare')")
def two_phase_state(spark, d):
    t = F.col("event_type")
    mark = F.when(t == "view", "prepare").when(t == "purchase", "commit").when(t == "error", "rollback")
    return overlay.two_phase(table(spark, d, "events").select((F.col("event_id") % 1000).alias("txn"), mark.alias("mark")))
