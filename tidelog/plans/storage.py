"""Files and their properties, filters, backups, compaction picks, merges that stop or fail."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.merge import by_name
from ..operators import advisor, bloom, mvcc, pickers, ranges, workload
from ..sources import formats
from ..sources.scratch import new_path
from ..sources.shapes import event_log, file_stats, table
from .register import CUR, FILES, LOG, Register

query = Register()
QUERIES, SQL = query.queries, query.sql


def _log(spark, d):
    return event_log(table(spark, d, "events")).select("key", "seq", "op", "value")


@query(f"WITH {LOG} SELECT kind, count(*) AS n, sum(value)::BIGINT AS total, max(seq) AS newest FROM log, (VALUES ('csv'), ('json'), ('orc'), ('parquet')) k(kind) GROUP BY kind")
def table_formats(spark, d):
    log, parts = _log(spark, d), []
    for kind in ("parquet", "orc", "json", "csv"):
        path = new_path(spark)
        formats.write_table(log, path, kind, "zlib" if kind == "orc" else "gzip")
        parts.append(formats.read_table(spark, path, kind, log.schema).groupBy(F.lit(kind).alias("kind")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("seq").alias("newest")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"WITH {LOG} SELECT codec, count(*) AS n, sum(key)::BIGINT AS keys FROM log, (VALUES ('gzip'), ('lz4'), ('none'), ('snappy'), ('zstd')) k(codec) GROUP BY codec")
def file_compression(spark, d):
    out = None
    for codec in ("none", "snappy", "gzip", "lz4", "zstd"):
        path = new_path(spark)
        formats.write_sorted(_log(spark, d), path, files=2, codec=codec)
        row = formats.read_sorted(spark, path).groupBy(F.lit(codec).alias("codec")).agg(F.count("*").alias("n"), F.sum("key").alias("keys"))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"WITH {LOG} SELECT key, seq, op, value FROM log WHERE key % 3 = 1")
def export_import_family(spark, d):
    path = new_path(spark)
    formats.export_files(_log(spark, d).where("key % 3 = 1"), path)
    return formats.import_files(spark, path)


@query(f"WITH {LOG} SELECT 'OK' AS status, 4::BIGINT AS files, count(*) AS entries FROM log")
def verify_file_checksums(spark, d):
    """Stored sums against those of the files as they are."""
    path = new_path(spark)
    formats.export_files(_log(spark, d), path)
    met = formats.verify_files(spark, path).join(spark.read.parquet(f"{path}/manifest"), "file")
    return met.groupBy("status").agg(F.count("*").alias("files"), F.sum("entries").alias("entries"))


@query("SELECT sum(l_quantity)::BIGINT AS total, count(*) AS n, true AS skipped FROM lineitem WHERE l_orderkey < 1000")
def file_pruned_by_properties(spark, d):
    """Files whose stored key range cannot match are never opened."""
    path = new_path(spark)
    formats.export_files(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), "l_quantity"), path, files=8)
    rows, read, of = formats.read_pruned(spark, path, F.col("smallest") < 1000)
    return rows.where("key < 1000").agg(F.sum("l_quantity").cast("long").alias("total"), F.count("*").alias("n")).withColumn("skipped", F.lit(read < of))


@query(f"WITH {LOG}, t AS (SELECT max(seq) AS m FROM log) SELECT b::INT AS backup_id, count(*) AS n, sum(value)::BIGINT AS total FROM log, t, (VALUES (2), (3)) k(b) WHERE seq <= m * b // 4 GROUP BY b")
def backup_cycle(spark, d):
    """Three backups, of which the newest two are kept and restored."""
    root, log = new_path(spark), _log(spark, d)
    top = log.agg(F.max("seq")).first()[0]
    for i in (1, 2, 3):
        formats.backup(log.where(F.col("seq") <= top * i // 4), root, i)
    left = [formats.restore(spark, root, i).groupBy(F.lit(i).alias("backup_id")).agg(F.count("*").alias("n"), F.sum("value").alias("total")) for i in formats.purge(spark, root, 2)]
    return left[0].unionByName(left[1])


@query("SELECT (SELECT count(*) FROM part WHERE p_partkey % 2 = 0 AND p_partkey <= 500) AS present, 0::BIGINT AS missed, true AS few_false")
def bloom_filter(spark, d):
    """No key that a file holds is missed, and under 3 % of the others pass (10 bits a key, 6 probes)."""
    held = table(spark, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("key"), "p_brand")
    bits = 10 * (held.count() + 64)
    filters = bloom.build(held.withColumn("file", F.lit("f")), F.col("key"), bits, 6)
    asked = table(spark, d, "part").where("p_partkey <= 500").select(F.col("p_partkey").alias("key"))
    met = asked.join(bloom.may_match(filters, asked, F.col("key"), bits, 6).withColumn("_hit", F.lit(True)), "key", "left")
    even = F.col("key") % 2 == 0
    n = lambda c: F.sum(c.cast("long"))
    return met.agg(n(even).alias("present"), n(even & F.col("_hit").isNull()).alias("missed"), (n(~even & F.col("_hit").isNotNull()) <= F.greatest(n(~even) * 3 / 100, F.lit(3))).alias("few_false"))


@query("SELECT p_brand AS file, count(*) AS keys FROM part WHERE p_partkey <= 60 GROUP BY 1")
def bloom_prefix_filter(spark, d):
    """Files that may hold keys' prefixes, then looked up: as by an exact join."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("file"))
    filters = bloom.build(rows, F.col("key"), 1 << 14, 6)
    asked = rows.where("key <= 60").select("key")
    return bloom.may_match(filters, asked, F.col("key"), 1 << 14, 6).join(rows, ["key", "file"]).groupBy("file").agg(F.count("*").alias("keys"))


@query(f"WITH {FILES}, k AS (SELECT DISTINCT p_partkey AS key FROM part WHERE p_partkey % 7 = 0) SELECT k.key, count(*) AS candidates, max(CASE WHEN p.p_brand = file THEN file END) AS file FROM k JOIN files ON key BETWEEN smallest AND largest JOIN part p ON p.p_partkey = k.key GROUP BY k.key")
def two_level_lookup(spark, d):
    """Keys find the files whose range holds them, then the file that has them."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("home"))
    files = file_stats(table(spark, d, "part")).select("file", F.col("smallest").alias("b"), (F.col("largest") + 1).alias("e"))
    near = ranges.range_join(part.where("key % 7 = 0").select("key").distinct(), files, "key", "b", "e")
    return near.join(part, "key").groupBy("key").agg(F.count("*").alias("candidates"), F.max(F.when(F.col("home") == F.col("file"), F.col("file"))).alias("file"))


@query(f"""WITH {LOG}, base AS (SELECT key, max(seq) AS bs, CASE WHEN arg_max(op, seq) = 'PUT' THEN arg_max(value, seq) END AS bv FROM log WHERE op <> 'MERGE' GROUP BY key),
a AS (SELECT l.key, l.value, row_number() OVER (PARTITION BY l.key ORDER BY l.seq DESC) AS r FROM log l LEFT JOIN base USING (key) WHERE op = 'MERGE' AND (bs IS NULL OR l.seq > bs)),
f AS (SELECT key, count(*) AS n, sum(value) AS s FROM a WHERE r <= 3 GROUP BY key)
SELECT key, (CASE WHEN coalesce(n, 0) >= 3 THEN s ELSE coalesce(bv, 0) + coalesce(s, 0) END)::DECIMAL(20, 0) AS value FROM base FULL JOIN f USING (key) WHERE bv IS NOT NULL OR n > 0""")
def merge_short_circuit(spark, d):
    return mvcc.resolve_short(_log(spark, d), by_name("uint64add"), 3)


@query(f"WITH {LOG}, {CUR}, c AS (SELECT key, value % 900 AS v, key % 2 = 0 AS is_blob FROM cur) SELECT key, CASE WHEN is_blob AND o_orderkey IS NULL THEN 'Corruption' ELSE 'OK' END AS status, CASE WHEN is_blob THEN o_orderstatus ELSE v::VARCHAR END AS value FROM c LEFT JOIN orders ON is_blob AND o_orderkey = v")
def blob_values(spark, d):
    current = mvcc.latest(_log(spark, d)).select("key", (F.col("value") % 900).alias("value"), (F.col("key") % 2 == 0).alias("is_blob"))
    return mvcc.resolve_blobs(current, table(spark, d, "orders").select(F.col("o_orderkey").alias("blob"), F.col("o_orderstatus").alias("content")))


@query(f"""WITH {LOG}, base AS (SELECT key, max(seq) AS bs, CASE WHEN arg_max(op, seq) = 'PUT' THEN arg_max(value, seq) END AS bv FROM log WHERE op <> 'MERGE' GROUP BY key),
f AS (SELECT l.key, sum(l.value) AS s, bool_or(l.value % 11 = 0) AS bad FROM log l LEFT JOIN base USING (key) WHERE op = 'MERGE' AND (bs IS NULL OR l.seq > bs) GROUP BY l.key)
SELECT key, CASE WHEN bad THEN 'Corruption' ELSE 'OK' END AS status, CASE WHEN bad THEN NULL ELSE (coalesce(bv, 0) + coalesce(s, 0))::DECIMAL(20, 0) END AS value FROM base FULL JOIN f USING (key) WHERE bv IS NOT NULL OR s IS NOT NULL""")
def merge_failure(spark, d):
    return mvcc.resolve_checked(_log(spark, d), by_name("uint64add"), F.col("value") % 11 != 0)


_LEVELS = "lv AS (SELECT l_linenumber - 1 AS level, l_suppkey AS file, sum(l_quantity)::BIGINT AS bytes FROM lineitem GROUP BY 1, 2)"


def _levels(spark, d):
    return table(spark, d, "lineitem").groupBy((F.col("l_linenumber") - 1).alias("level"), F.col("l_suppkey").alias("file")).agg(F.sum("l_quantity").cast("long").alias("bytes"))


@query(f"WITH {_LEVELS} SELECT level, CASE WHEN level = 0 THEN count(*) / 4.0::DOUBLE ELSE sum(bytes) / (20000.0::DOUBLE * pow(2, level - 1)) END AS score FROM lv GROUP BY level")
def level_scores(spark, d):
    return pickers.level_scores(_levels(spark, d), 20_000, 2, 4)


@query(f"WITH {_LEVELS}, s AS (SELECT level, CASE WHEN level = 0 THEN count(*) / 4.0::DOUBLE ELSE sum(bytes) / (20000.0::DOUBLE * pow(2, level - 1)) END AS score FROM lv GROUP BY level), b AS (SELECT level FROM s WHERE score >= 1 ORDER BY score DESC, level LIMIT 1) SELECT level, file FROM lv WHERE level = (SELECT level FROM b) ORDER BY bytes DESC, file LIMIT 1")
def level_pick(spark, d):
    return pickers.level_pick(_levels(spark, d), 20_000, 2, 4)


_RUNS = "runs AS (SELECT month(l_shipdate)::INT - 1 AS run, sum(l_quantity)::BIGINT AS bytes FROM lineitem WHERE l_linenumber <= month(l_shipdate) GROUP BY 1)"


@query(f"WITH {_RUNS}, s AS (SELECT *, sum(bytes) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM runs), stop AS (SELECT min(run) AS r FROM s WHERE bytes * 100 > before * 120), p AS (SELECT run, bytes FROM s, stop WHERE r IS NULL OR run < r) SELECT * FROM p WHERE (SELECT count(*) FROM p) >= 2")
def universal_pick(spark, d):
    m = F.month("l_shipdate")
    return pickers.universal_pick(table(spark, d, "lineitem").where(F.col("l_linenumber") <= m).groupBy((m - 1).alias("run")).agg(F.sum("l_quantity").cast("long").alias("bytes")), 20, 2)


@query(f"WITH {FILES}, w AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY smallest, file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(bytes) OVER () AS total FROM files) SELECT min(smallest) AS \"begin\", sum(bytes)::BIGINT AS bytes FROM w GROUP BY floor(before * 4 / total)")
def subcompaction_ranges(spark, d):
    return pickers.subcompactions(file_stats(table(spark, d, "part")), 4)


@query(f"WITH {LOG} SELECT seq // 64 AS file, avg((op = 'DELETE')::INT) AS share FROM log GROUP BY 1 HAVING avg((op = 'DELETE')::INT) >= 0.25")
def delete_ratio_trigger(spark, d):
    return pickers.ratio_triggers(_log(spark, d).withColumn("file", F.floor(F.col("seq") / 64)), 0.25)


_RULES_FILE = ["# comment", '[Rule "stall"]', "suggestions=inc-buffers:slow", "conditions=stall-many", "", '[Condition "stall-many"]', "source=LOG", "regex=Stopping writes because of \\d+ = x", '[Suggestion "inc-buffers"]', "option=max_write_buffer_number", "action=increase"]


@query("""SELECT * FROM (VALUES ('Rule', 'stall', 'suggestions', 'inc-buffers:slow'), ('Rule', 'stall', 'conditions', 'stall-many'), ('Condition', 'stall-many', 'source', 'LOG'),
('Condition', 'stall-many', 'regex', 'Stopping writes because of \\d+ = x'), ('Suggestion', 'inc-buffers', 'option', 'max_write_buffer_number'), ('Suggestion', 'inc-buffers', 'action', 'increase')) t(kind, name, key, value)""")
def adv_rules_file(spark, d):
    return advisor.parse_rules_file(spark.createDataFrame(list(enumerate(_RULES_FILE)), "at long, line string"))


@query("SELECT o_orderkey AS n, o_orderkey AS varint_back, o_orderkey AS fixed_back, o_orderkey / 8.0::DOUBLE AS double_back, -(o_orderkey % 1000)::INT AS int_back, NULL::INT AS not_int, strftime(to_timestamp(o_orderkey * 1000) AT TIME ZONE 'UTC', '%Y/%m/%d-%H:%M:%S') AS shown FROM orders")
def scalar_decoding(spark, d):
    n = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        n.alias("n"), scalars.unvarint_hex(scalars.varint_hex(n)).alias("varint_back"), scalars.unfixed32(scalars.fixed32(n)).alias("fixed_back"),
        scalars.parse_double((n / 8.0).cast("string")).alias("double_back"), scalars.parse_int((-(n % 1000)).cast("string")).alias("int_back"),
        scalars.parse_int(F.concat(n.cast("string"), F.lit("x"))).alias("not_int"), scalars.human_time(n * 1000).alias("shown"),
    )


def _mix_check(ops, n, shares):
    """op, near: whether an operation's share of n draws is within 2 % of its part."""
    drawn = ops.groupBy("op").agg(F.count("*").alias("n"))
    return drawn.select("op", (F.abs(F.col("n") / n - F.element_at(F.create_map(*(x for k, v in shares.items() for x in (F.lit(k), F.lit(v)))), F.col("op"))) < 0.02).alias("near"))


def _ycsb(name, shares, distribution):
    def run(spark, d):
        return _mix_check(workload.operations(spark, 20_000, 1000, shares, distribution), 20_000, shares)

    run.__name__ = f"ycsb_{name}"
    query(" UNION ALL ".join(f"SELECT '{op}' AS op, true AS near" for op in shares))(run)


for _name, _shares, _distribution in (
    ("a", {"READ": 0.5, "UPDATE": 0.5}, "zipfian"), ("b", {"READ": 0.95, "UPDATE": 0.05}, "zipfian"), ("c", {"READ": 1.0}, "zipfian"),
    ("d", {"READ": 0.95, "INSERT": 0.05}, "latest"), ("e", {"SCAN": 0.95, "INSERT": 0.05}, "zipfian"), ("f", {"READ": 0.5, "READMODIFYWRITE": 0.5}, "uniform"),
):
    _ycsb(_name, _shares, _distribution)
