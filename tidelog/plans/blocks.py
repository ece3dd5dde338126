"""Block-cache trace reports and cache simulations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import simulate
from ..operators.ordering import positions
from ..sources.shapes import BLOCK_ORDER, block_trace, table
from .register import BLOCKS, Register

query = Register()
QUERIES, SQL = query.queries, query.sql
_COLUMNS = ["block", "sst", "level", "bt", "caller", "size", "sec", "hit"]
_DAY = 86_400


def _plain(spark, d):
    return block_trace(table(spark, d, "lineitem"))


def _ordered(spark, d):
    return positions(_plain(spark, d), BLOCK_ORDER, "seq").select(*_COLUMNS, "seq")


def _pct(n: str, d: str) -> str:
    return f"CASE WHEN ({d}) = 0 THEN -1.0::DOUBLE ELSE 100.0::DOUBLE * ({n}) / ({d}) END"


def _upper(v: str) -> str:
    return f"coalesce(list_min(list_filter({B.LIMITS}::BIGINT[], lambda x: x > {v})), {B.LIMITS[-1]}::BIGINT)"


_PER = f"{BLOCKS}, per AS (SELECT sst, bt, block, count(*) AS n, sum((NOT hit)::INT)::BIGINT AS misses, max(size) AS size, min(sec) AS first_sec, max(sec) AS last_sec FROM blk GROUP BY 1, 2, 3)"
_GAPS = f"{BLOCKS}, gaps AS (SELECT *, lag(sec) OVER (PARTITION BY block ORDER BY seq) AS before_sec FROM blk)"


@query(f"WITH {_PER} SELECT * FROM per")
def cache_block_stats(spark, d):
    return B.block_stats(_plain(spark, d))


@query(f"WITH {BLOCKS}, g AS (SELECT count(*) AS n, sum((NOT hit)::INT)::BIGINT AS m, sum((caller = 'O')::INT)::BIGINT AS un, sum((caller = 'O' AND NOT hit)::INT)::BIGINT AS um FROM blk) SELECT {_pct('m', 'n')} AS all_ratio, {_pct('um', 'un')} AS user_ratio FROM g")
def cache_miss_ratio(spark, d):
    return B.miss_ratio(_plain(spark, d), ["O"])


@query(f"WITH {BLOCKS}, g AS (SELECT caller, sec // {30 * _DAY} AS slot, count(*) AS n, sum((NOT hit)::INT)::BIGINT AS misses FROM blk GROUP BY 1, 2) SELECT *, {_pct('misses', 'n')} AS ratio FROM g")
def cache_miss_timeline(spark, d):
    return B.miss_timeline(_plain(spark, d), 30 * _DAY, ["caller"])


@query(f"WITH {BLOCKS}, c AS (SELECT block, count(*) AS n FROM blk GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY n DESC, block) AS place, count(*) OVER () AS labels, sum(n) OVER () AS a FROM c), s AS (SELECT *, CASE WHEN place <= labels // 100 THEN 1 WHEN place <= labels // 10 THEN 10 WHEN place <= labels // 2 THEN 50 ELSE 100 END AS slice FROM p) SELECT slice, count(*) AS labels, sum(n)::BIGINT AS n, {_pct('sum(n)', 'any_value(a)')} AS share FROM s GROUP BY slice")
def cache_skew(spark, d):
    return B.skew(_plain(spark, d), "block", [1, 10, 50, 100])


@query(f"WITH {BLOCKS} SELECT level, bt, sec // {30 * _DAY} AS slot, count(*) AS n FROM blk GROUP BY 1, 2, 3")
def cache_access_timeline(spark, d):
    return B.access_timeline(_plain(spark, d), 30 * _DAY, ["level", "bt"])


_DIST = f"{BLOCKS}, nx AS (SELECT seq, block, size, lag(seq) OVER (PARTITION BY block ORDER BY seq) AS prev, coalesce(lead(seq) OVER (PARTITION BY block ORDER BY seq), 1099511627776) AS nxt FROM blk)"


@query(f"WITH {_DIST}, g AS (SELECT a.seq, coalesce(sum(b.size), 0)::BIGINT AS distance FROM nx a LEFT JOIN nx b ON b.seq > a.prev AND b.seq < a.seq AND coalesce(b.prev, 0) <= a.prev WHERE a.prev IS NOT NULL GROUP BY a.seq), h AS (SELECT {_upper('distance')} AS bucket, count(*) AS n FROM g GROUP BY 1) SELECT *, 100.0::DOUBLE * n / sum(n) OVER () AS share FROM h")
def cache_reuse_distance(spark, d):
    return B.bucketed_share(B.reuse_distance(_ordered(spark, d)), "distance")


@query(f"WITH {_GAPS}, g AS (SELECT caller, {_upper('(sec - before_sec)')} AS bucket, count(*) AS n FROM gaps WHERE before_sec IS NOT NULL GROUP BY 1, 2) SELECT *, 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY caller) AS share FROM g")
def cache_reuse_interval(spark, d):
    return B.reuse_intervals(_ordered(spark, d), ("caller",))


@query(f"WITH {BLOCKS}, g AS (SELECT block, count(*) AS n, max(sec) - min(sec) AS life FROM blk GROUP BY 1) SELECT CASE WHEN n = 1 THEN -1 ELSE {_upper('life')} END AS bucket, count(*) AS n FROM g GROUP BY 1")
def cache_lifetime(spark, d):
    return B.lifetimes(_plain(spark, d))


@query(f"""WITH {BLOCKS}, s AS (SELECT min(sec) AS a, greatest((max(sec) - min(sec)) // 12, 1) AS u FROM blk), w AS (SELECT DISTINCT block, least((sec - a) // u, 11) AS w FROM blk, s)
SELECT x.w AS i, y.w AS j, count(*) AS blocks FROM w x JOIN w y ON x.block = y.block AND y.w >= x.w GROUP BY 1, 2""")
def cache_reuse_matrix(spark, d):
    return B.reuse_matrix(_plain(spark, d), 12)


@query(f"WITH {BLOCKS}, g AS (SELECT caller, level, count(*) AS n FROM blk GROUP BY 1, 2) SELECT *, 100.0::DOUBLE * n / sum(n) OVER () AS share FROM g")
def cache_access_share(spark, d):
    return B.access_share(_plain(spark, d), ["caller", "level"])


@query(f"WITH {BLOCKS} SELECT caller, level, bt, CASE WHEN level IS NULL THEN 2 ELSE 1 END::BIGINT AS kind, count(*) AS n FROM blk GROUP BY GROUPING SETS ((caller, level), (caller, bt))")
def cache_detailed_share(spark, d):
    return B.detailed_share(_plain(spark, d))


@query(f"WITH {_PER} SELECT bt, {_upper('n')} AS bucket, count(*) AS blocks FROM per GROUP BY 1, 2")
def cache_access_counts(spark, d):
    return B.access_count_summary(_plain(spark, d))


@query("""WITH b AS (SELECT l_partkey AS block, count(DISTINCT CASE WHEN l_discount < 0.08 THEN l_suppkey END) AS keys, sum((l_discount < 0.08)::INT) AS met, count(*) AS n, 40 AS total FROM lineitem GROUP BY 1)
SELECT least(10 * keys // total, 9)::BIGINT AS referenced, least(10 * met // n, 9)::BIGINT AS existing, count(*) AS blocks FROM b GROUP BY 1, 2""")
def cache_spatial(spark, d):
    t = table(spark, d, "lineitem").withColumn("block", F.col("l_partkey"))
    return B.spatial_locality(t, "l_suppkey", F.lit(40), F.col("l_discount") < 0.08)


@query(f"WITH {BLOCKS} SELECT seq, caller, block, row_number() OVER w - 1 AS past, sec - lag(sec) OVER w AS since, lead(sec) OVER w - sec AS until FROM blk WINDOW w AS (PARTITION BY caller, block ORDER BY seq)")
def cache_corr_features(spark, d):
    return B.correlation_features(_ordered(spark, d), "caller")


@query(f"WITH {BLOCKS}, p AS (SELECT bt, block, max(size) AS size FROM blk GROUP BY 1, 2) SELECT bt, count(*) AS blocks, sum(size)::BIGINT AS bytes, min(size) AS least, max(size) AS most FROM p GROUP BY ROLLUP (bt)")
def cache_block_sizes(spark, d):
    return B.block_sizes(_plain(spark, d))


@query(f"""WITH {BLOCKS}, c AS (SELECT bt, block, count(*) AS n FROM blk GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY bt ORDER BY n DESC, block) AS u, row_number() OVER (PARTITION BY bt ORDER BY n, block) AS w FROM c)
SELECT bt, 100.0::DOUBLE * sum(CASE WHEN u <= 50 THEN n ELSE 0 END) / sum(n) AS high_share, 100.0::DOUBLE * sum(CASE WHEN w <= 50 THEN n ELSE 0 END) / sum(n) AS low_share FROM r GROUP BY bt""")
def cache_end_shares(spark, d):
    return B.end_shares(_plain(spark, d), 50)


@query(f"WITH {BLOCKS} SELECT bt, count(*) AS n, sum(hit::INT)::BIGINT AS existing, sum((NOT hit)::INT)::BIGINT AS missing, {_pct('sum(hit::INT)', 'count(*)')} AS existing_share FROM blk GROUP BY bt")
def cache_data_block_stats(spark, d):
    g = _plain(spark, d).groupBy("bt").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("existing"), F.sum((~F.col("hit")).cast("long")).alias("missing"))
    return g.withColumn("existing_share", B.percent(F.col("existing"), F.col("n")))


@query(f"WITH {BLOCKS} SELECT level, bt, caller, count(*) AS n, sum((NOT hit)::INT)::BIGINT AS misses FROM blk GROUP BY ROLLUP (level, bt, caller)")
def cache_rollup(spark, d):
    return B.rollup_summary(_plain(spark, d))


@query(f"WITH {BLOCKS} SELECT seq, block, row_number() OVER (PARTITION BY block ORDER BY seq) >= 2 AS admitted FROM blk")
def sim_ghost_admission(spark, d):
    return simulate.second_sight(_ordered(spark, d))


def _sim(spark, d):
    return _ordered(spark, d).withColumn("high", F.col("bt") == "N")


@query()
def sim_policies(spark, d):
    return simulate.simulate(_sim(spark, d), [(p, c) for p in simulate.POLICIES for c in (2_000, 10_000)])


@query()
def sim_policy_timeline(spark, d):
    return simulate.simulate(_sim(spark, d), [("lru", 4_000), ("arc", 4_000)], shards=4, slot=90 * _DAY)


@query()
def sim_downsampled(spark, d):
    return simulate.simulate(_sim(spark, d), [("lru", 16_000), ("opt", 16_000)], sample=4)


@query(f"WITH {_DIST}, g AS (SELECT a.seq, count(b.seq) AS distance FROM nx a LEFT JOIN nx b ON b.seq > a.prev AND b.seq < a.seq AND b.nxt >= a.seq WHERE a.prev IS NOT NULL GROUP BY a.seq) SELECT c::BIGINT AS capacity, (SELECT count(*) FROM nx) - (SELECT count(*) FROM g WHERE distance < c) AS misses FROM (VALUES (50), (200), (800), (1600)) k(c)")
def cache_mrc(spark, d):
    """LRU misses by capacity in blocks, all from one pass of reuse distances."""
    t = _ordered(spark, d).withColumn("size", F.lit(1).cast("long"))
    return simulate.lru_curve(B.reuse_distance(t), t.count(), [50, 200, 800, 1600])
