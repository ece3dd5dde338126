"""Times within a second of a boundary, against SQL, which rounds them."""

import datetime

import duckdb
import pytest
from compare import check

from tidelog.plans import catalog

#: Halves below and above even and odd seconds, and what is next to them.
NEAR = [s * 1_000_000 + us for s in (-2, -1, 0, 1) for us in (0, 1, 300_000, 499_999, 500_000, 500_001, 999_999)]


def events(spark, folder, micros: list[int], props: int):
    rows = [(i, datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=us), i % 3, ("view", "click", "error")[i % 3], 1.0 + i, "x" * (props + i)) for i, us in enumerate(micros)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", ["blob_fifo_eviction", "blob_ttl_buckets"])
def test_buckets_of_expiry_equal_sql(spark, tmp_path, name):
    borders = [(21_600 * n - 3600 - 60 * u) * 1_000_000 for n in (78_981, 78_982) for u in range(3)]
    con = events(spark, tmp_path, [b + us for us in NEAR for b in borders], 400)
    check(catalog.queries()[name](spark, str(tmp_path)), con, catalog.oracle_sql()[name])


@pytest.mark.parametrize("newest", [0, 400_000, 500_000, 600_000, 1_500_000])
def test_ttl_equals_sql(spark, tmp_path, newest):
    now = 1_706_000_000 * 1_000_000
    con = events(spark, tmp_path, [now - 864_000 * 1_000_000 + us for us in NEAR] + [now, now + newest], 8)
    check(catalog.queries()["compact_ttl"](spark, str(tmp_path)), con, catalog.oracle_sql()["compact_ttl"])
