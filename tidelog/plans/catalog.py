"""All queries of the engine and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import admin, advisor, blocks, compaction, functions, reads, storage, traces, workloads

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (reads, compaction, functions, traces, blocks, advisor, workloads, admin, storage)


def queries() -> dict[str, Query]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
