import pytest
from pyspark.sql import functions as F


@pytest.fixture
def stored(spark, tmp_path):
    """Write rows as a Parquet table and read it, as operators get their tables."""

    def store(rows, schema, name="documents"):
        path = str(tmp_path / f"{name}{len(list(tmp_path.iterdir()))}.parquet")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        return spark.read.parquet(path)

    return store


@pytest.fixture
def awkward(stored):
    """Documents with nulls in any column, empty and long texts, repeated rows and ids, and clashing extra columns."""
    long = " ".join(f"word{i % 997}" for i in range(60_000))
    rows = [
        (1, "one two three four five six seven", "a", 1.0, 5), (1, "one two three four five six seven", "a", 1.0, 5), (2, None, "a", None, None), (3, "", None, 2.0, 1),
        (None, "Is a null id. And more words here.", "b", 0.0, 2), (4, " \n\t ", "b", 0.0, 2), (5, long, "c", 0.5, 3), (6, "x" * 100_000, "c", 0.5, 3), (7, "naïve 日本語 😀 text", "c", 0.5, 3), (1, "another text under one id", "c", 0.5, 3),
    ]
    return stored(rows, "doc_id long, text string, source string, score double, shard int")


@pytest.fixture
def nothing(stored):
    return stored([], "doc_id long, text string, source string, score double, shard int", "empty").where(F.lit(True))
