"""The corpus pipeline: five of the operators of tidelog.llm, one after the other.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), is written as
Parquet and read again as the next one's docs. Rows that a stage keeps have the columns of
documents, whatever their names; the last stage returns ids and digests of the encoded texts.

Defined results of every stage: null and empty texts have no words (they are clean, copies of nothing and
encode to no ids) and stay; null ids stay; repeated rows are judged each, and as copies of each other one stays;
columns beside doc_id and text are carried unread, also where they are named like something a stage computes;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, decontaminate, jaccard, linededup, toxicity
from tidelog.llm.registry import BPE_RANKS
from tidelog.llm.store import cut

#: Documents of this score and more are toxic.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity (4): documents that it rejects go; texts without words score as an empty sentence, and a column named score or predicted stays as it is."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (9): one document of each group stays, of repeated rows the first; all texts without words stay."""
    return jaccard.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup (5): repeated lines and passages are cut out of the texts, whose rows all stay; n_chars, where there is one, follows a changed text."""
    same = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]  # so that no name of docs is replaced
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    found = linededup.dedup(docs.select(*same), at["doc_id"], at["text"])
    counted = F.when(F.col("n_removed") > 0, F.length(at["text"])).otherwise(F.col(at["n_chars"])).cast(docs.schema["n_chars"].dataType) if "n_chars" in at else None
    return found.select(*(counted.alias(c) if c == "n_chars" else F.col(at[c]).alias(c) for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (1): contaminated documents go; texts without words are clean."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE encoding and decoding (8): doc_id, n_tokens, ids_sha256, decoded_sha256, token_ids; a null text encodes as an empty one."""
    return bpe.encode_digest(docs.select("doc_id", "text"), BPE_RANKS, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", decontaminated),
    ("bpe_encoding", encoded),
]

#: Training a classifier, components and tokenizers are beyond SQL; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each but the last is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
