"""Corpus pipeline: toxicity, near duplicates, benchmark decontamination, secrets, tokens.

Every stage works on all documents its predecessor kept, and its decisions take effect: the first three
drop rows, the fourth rewrites texts, the last one turns texts into ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, ngram_join, pieces, secret_scan, toxicity
from tidemark.llm._tables import drop, small_batches, tables, written
from tidemark.llm.queries import MODEL_PATH

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, docs: DataFrame | None, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return _table(spark, sf_dir, "documents") if docs is None else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold, all columns. A null or empty text is scored as one without words, equal texts
    go together, repeated rows each for themselves; without labels of both classes, and of an empty table, all rows stay."""
    return toxicity.drop(_documents(spark, docs, sf_dir), _table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id, all columns. Rows that share an id are one document and stay
    or go together; rows without an id, and of an id of its own those without text, all stay. An empty table stays empty."""
    docs = _documents(spark, docs, sf_dir)
    first = ngram_join.join(docs).filter("doc_id = component_id").select(F.col("doc_id").alias("first")).distinct()
    named = docs.filter(F.col("doc_id").isNotNull())
    # rows without an id are not joined: they would all meet in one partition
    return named.join(first, named["doc_id"] == first["first"], "left_semi").unionByName(docs.filter(F.col("doc_id").isNull()))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item, all columns. A null or empty text has none; equal texts go together; with an empty
    benchmark, and of an empty table, all rows stay."""
    return decontaminate.drop(_documents(spark, docs, sf_dir), _table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents and columns, secrets replaced; n_chars follows the text (and stays where there is none). Null and empty texts stay, equal
    rows stay equal."""
    docs = _documents(spark, docs, sf_dir)
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, n_chars of the decoded text, round_trip, a row for each row; null and empty texts have no ids."""
    return pieces.encode(_documents(spark, docs, sf_dir), MODEL_PATH)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("sentencepiece", tokenise),
]

#: SQL can't express the learned first stage; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the table documents, each written as Parquet and read again."""
    docs, before = _table(spark, sf_dir, "documents"), tables()
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        drop(spark, [t for t in tables()[:-1] if t not in before])  # what the stage itself needed, and its input
    return STAGES[-1][1](spark, docs, sf_dir)
