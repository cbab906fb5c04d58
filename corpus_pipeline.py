"""The corpus pipeline: five stages over ``documents``, each one operator of the llm subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.byte_bpe import byte_bpe
from tessera.llm.decontaminate import drop_leaks
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.quality_classifier import quality_classifier
from tessera.llm.queries import pretoken_pattern, table, tokenizer_path
from tessera.llm.secret_scan import redact_secrets
from tessera.llm.shared import materialise, shared_dir


def named(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are judged as empty ones, and repeated rows alike. Columns of any name stay; an empty table
    stays empty.
    """
    rows = docs.select(F.struct(*named(docs)).alias("row"), "doc_id", "text", "source", "lang")
    return quality_classifier(rows, table(spark, sf_dir, "labels"), carry=("row",)).filter("kept").select("row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one of the smallest id.

    Documents without words or without an id are no one's duplicates and stay; rows that repeat an id are one
    document, and stay or go together. Columns of any name stay; an empty table stays empty.
    """
    gone = near_duplicates(docs.select("doc_id", "text"), 80).filter("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(named(docs))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay; repeated rows are judged alike. Columns of any name stay; an empty table,
    or one of items, changes nothing.
    """
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; all documents stay, and n_chars follows the text.

    Null texts stay null, repeated rows are masked alike. Columns of any name stay; an empty table stays empty.
    """
    return redact_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids, a row for each document: doc_id, n_tokens, digests, round_trip and ids.

    A null text has no ids, like an empty one; other columns end here; an empty table stays empty.
    """
    return byte_bpe(docs, tokenizer_path("byte_bpe_50k.tiktoken"), pretoken_pattern())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_good),
    ("near_dedup", keep_one_of_each),
    ("decontamination", drop_benchmark_leaks),
    ("secret_scan", mask_secrets),
    ("byte_bpe", encode),
]

#: No SQL expresses a fitted classifier, shingle links or BPE merges; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again by the next."""
    folder = shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), folder, name)
    return docs
