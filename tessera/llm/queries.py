"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.byte_bpe import byte_bpe
from tessera.llm.collocations import SQL as COLLOCATIONS_SQL
from tessera.llm.collocations import collocations
from tessera.llm.decontaminate import find_leaks
from tessera.llm.license_scan import license_scan
from tessera.llm.lm_score import cross_entropy_difference
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.pii import find_pii
from tessera.llm.quality_classifier import quality_classifier
from tessera.llm.quality_rules import quality_rules
from tessera.llm.secret_scan import secret_scan
from tessera.llm.sentence_pieces import sentence_pieces
from tessera.llm.shared import shared_dir
from tessera.llm.source_divergence import SQL as DIVERGENCE_SQL
from tessera.llm.source_divergence import source_divergence
from tessera.llm.token_files import read_tokens, write_tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pretoken_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *(F.round(c, 6).alias(c) for c in ("p_document", "p_toxic", "p_path", "p_good")), "kept")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return read_tokens(spark, path)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), pretoken_pattern(), with_ids=False)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0").select("doc_id")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), target)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("detections")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), with_ids=False)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_pii, op3_token_files, op4_byte_bpe, op5_quality_rules, op6_lm_score, op7_secret_scan, op8_benchmark_leaks, op9_license_scan, op10_near_duplicates, op11_sentence_pieces, op12_source_divergence, op13_collocations)}


def oracle_sql() -> dict[str, str]:
    """Only these results can be had from SQL; tests/llm holds the others against brute force."""
    return {"op12_source_divergence": DIVERGENCE_SQL, "op13_collocations": COLLOCATIONS_SQL}
