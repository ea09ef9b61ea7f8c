"""The registered queries of the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tripleflow.llm import (
    chat_format,
    exact_dedup,
    html_extract,
    line_dedup,
    packing,
    quality,
    resampling,
    sentencepiece_codec,
    simhash,
    spelling,
    suffix_dedup,
    token_files,
    toxicity,
)
from tripleflow.llm.common import documents

END_ID = 2


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_codec.round_trip_digests(
        documents(spark, folder), tokenizer_file("piece_bpe_32k.model")
    )


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.dedup(documents(spark, folder))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return toxicity.toxic_documents(documents(spark, folder), labels)


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(documents(spark, folder))


def op5_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract(spark.read.parquet(f"{folder}/pages.parquet"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pieces_with_digest(
        documents(spark, folder), tokenizer_file("word_bpe_49k.json"), END_ID
    )


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, folder))


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_report(documents(spark, folder))


def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.removal_digests(documents(spark, folder))


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_file_round_trip(
        documents(spark, folder), tokenizer_file("byte_bpe_50k.json"), END_ID
    )


def op11_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.group_variants(documents(spark, folder))


def op13_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return chat_format.round_trip_digests(chat_format.with_probe(spark.read.parquet(f"{folder}/conversations.parquet")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_html_extract": op5_html_extract,
    "op6_packing": op6_packing,
    "op7_simhash": op7_simhash,
    "op8_line_dedup": op8_line_dedup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_token_files": op10_token_files,
    "op11_resampling": op11_resampling,
    "op12_spelling": op12_spelling,
    "op13_chat_format": op13_chat_format,
}
SQL = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op11_resampling": resampling.ORACLE,
    "op12_spelling": spelling.ORACLE,
    "op13_chat_format": chat_format.ORACLE,
}
