"""The registered queries of this package, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from guardlake.llm import decontaminate, langid, line_dedup, media, near_dedup, packing, pii, quality, substring_dedup, warc
from guardlake.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack(table(spark, sf_dir, "documents")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_digests(table(spark, sf_dir, "pages"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(pii.find_pii(table(spark, sf_dir, "documents")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_spans(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_sentences", "n_removed", "sources")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.parse_audio(media.encode_texts(table(spark, sf_dir, "documents"))))


def queries() -> dict:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_packing": op2_packing,
        "op3_warc": op3_warc,
        "op4_pii": op4_pii,
        "op5_quality": op5_quality,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_near_dedup": op7_near_dedup,
        "op8_language_id": op8_language_id,
        "op9_decontamination": op9_decontamination,
        "op10_media_columns": op10_media_columns,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.oracle_sql(), "op3_warc": warc.oracle_sql(), "op7_near_dedup": near_dedup.oracle_sql(3, 85)}
