"""The registered queries of the corpus operators; their SQL is in ``sql``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language_id, licence_scan, line_dedup, lm_score, manifest, near_dup, packing, personal_data, pieces, quality, spelling, token_counts
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan.scan_licences(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents")).drop("text_key")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(personal_data.find_personal_data(table(spark, sf_dir, "documents")))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.digest(pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), model), model))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.digest(manifest.manifest(table(spark, sf_dir, "documents"), carry={"tampered": manifest.changed()}))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


_ALL = (op1_language_id, op2_licence_scan, op3_line_dedup, op4_packing, op5_quality_rules, op6_decontaminate, op7_personal_data, op8_near_dup, op9_lm_score, op10_token_counts, op11_sentencepiece, op12_manifest, op13_spelling_variants)
QUERIES = {f.__name__: f for f in _ALL}
