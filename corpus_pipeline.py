"""From raw documents to packed training sequences: the stages in order."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strideframe.llm import decontaminate, line_dedup, near_dup, packing, quality
from strideframe.llm.common import DOCUMENT_COLUMNS, cut, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and empty texts are among them.

    Repeated rows go or stay together. Further columns of ``docs`` are dropped.
    """
    return quality.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of long runs of lines are cut out of the texts; every document stays.

    Null texts stay null; one that only repeats becomes empty. Repeated rows change alike.
    """
    return line_dedup.dedup_lines(docs).select(*DOCUMENT_COLUMNS)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of smallest doc_id.

    Null and wordless texts are like nothing and stay. Repeated rows stay together.
    """
    return near_dup.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go; null and wordless texts have none and stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, cut into full training sequences; ids as little-endian 16-bit numbers.

    A null or empty text is its end id alone. Repeated rows are packed each.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Quantile sketches, hashed signatures and tokenizer ids are beyond SQL; tests/llm compares
#: the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is materialised for the next.

    Texts of any length are handled whole, and an empty table gives no sequences.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
