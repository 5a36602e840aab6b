"""From raw documents to packed training sequences, in stages that each read what the last one wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.line_dedup import drop_recurring_lines
from lodestone.llm.near_dedup import drop_near_duplicates, near_duplicates
from lodestone.llm.packing import pack_texts
from lodestone.llm.pii import mask_pii
from lodestone.llm.quality import keep_quality
from lodestone.llm.shared import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read more like the raw corpus than like the trusted part go.

    A null, empty or very short text stays, whatever its doc_id; equal rows stay or go together; an
    empty table stays empty; further columns pass through.
    """
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates are taken out of the texts, and documents that lose all their lines go.

    A group of near copies counts as one document here, so that they keep the same lines: which of them
    stays is the next stage's decision. A null or empty text stays as it is; a null doc_id is a document
    of its own; equal rows are treated alike; an empty table stays empty; further columns pass through.
    """
    return drop_recurring_lines(docs, copies=near_duplicates(docs), keep_emptied=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least doc_id.

    Rows with a null doc_id and texts without a word are in no group and stay; of rows that repeat a
    doc_id one stays; an empty table stays empty; further columns pass through.
    """
    return drop_near_duplicates(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers are masked.

    Every row stays; a null text stays null and an empty one empty; equal rows are masked alike; an empty
    table stays empty; further columns pass through.
    """
    return mask_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(pack_id, place, doc_id, part, first_word, n_words, text): the pieces of the packed sequences.

    Texts without a word (null, empty, blank) have no piece; a long text has several; repeated rows are
    packed each; a null doc_id stays null; an empty table gives none; further columns are left out.
    """
    return pack_texts(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("pii", pii),
    ("packing", packing),
]
#: Near copies are grouped by hashed signatures and connected components, and packing fits counts by
#: least squares: SQL has neither, so tests/llm holds the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to documents; each result is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
