"""From raw documents to packed training sequences: five stages, each written and read again.

All stages but the last return the columns of documents, whatever they are called. Defined results: a row is its doc_id and its
text; a null doc_id names no document, but the row is judged by its text like any other; rows that repeat both doc_id and text are
copies. A null text counts as empty. Texts of any length are taken whole. An empty table gives no rows."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import DataFrame, SparkSession

from flowlab.llm.common import settle
from flowlab.llm.exact_dedup import drop_copies
from flowlab.llm.langid import drop_undetermined
from flowlab.llm.packing import pack_documents
from flowlab.llm.secret_scan import redact
from flowlab.llm.simhash import drop_near_copies


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found: null texts and texts without a letter go, with or without a doc_id. Where no
    language could be learned, all others stay."""
    return drop_undetermined(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with one text, that with the largest doc_id (a null one is the smallest); of rows that repeat it, one."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (sets of five-word shingles with a Jaccard similarity of 0.8 or more, and what is linked through them) the
    document with the smallest doc_id (a null one comes last), on a tie that with the smallest digest."""
    return drop_near_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark, of overlapping ones all together."""
    return redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows with their sequence and place; a row without a doc_id is packed too. Equally long pieces are
    packed in a fixed order."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language), ("exact_dedup", exact), ("simhash_near_dedup", near), ("secret_scan", secrets), ("best_fit_packing", packed)]

#: SQL has neither suffix automata nor the tokenizer; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents: one row per piece of what is kept. Each stage's result is written and read again by the
    next; what a stage has written on its way is deleted when it has ended."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(spark, lambda: stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
