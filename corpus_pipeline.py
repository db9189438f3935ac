"""The corpus pipeline: stages over `documents`, each written and read again as the next one's input.

All stages but the last return the columns of documents.  A stage only acts on
what its predecessor kept.  Null in any column, empty texts, repeated rows,
empty tables and more columns are taken as each stage says; columns of other
names come through as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from regspark.llm.common import table, written
from regspark.llm.decontaminate import decontaminated
from regspark.llm.near_copies import one_of_alike
from regspark.llm.packing import pack_sequences
from regspark.llm.pii import pseudonyms
from regspark.llm.quality_model import accepted


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored as texts of no bytes.  All rows of a doc_id
    go if one of them is rejected; those with a null id can't be matched to a
    verdict and stay.  With fewer than two labelled rows of a class the share
    of label 1 decides on all, and without labels all stay.
    """
    return accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word Jaccard similarity 0.8 or more) the document with the least id stays.

    Texts without words, null ones too, are copies of each other; repeated rows
    are one; rows with a null id can't be told apart and stay.
    """
    return one_of_alike(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every passage that a benchmark item shares; a document of nothing else goes.

    Null and empty texts stay as they are; every row is cut by its own text.
    """
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put surrogates for personal data; null and empty texts stay as they are, equal mentions get equal surrogates in all rows."""
    return pseudonyms(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into training sequences, one row per piece; null and empty texts are a closing id alone, repeated rows are packed each."""
    return pack_sequences(docs)


STAGES = [
    ("quality classifier", reject_poor),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", remove_benchmark),
    ("PII surrogates", replace_personal_data),
    ("packing", pack),
]

#: SQL can't express the tokenizer and the models; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
