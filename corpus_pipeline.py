"""The corpus pipeline: five stages, each one operator applied to all that the stage before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
one's docs. All but the last return the columns of their docs, extra ones too, whatever their names; the last returns packed
pieces. Each takes an empty table, nulls in any column, and repeated rows, and says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfsight.llm.base import staged, table
from shelfsight.llm.exact_dedup import drop_copies
from shelfsight.llm.mixing import mixed_documents
from shelfsight.llm.packing import pack_documents
from shelfsight.llm.simhash import drop_near_copies
from shelfsight.llm.toxicity import drop_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay; the classifier is trained on the labelled rows of `docs`.

    A null text scores as an empty one; rows of a null doc_id are scored but never trained on. Repeated rows have one score. Where
    `labels` has not both classes for `docs`, all texts have one score, so all stay or all go: see `train`.
    """
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, the one with the smallest doc_id stays.

    A null text is an empty one. A null doc_id stays only where no row of the text has another; of repeated rows one stays.
    """
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints within two bits, the one with the smallest doc_id stays.

    Texts without words, null ones too, have fingerprint zero and are linked like any other. Rows that the stage before leaves have
    distinct texts; whole rows that repeat would stay or go together.
    """
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come near their target words.

    A null source is a source. Texts without words, null ones too, are left out, as the mix takes none of their words.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, every token of every row once; row_id tells rows of one document apart. A null text is one end id."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: A trained classifier and a tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every stage but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return last(spark, docs, sf_dir)
