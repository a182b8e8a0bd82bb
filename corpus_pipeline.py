"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing and packing over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagesieve.llm import exact, langid, mixing, packing, simhash
from pagesieve.llm.common import drop_stored, stored, stored_tables, table


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; null texts and texts without letters go."""
    return langid.keep_known_languages(docs)


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact.drop_exact_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id stays."""
    return simhash.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 token ids."""
    return packing.pack(docs)


STAGES = [
    ("language ID", known_languages),
    ("exact dedup", without_exact_copies),
    ("near dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: Fingerprints, tokenizers and language models are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each on all that the one before it kept.

    Tables between the stages are deleted as soon as the next one is written. What the last stage has written stays for the
    result to be read from; ``pagesieve.llm.common.drop_stored`` deletes it.
    """
    docs = table(spark, sf_dir, "documents")
    before = stored_tables()
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs)
            drop_stored(spark, [t for t in stored_tables()[:-1] if t not in before])
    return docs
