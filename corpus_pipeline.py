"""The corpus pipeline: toxicity, language ID, MinHash near-dedup, packing.

Every stage keeps the columns of documents but the last, whatever further ones docs has, and takes nulls in any of them,
empty tables, repeated rows and texts of any length: a null or empty text has no toxic word and stays in the first stage,
has no letter and goes in the second; rows without an id are judged by their text alone and are never merged; a repeated row
stays once after near-dedup; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boardlake.llm.language_id import known_language
from boardlake.llm.minhash import first_of_each
from boardlake.llm.packing import pack
from boardlake.llm.shared import forget, scratch, stored
from boardlake.llm.toxicity import clean_documents
from boardlake.sources.tables import table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches 0.7 go."""
    return clean_documents(docs, table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter or lie far from every language."""
    return known_language(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (Jaccard similarity 0.80 or more) stays: that of the smallest doc_id."""
    return first_of_each(docs, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in batches of optimal length buckets."""
    return pack(docs)


STAGES = [("toxicity", toxicity_stage), ("language_id", language_stage), ("minhash_near_dedup", dedup_stage), ("packing", packing_stage)]

#: The stages learn models and verify near-duplicates, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are stored and read again, and what a stage has stored and read goes when they are."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as made:
            after = stored(stage(spark, docs, sf_dir), name)
            made.remove(after.stored_at)
        forget(docs)
        docs = after
    # the last stage's tables stay, as its rows are yet to be read; it has read its documents
    packed = STAGES[-1][1](spark, docs, sf_dir)
    forget(docs)
    return packed
