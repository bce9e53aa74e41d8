"""A corpus pipeline of five operators, each stage written and read again.

    toxicity -> quality rules -> MinHash near-dedup -> mixing to target weights -> packing
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import mixing, neardup, packing, quality, toxicity
from lectern.llm.common import saved, table

#: Without a contract, near-duplicates share 80 % of their five-word shingles.
SHINGLE, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below the limit.

    Null and empty texts have no features and stay, as does every text without toxic labels to learn from; equal rows
    have equal scores; null ids, long texts and further columns pass as they are; an empty table stays empty."""
    return toxicity.toxicity_filter(docs, table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the divergence tests.

    Null, empty and short texts fail the base rules and go; a null language is held against all references; equal rows
    get equal verdicts; null ids, long texts and further columns pass as they are; an empty table stays empty."""
    return quality.quality_filter(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates.

    Null and empty texts link with nothing and stay; of rows that repeat an id one stays; rows without an id all stay;
    further columns, whatever their names, pass as they are; an empty table stays empty."""
    return neardup.one_of_each(docs, SHINGLE, PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Null and empty texts have no words and are never taken; null sources are one source; repeated rows are documents of
    their own, and ties between them are broken alike in every run; further columns pass as they are; an empty table
    gives an empty mix."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of 2048 tokens.

    A null or empty text is its end token; repeated rows are packed one by one; null ids are packed like others; only
    texts of over 2048 tokens are cut; other columns are left out; an empty table gives no rows."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("minhash near-dedup", drop_near_duplicates),
    ("mixing to target weights", mix),
    ("best-fit packing", pack),
]

#: SQL can't express the trained stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents, each to the written rows of the one before."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, f"stage-{i}")
    return docs
