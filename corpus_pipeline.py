"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import minhash, mixing, packing, pii, quality_rules
from loomgraph.llm.queries import tokenizer_path
from loomgraph.session import keep, long_texts, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; documents labelled good are what to resemble.

    Null and empty texts fail; repeated rows pass or fail together; without labels the base rules alone decide; an
    empty table stays empty. Further columns are carried, here and in all stages but the last.
    """
    long_texts(spark)
    trusted = quality_rules.trusted_rows(docs, table(spark, sf_dir, "labels").where("quality = 1"))
    return quality_rules.passing(docs, trusted)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one of the least doc_id, null ids last; repeated rows once."""
    long_texts(spark)
    return minhash.without_copies(docs)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced; a null text stays null, repeated rows are rewritten alike."""
    long_texts(spark)
    return pii.sanitise(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, by training position; empty texts once."""
    long_texts(spark)
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents with their sequences and offsets; a null text is the end token alone.

    Sequences are filled as well as can be, so the order of the mix holds for the rows it hands on, not for sequences.
    """
    long_texts(spark)
    return packing.packed(docs, tokenizer_path())


STAGES = [("quality_rules", rules), ("minhash", near_duplicates), ("pii", personal), ("mixing", mixed), ("packing", packed)]
#: The near-duplicate stage and the tokenizer can't be said in SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
