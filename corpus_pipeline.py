"""The corpus pipeline: language ID, toxicity, SimHash near-dedup, best-fit packing.

Each stage works on all that the one before kept. All but the last return the columns of documents;
rows that a stage rejects are gone for the next. Columns of other names are passed on, empty tables
give empty tables, and models are learned from the labelled documents of the table folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import language_id, packing, simhash, toxicity
from tallyloom.llm.common import staged, table
from tallyloom.llm.queries import language_models, tokenizer_file, toxicity_network


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language is rejected; those without a letter are."""
    return language_id.accepted(docs, language_models(spark, sf_dir))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score as toxic."""
    return toxicity.accepted(docs, toxicity_network(spark, sf_dir))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id."""
    return simhash.one_of_each(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return packing.packed(docs, tokenizer_file("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("language_id", known_language), ("toxicity", not_toxic), ("simhash", no_near_copies), ("packing", sequences)]

#: SQL can express neither the models nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
