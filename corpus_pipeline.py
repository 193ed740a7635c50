"""The corpus pipeline: five operators in a row, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, written as Parquet and read
again as the next one's docs. All stages but the last give the columns of documents.

Every stage takes nulls in any column, empty and very long texts, repeated rows, an empty table and extra columns,
which stay as they are. What each does with them its docstring says; none drops rows for other reasons.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import exact_dedup, language_id, mixing, near_join, packing
from foliospark.llm.catalog import WEIGHTS
from foliospark.llm.runtime import discard, materialize, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no language's model fits go, as do null and empty texts. Repeated rows and rows without key, language or source are judged by their text alone; a text as costly in two languages is kept or not all the same."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the least doc_id stays (null last; ties: the least hash of all columns), one of fully repeated rows. Null texts are copies of nothing and stay."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays, with all of its repeated rows. Rows without doc_id, and texts without words, are near nothing and stay."""
    return near_join.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in fair-queueing order, as far as the budget of tokens goes. A null source is a source of its own, null texts have no tokens; ties go by a hash of the key, the key, and a hash of the row."""
    return mixing.Mixture(docs, WEIGHTS).rows()


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's pieces lie in the training sequences. Texts without tokens have no piece; a null source is a source; repeated rows never share a sequence; pieces of one size go by doc_id."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has neither the models, the sampled join nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
