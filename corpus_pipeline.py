"""A training-corpus pipeline: stages that each apply one operator to all documents that the stage before kept.

Cases, in every stage: columns beside doc_id, text, lang and source are carried along, whatever their names; texts of any length
are read whole; an empty table gives no rows; a null or repeated doc_id is an ordinary row but where a stage says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bomweave.llm import language_id, near_copies, packing, quality_rules
from bomweave.llm.common import materialize, table
from bomweave.llm.queries import TOKENIZER


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; the profiles are learned from the documents' own lang column.

    A null text, and one without letters, goes; repeated rows are judged each; without a lang to learn from, every document goes.
    """
    return language_id.keep(docs, language_id.learn(docs, language_id.may_learn()))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the fixed rules and the adaptive bounds of their language and source.

    A null text, and one of few words, goes; null lang or source is a group of its own; repeated rows are judged and count each.
    """
    return quality_rules.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, similarity 0.8; by SimHash, and minima beyond its radius): that of the smallest id.

    Texts without words, null ones too, are one group; rows without an id stay; of rows that repeat an id one stays, that of the
    least text.
    """
    return near_copies.one_of_each(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences.

    A null text is the end id alone; repeated rows are packed each.
    """
    return packing.pack(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("near_dedup", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: Hash votes and learned profiles have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
