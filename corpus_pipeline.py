"""A corpus pipeline of five stages: quality, near copies, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet and reads it as the next one's docs.
In all stages an empty table gives an empty one, a null text counts as empty, texts of any length are read whole, and a row
with a null doc_id is a document of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import mixing, ngram_join, packing, pii, quality
from quire.llm._base import cut, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, learned from the labels of those among them, accepts.

    Empty texts get the score of no features. Without labels of both kinds every score is 0.5, and all documents stay.
    """
    return quality.classified(docs, table(spark, sf_dir, "labels")).filter("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the least doc_id. Texts without words link with nothing and stay; of rows that repeat a doc_id one stays."""
    return ngram_join.deduplicated(docs).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their spans of personal data replaced; a null text becomes an empty one."""
    return pii.redacted(docs).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken; the last of a source is cut. A null source is one of its own. Documents without words are in no mix."""
    return mixing.mixed(docs).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in the sequences; documents that the mix repeats are packed as often."""
    return packing.packed(docs)


STAGES = [("quality", quality_filter), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("packing", packing_stage)]
#: The classifier and the tokenizer can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
