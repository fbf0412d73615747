"""The corpus pipeline: each stage reads what the one before it has kept, and its decisions take effect.

A stage is ``(spark, docs, sf_dir) -> DataFrame``; all but the last return the columns of ``documents``.

Defined results: null and empty texts are not toxic; of copies one stays; documents without words are in no mix and so
leave at that stage; very long texts are read whole and cut into pieces by the last stage; rows that repeat doc_id and
text are one document from the second stage on; rows without doc_id are told apart by their texts and never dropped as
near copies; ties are settled as the operators' docstrings say; an empty table gives an empty result at every stage;
further columns, whatever their names, are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm._shared import discard, table, temporary, written
from sparkloom.llm.exact_dedup import drop_copies
from sparkloom.llm.mixing import mixed_documents
from sparkloom.llm.ngram_join import one_of_each_group
from sparkloom.llm.packing import pack_documents
from sparkloom.llm.queries import tokenizer
from sparkloom.llm.toxicity import clean_documents


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    return clean_documents(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by the n-gram Jaccard join the one with the smallest doc_id."""
    return one_of_each_group(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents as often as the mix takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, placed in sequences."""
    return pack_documents(docs, tokenizer())


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", near_dedup),
    ("mixing", mixing),
    ("best_fit_packing", packing),
]

#: Trained classifiers, random draws and bin packing have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with temporary() as made:
            docs, path = written(stage(spark, docs, sf_dir), name)
        discard(spark, *before, *(p for p in made if p != path))  # nothing reads the stage's input and own tables any more
        before = [path]
    return docs
