"""The corpus pipeline: language ID, toxicity, near-dedup, packing.

Each stage takes all documents that its predecessor kept, as rows of the
``documents`` columns, and all but the last give such rows. Documents that a
stage rejects are gone for those after it. Null and empty texts count as
rejected by language ID (no letters); an empty table stays empty; of other
columns than those of ``documents`` none is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfathom.llm import langid, packing, simhash, toxicity
from inkfathom.llm.common import fold, spool, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; it learns from their own lang column."""
    docs = docs.select(*COLUMNS)
    found = langid.identify(docs, ~langid.held_out(), keep=COLUMNS[2:])
    return found.where(~F.col("rejected")).select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic; it learns from ``labels``."""
    docs = docs.select(*COLUMNS)
    found = toxicity.classify(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1, keep=COLUMNS[2:])
    return found.where("predicted = 0").select(*COLUMNS)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near copies (five-word shingles alike to about
    0.8, by wide fingerprints), any one if none has an id."""
    return simhash.keep_one(docs.select(*COLUMNS), edited=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, as ``packing.pack`` gives them."""
    return packing.pack(docs)


STAGES = [("language_id", language), ("toxicity", clean), ("near_dedup", unique), ("packing", packed)]

#: Learned models cannot be expressed in SQL; the tests hold each stage against its definition in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
