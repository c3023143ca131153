"""The corpus pipeline: five stages over ``documents``, each written and read again.

Every stage gives an empty result for an empty table, reads whole texts, and but for the last
returns the columns that it got, whatever they are called. What else it does with nulls, ties and
repeated rows is said in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import decontamination, line_dedup, ngram_jaccard, quality_rules, sequence_packing, toxicity
from tidewatch.llm.common import keep, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every quality rule lets pass, with a toxicity score fitted on the labels. A null
    text has no words and goes; a null doc_id or lang is judged by the text; repeated rows are judged alike."""
    return quality_rules.filter_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line repeats. Null texts and rows without a doc_id stay;
    rows with an equal doc_id do not remove each other's lines of the same number."""
    return line_dedup.dedup_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates, one row for each doc_id. Documents without
    words are in no group; rows without a doc_id stay."""
    return ngram_jaccard.first_of_each(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark. A null text has no words and stays; repeated rows are judged alike."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences. A null text is an empty one, of one
    token; repeated rows are packed one by one."""
    return sequence_packing.pack_documents(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_jaccard", near_duplicates), ("decontamination", decontaminate), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
