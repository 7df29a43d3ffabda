"""The corpus pipeline: stages that filter, deduplicate, mix and pack ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bound_packing, line_edit_join, simhash_bk, source_mixing, subsequence_svm
from quarry.llm.queries import fold
from quarry.llm.runtime import Workspace


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; all others stay as they are.

    A null or empty text, and a null id, are clean; repeated rows go or stay together; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return subsequence_svm.keep_clean(spark, docs, subsequence_svm.fit(spark, documents, labels, fold(3) != 1))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates stays: that of the smallest id, a null one last.

    Texts without a word are one group; different texts under one id, or under none, are told apart; of equal rows one stays.
    """
    return simhash_bk.keep_first(spark, docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, but for two edits, go from the texts; every document stays.

    A null text stays null; a text without a line left is empty; ``n_chars`` follows the text.
    """
    return line_edit_join.dedup(spark, docs).drop("__lines", "__kept")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those it does not take go.

    A null source is a source, the last; a null text has no words; an empty table stays empty.
    """
    return source_mixing.repeat_documents(spark, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece: where it lies in which sequence; a null or empty text is the end id alone.

    Workers go on to other stages, so they remember fewer stretches than where packing is all they do.
    """
    return bound_packing.pack_documents(spark, docs, remember=500_000)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("simhash_near_dedup", near_duplicates), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again as the next one's input."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned scores and tokenization are not SQL: the stages after the classifier are tested against brute-force versions, one
#: after another, and the classifier on held-out rows.
ORACLE_SQL = None
