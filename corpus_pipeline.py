"""From raw documents to packed training sequences.

Each stage is a function of (spark, docs, sf_dir). Its result is written to the
shared folder and read again as the documents of the next stage. All stages but
the last keep the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallymill.llm import best_fit, line_templates, lsh_forest, mixing, quality
from tallymill.llm.queries import table, tokenizer
from tallymill.session import checkpoint

#: The stages have no form in SQL; tests compare them with brute force.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of templates that recur across documents."""
    return line_templates.without_recurring_lines(docs).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return lsh_forest.one_of_each(docs).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources at their target weights; documents may come twice."""
    return mixing.mixture(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and their places in sequences."""
    return best_fit.pack_documents(docs, tokenizer())


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", without_recurring_lines),
    ("minhash_near_dedup", one_of_each),
    ("source_mixing", mixed),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents below ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
