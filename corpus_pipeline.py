"""From raw documents to packed sequences: each stage's result is written and read again as the next one's documents.

A stage decides on the rows it is given, and its decision takes effect: rows that a stage rejects are not in its result, and
all other rows are, with all their columns.
"""
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from codestrata.llm import decontaminate, exact_dedup, jaccard_join, packing, toxicity
from codestrata.llm.common import cut_lineage, table
from codestrata.llm.queries import WORD_TOKENIZER


def without_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that score below 0.7; a third of the labels is never learnt from, as in op5."""
    return toxicity.keep_accepted(docs, table(spark, folder, "labels"), toxicity.hashed_third())


def one_of_equal_texts(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_dedup.keep_one(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of documents that similar word shingles connect, the one with the smallest doc_id."""
    return jaccard_join.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no passage within the word edits allowed of a benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, folder, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every piece of every document left, with its sequence and its place there."""
    return packing.pack_documents(docs, public_tokenizers.path(WORD_TOKENIZER))


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", one_of_equal_texts),
    ("jaccard_join", one_of_each_group),
    ("decontamination", without_benchmark),
    ("best_fit_packing", packed),
]

# Toxicity scores and token ids have no SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
