"""From documents to token ids: the corpus pipeline in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last keep the columns of documents. Every stage's result is written to the
shared folder and read again, so a stage works on just what the one before it
kept, and a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scenelake.llm import bpe_codec, decontaminate, quality, simhash, toxicity
from scenelake.llm.common import materialise, table
from scenelake.llm.registry import word_bpe_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows within the base rules and their group's fences."""
    return quality.keep(docs)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows not predicted toxic; learned from the labels of the rows at hand."""
    return toxicity.keep(docs, table(spark, sf_dir, "labels"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the row of the least id."""
    return simhash.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item within the edit budget."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    return bpe_codec.digests(docs, word_bpe_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", without_toxic),
    ("simhash_near_dedup", one_of_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("bpe_encoding", encoded),
]

#: Quantile sketches, learned lexicons and edit matching have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
