"""A corpus pipeline of five stages over documents, each of which acts on all that the one before kept.

Every stage takes null and empty texts, repeated rows and empty tables; other columns pass through
as given, but for the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from accord.llm import jaccard, mixing, pii, quality
from accord.llm.common import read, written
from accord.llm.queries import byte_bpe


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules reject go, among them null and empty texts, which are too short."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of smallest id; of repeated rows one. Texts without words all stay."""
    return jaccard.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms are replaced; null texts stay null, and no row is lost."""
    return pii.redact_documents(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come to their targets; none without words is taken."""
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document of the mix: its id, token count and digests; a null text has no tokens."""
    return byte_bpe(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("source_mixing", source_mixing), ("tokens", tokens)]

#: Stages learn from labels and make draws that SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
