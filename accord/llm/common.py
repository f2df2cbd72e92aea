"""What the operators share: reading tables, written tables that cut lineage, word patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accord.operators.ranks import numbered
from accord.sources.shared import scratch, written

__all__ = ["SEPARATORS", "WORD", "documents", "let", "numbered", "read", "scratch", "written"]

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, a null text being the empty one; other columns can't clash with results."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
