"""The corpus pipeline: documents in, the weighted training mix out.

For every stage: a null text counts as empty, columns that it does not use pass as they are whatever their names, and
an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caseflow.llm import decontam, exact_dedup, mixing, near_dedup, quality
from caseflow.llm.shared import ship, stored


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below 0.7 go.

    An empty text has a score like any other. Rows of one doc_id are scored by their own texts.
    """
    ship(spark)
    return quality.keep_good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays.

    Null and empty texts are equal. Rows that repeat a doc_id share its fate; a row without one stays.
    """
    ship(spark)
    return exact_dedup.drop_exact(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group (five-word shingles, similarity 0.8) the smallest doc_id stays.

    A text without words is near nothing and stays, as does a row without a doc_id. Rows of one doc_id share its fate.
    """
    ship(spark)
    return near_dedup.keep_first(spark, docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    An item without words is in no document. Rows of one doc_id go together; a row without one stays.
    """
    ship(spark)
    return decontam.drop_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: the words taken of each document as its text, repeats written out, and their number.

    Sources go by code point, a null one last. A document without words is not in the mix. Rows of one doc_id share the
    takes of the one that gives most.
    """
    ship(spark)
    return mixing.mixed_documents(spark, docs)


STAGES = [
    ("quality", good),
    ("exact dedup", exact),
    ("near dedup", near),
    ("decontamination", clean),
    ("mixing", mixed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(spark, stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
