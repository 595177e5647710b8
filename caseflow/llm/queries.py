"""One registered query for each corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm import (
    bpe,
    decontam,
    exact_dedup,
    host_reputation,
    licenses,
    mixing,
    near_dedup,
    paragraph_dedup,
    pii,
    quality,
    repair,
    suffix_dedup,
    trie,
)
from caseflow.llm.shared import ship

TOKENIZER = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        @wraps(run)
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return run(spark, sf_dir)

        QUERIES[name] = shipped
        return shipped

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_near_dedup")
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(spark, table(spark, sf_dir, "documents"))


@query("op2_exact_dedup")
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, table(spark, sf_dir, "documents"), exact_dedup.earlier_half())


@query("op3_paragraph_dedup")
def op3_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeated_paragraphs(spark, table(spark, sf_dir, "documents"))


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(spark, table(spark, sf_dir, "documents"))


@query("op5_url_filter")
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The only labels are those of the documents; a page's outcome is the quality under its number."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.selectExpr("doc_id AS page_id", "quality AS good")
    return host_reputation.judge_urls(table(spark, sf_dir, "pages"), outcomes)


@query("op6_pii")
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(spark, table(spark, sf_dir, "documents"))


@query("op7_license_scan")
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(spark, table(spark, sf_dir, "documents"), licenses.document_path())


@query("op8_mixing")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, table(spark, sf_dir, "documents"))


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_decontamination")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_repair")
def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(spark, repair.damaged(table(spark, sf_dir, "conversations")))


@query("op12_bpe")
def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Needs the public vocabulary files, which only the driver reads."""
    import public_tokenizers

    rows = bpe.encoded(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), decode=True)
    return rows.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op13_prefix_trie")
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(spark, table(spark, sf_dir, "conversations"))
