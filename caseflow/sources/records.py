"""Nested records as rows, and evaluation sets as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUBRIC = "STRUCT<rubric_id: STRING, description: STRING, type: STRING>"
CLAIM = "STRUCT<claim: STRING, expected_status: STRING, min_confidence: DOUBLE>"
# A case names only the checks it has; the others read as null.
CASE_LISTS = [
    "expected_context_keys",
    "expected_channels",
    "expected_tools",
    "expected_output_tokens",
    "forbidden_patterns",
    "required_patterns",
    "forbidden_questions",
    "required_synthesis_points",
    "required_span_types",
    "forbidden_telemetry_keys",
    "expected_terms",
]
EVAL_SET = (
    "eval_set_id STRING, name STRING, description STRING, max_score INT, eval_cases ARRAY<STRUCT<"
    "eval_id: STRING, name: STRING, target_pillar: STRING, weight_points: INT, description: STRING, "
    "input_query: STRING, "
    + ", ".join(f"{c}: ARRAY<STRING>" for c in CASE_LISTS)
    + ", expected_trace_prefix: STRING, minimum_token_reduction_pct: DOUBLE, max_acceptable_latency_ms: DOUBLE, "
    f"claims_to_test: ARRAY<{CLAIM}>, rubrics: ARRAY<{RUBRIC}>>>"
)


def read_eval_sets(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation set files, one row per set."""
    return spark.read.schema(EVAL_SET).option("multiLine", True).json(path)


def write_eval_sets(sets: DataFrame, path: str) -> None:
    """One file for each set, as ``read_eval_sets`` reads them. Fields a case does not have are left out."""
    sets.repartition("eval_set_id").withColumn("set", F.col("eval_set_id")).write.partitionBy("set").json(path)


def eval_cases(sets: DataFrame) -> DataFrame:
    """One row per case, with its set."""
    return sets.select(
        "eval_set_id", F.col("name").alias("set_name"), "max_score", F.explode_outer("eval_cases").alias("c")
    ).select("eval_set_id", "set_name", "max_score", "c.*")


def eval_rubrics(sets: DataFrame) -> DataFrame:
    """One row per rubric, with its case and set."""
    cases = eval_cases(sets)
    return cases.select("eval_set_id", "eval_id", "weight_points", F.explode_outer("rubrics").alias("r")).select(
        "eval_set_id", "eval_id", "weight_points", "r.*"
    )


def scoring_cases(sets: DataFrame) -> DataFrame:
    """Cases in the shape ``eval_scoring`` checks: the many list fields folded into a few."""

    def merged(*columns: str):
        """All the lists a case gives, null when it gives none."""
        lists = [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns]
        given = F.coalesce(*[F.col(c) for c in columns]).isNotNull()
        return F.when(given, F.concat(*lists))

    return eval_cases(sets).select(
        "eval_set_id",
        "eval_id",
        "weight_points",
        merged("expected_terms", "expected_output_tokens", "required_synthesis_points", "expected_context_keys").alias(
            "expected_terms"
        ),
        merged("forbidden_questions", "forbidden_telemetry_keys").alias("forbidden_terms"),
        "required_patterns",
        "forbidden_patterns",
        F.col("expected_trace_prefix").alias("expected_prefix"),
        F.col("minimum_token_reduction_pct").alias("minimum"),
        F.col("max_acceptable_latency_ms").alias("maximum"),
        merged("expected_channels", "expected_tools", "required_span_types").alias("expected_members"),
    )


def explode_records(df: DataFrame, array: str, keep: Sequence[str]) -> DataFrame:
    """One row per element of a nested list, or one with nulls when the list is empty.

    ``array`` may be a list of structs, whose fields become columns, or a map, which gives
    ``key`` and ``value``.
    """
    kind = df.schema[array].dataType.typeName()
    if kind == "map":
        return df.select(*keep, F.explode_outer(array).alias("key", "value"))
    return df.select(*keep, F.inline_outer(array))
