"""Spreading a large key must not change what a join returns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from caseflow.operators import lookup, resolve, scoring
from caseflow.operators.skew import spread_join
from caseflow.plans import batch, mapping
from tests.conftest import SMALL


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot_rows", [1, 7, 10**9])
def test_same_rows_as_a_plain_join(spark, how, hot_rows):
    left = spark.range(300).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40).alias("k")
    )
    right = spark.range(60).select((F.col("id") % 30).alias("k"), F.col("id").alias("r"))
    got = spread_join(left, right, ["k"], ["id"], how, hot_rows=hot_rows)
    assert rows(got) == rows(left.join(right, "k", how))


def test_a_large_key_reaches_many_shares(spark):
    left = spark.range(1000).withColumn("k", F.lit(1))
    right = spark.createDataFrame([(1, "a")], "k int, r string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = spread_join(left, right, ["k"], ["id"], hot_rows=50)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 1000 and len(sizes) > 4 and max(sizes) < 500


def test_other_joins_are_refused(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        spread_join(df, df, ["id"], ["id"], "full")


def test_operators_that_use_it(spark):
    fragments, queries = mapping.searchable_documents(spark, SMALL), mapping.memory_queries(spark, SMALL)
    assert rows(lookup.memory_search(fragments, queries, hot_rows=3)) == rows(lookup.memory_search(fragments, queries))
    cases, outputs = mapping.eval_inputs(spark, SMALL)
    assert rows(scoring.eval_scoring(cases, outputs, hot_rows=2)) == rows(scoring.eval_scoring(cases, outputs))
    evidence = resolve.evidence_rows(
        ("ledger_rows", mapping.transactions(spark, SMALL)), ("notices", mapping.travel_notices(spark, SMALL)),
        ("baseline_rows", mapping.signals(spark, SMALL)), ("suspect_replies", mapping.declines(spark, SMALL)),
    )
    claims, policies = mapping.claims(spark, SMALL), mapping.policies(spark, SMALL)
    assert rows(resolve.claim_veracity(claims, evidence, policies, hot_rows=1)) == rows(
        resolve.claim_veracity(claims, evidence, policies)
    )
    assert batch.QUERIES["resolve_cases"](spark, SMALL).count() == 1500
