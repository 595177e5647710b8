"""Cutting large groups must not change any value."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from caseflow.operators import correlate
from caseflow.operators.ordered import Running, large_groups, running
from caseflow.plans import mapping
from tests.conftest import SMALL


def skewed_rows(n=600, seed=7):
    """One key holds a third of the rows; positions repeat and values are often missing."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = 1 if i % 3 == 0 else rnd.randint(2, 40)
        rows.append((key, rnd.randint(0, 150), i, rnd.randint(0, 99) if rnd.random() < 0.4 else None))
    return rows


def brute(rows):
    """All six running values, computed by scanning the whole group for every row."""
    out = {}
    for key, pos, rid, _ in rows:
        group = sorted((p, r, v) for k, p, r, v in rows if k == key)
        before = [v for p, r, v in group if (p, r) < (pos, rid) and v is not None]
        after = [v for p, r, v in group if (p, r) > (pos, rid) and v is not None]
        out[rid] = (
            before[-1] if before else None,
            max(before) if before else None,
            sum(before) if before else None,
            after[0] if after else None,
            max(after) if after else None,
            sum(after) if after else None,
        )
    return out


@pytest.mark.parametrize("hot_rows", [3, 20, 100, 10_000])
def test_running_matches_brute_force(spark, hot_rows):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "k long, pos long, id long, v long").repartition(5)
    v = F.col("v")
    got = running(
        df,
        ["k"],
        ["pos", "id"],
        {
            "last_before": Running("last", v),
            "max_before": Running("max", v),
            "sum_before": Running("sum", v),
            "next_after": Running("last", v, backwards=True),
            "max_after": Running("max", v, backwards=True),
            "sum_after": Running("sum", v, backwards=True),
        },
        hot_rows=hot_rows,
    )
    assert got.columns == ["k", "pos", "id", "v", "last_before", "max_before", "sum_before",
                           "next_after", "max_after", "sum_after"]
    assert {r.id: tuple(r)[4:] for r in got.collect()} == brute(rows)


def test_only_large_groups_are_cut(spark):
    df = spark.createDataFrame(skewed_rows(), "k long, pos long, id long, v long")
    assert [(r["_hot_k"], r["_n"]) for r in large_groups(df, ["k"], 100).collect()] == [(1, 200)]
    assert large_groups(df, ["k"], 200).count() == 0


def slot_sizes(spark, df, hot_rows):
    """How many rows of the large group each task windows."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    try:
        got = running(df, ["k"], ["pos", "id"], {"prev": Running("last", F.col("id"))}, hot_rows=hot_rows)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        chain = {r.id: r.prev for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    return sizes, chain


@pytest.mark.parametrize("pos", ["id * id", "7", "CASE WHEN id = 0 THEN 0 ELSE 1000000000 + id END"])
def test_slots_are_even_whatever_the_order_looks_like(spark, pos):
    """Rows that bunch up, rows of one time, and one row far off: no slot is much above the aim."""
    df = spark.range(6000).selectExpr("1 AS k", f"CAST({pos} AS LONG) AS pos", "id")
    sizes, chain = slot_sizes(spark, df, 1000)
    assert sum(sizes) == 6000 and max(sizes) <= 2000 and len(sizes) >= 4
    assert chain == {i: (i - 1 if i else None) for i in range(6000)}


def test_null_keys_form_a_group(spark):
    rows = [(None, i, i, i) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, pos long, id long, v long")
    got = running(df, ["k"], ["pos", "id"], {"prev": Running("last", F.col("v"))}, hot_rows=4)
    assert {r.id: r.prev for r in got.collect()} == {i: (i - 1 if i else None) for i in range(40)}


@pytest.mark.parametrize("hot_rows", [2, 11])
def test_correlations_are_the_same_when_groups_are_cut(spark, hot_rows):
    whole = {
        "velocity": lambda n: correlate.velocity_alerts(
            mapping.signals(spark, SMALL), mapping.locations(spark, SMALL), hot_rows=n),
        "step_up": lambda n: correlate.step_up_audit(
            mapping.challenges(spark, SMALL), mapping.replies(spark, SMALL), hot_rows=n),
        "travel": lambda n: correlate.travel_coverage(
            mapping.travel_charges(spark, SMALL), mapping.travel_notices(spark, SMALL), hot_rows=n),
        "chain": lambda n: correlate.incident_chain(
            mapping.declines(spark, SMALL), mapping.calls(spark, SMALL), mapping.wallet_failures(spark, SMALL), hot_rows=n),
        "status": lambda n: correlate.status_asof(
            mapping.purchases(spark, SMALL), mapping.status_events(spark, SMALL), hot_rows=n),
    }
    for name, run in whole.items():
        expected = sorted(map(str, run(10**9).collect()))
        assert sorted(map(str, run(hot_rows).collect())) == expected, name
        assert expected, name


def test_a_large_group_reaches_many_tasks(spark):
    """One customer holds a third of the rows; no task gets near that many."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("pos"), "id"
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running(df, ["k"], ["pos", "id"], {"prev": Running("last", F.col("id"))}, hot_rows=100)
        sizes = [r["count"] for r in got.filter("k = -1").groupBy(F.spark_partition_id()).count().collect()]
        plain = [r["count"] for r in df.repartition(8, "k").filter("k = -1").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert plain == [1000]
    assert sum(sizes) == 1000 and len(sizes) >= 6 and max(sizes) < 400
