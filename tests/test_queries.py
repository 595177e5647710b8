"""Every registered query against its SQL, and the physical plans they get."""

from __future__ import annotations

import contextlib
import io

import pytest

import __spark_entry__ as entry
from caseflow.plans import batch, streams
from tests.conftest import SMALL
from tests.harness import compare


OWN = {**batch.QUERIES, **streams.QUERIES}


def test_every_query_has_its_sql():
    assert set(OWN) <= set(entry.oracle_sql()) and set(OWN) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(OWN))
def test_same_answer_as_sql(spark, name):
    assert compare(spark, name, SMALL) == []


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def plan_of(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.mark.parametrize("name", sorted(batch.QUERIES))
def test_no_plan_pairs_everything_or_leaves_the_jvm(spark, name):
    plan = plan_of(batch.QUERIES[name](spark, SMALL))
    for operator in ("CartesianProduct", "NestedLoopJoin", "EvalPython", "InPandas", "MapInArrow"):
        assert operator not in plan, operator


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(batch.QUERIES["channel_activity"](spark, SMALL))
    assert "EqualTo(event_type,click)" in plan
    plan = plan_of(batch.QUERIES["channel_coverage"](spark, SMALL))
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in plan
    plan = plan_of(batch.QUERIES["card_status"](spark, SMALL))
    assert "In(event_type, [error,signup])" in plan


def test_latest_rows_are_limited_before_the_shuffle(spark):
    plan = plan_of(batch.QUERIES["account_statement"](spark, SMALL))
    assert plan.count("WindowGroupLimit") >= 2
    assert "TakeOrderedAndProject" in plan_of(batch.QUERIES["recent_spans"](spark, SMALL))


def test_streams_have_a_batch_form():
    assert {q for q in streams.QUERIES if q.startswith("stream_")} <= set(entry.oracle_sql())
