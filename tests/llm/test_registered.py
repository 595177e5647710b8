"""The registered corpus queries against their SQL, and their registration."""

from __future__ import annotations

import pytest

from caseflow.llm import oracles, queries
from tests.conftest import SMALL
from tests.harness import compare


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, name, SMALL) == []


def test_one_query_for_each_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
