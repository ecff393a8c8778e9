"""Every query that has SQL against it, whole tables."""

from __future__ import annotations

import pytest

from phonolake.llm.queries import LLM_QUERIES, LLM_SQL
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(LLM_SQL))
def test_query_equals_sql(spark, base, name):
    assert differences(LLM_QUERIES[name](spark, FOLDER), LLM_SQL[name], base) == []


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES if n != "pipeline") == list(range(1, 14))
