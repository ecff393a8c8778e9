"""Every query against its SQL on the smallest tables (``PHONOLAKE_TEST_DATA`` names others)."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as catalogue
from phonolake.plans.oracle import ORACLE
from phonolake.plans.queries import CATALOGUE
from tests.compare import connect, differences

FOLDER = os.environ.get("PHONOLAKE_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def base():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(CATALOGUE) == set(ORACLE)
    assert set(CATALOGUE) <= set(catalogue.queries())


@pytest.mark.parametrize("name", list(CATALOGUE))
def test_query_equals_sql(spark, base, name):
    assert differences(CATALOGUE[name](spark, FOLDER), ORACLE[name], base) == []


def test_entry(spark):
    assert catalogue.entry(spark).count() == 1
