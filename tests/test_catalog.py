"""Every named query against its SQL on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect
from spendlens.catalog.oracle import oracle
from spendlens.catalog.queries import catalog

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(catalog()) == set(oracle())
    assert set(catalog()) <= set(queries()) and set(oracle()) <= set(oracle_sql())


@pytest.mark.parametrize("key", sorted(catalog()))
def test_query_equals_sql(spark, con, key):
    _, _, problem = compare(spark, con, FOLDER, key)
    assert problem is None, problem


def test_entry(spark):
    out = entry(spark)
    assert out.columns == ["channel", "spend_usd"] and out.count() > 0


def test_mixed_currencies_matter_in_the_samples(spark):
    totals = {r["method"]: r["total"] for r in queries()["fx_impact"](spark, FOLDER).collect()}
    assert totals["naive"] > 30 * abs(totals["converted"]) / 5
    assert all(r["winner_flips"] for r in queries()["rank_flip"](spark, FOLDER).collect())
