"""Driver contract and SQL-oracle agreement on the smallest data."""

import pytest

import __spark_entry__ as E
from conftest import SF001
from oracle_harness import compare, duck


def test_entry_runs(spark):
    rows = E.entry(spark).collect()
    assert {r.metric for r in rows} == {"accuracy", "f1_macro", "auroc_macro", "correct", "total"}


def test_every_query_of_the_registry_has_an_oracle():
    from caseflow.plans.registry import ORACLES, QUERIES
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(E.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_oracle_agreement_sf0001(spark, con, name):
    res = compare(E.queries()[name](spark, SF001), E.oracle_sql()[name], con)
    assert res["match"], res
