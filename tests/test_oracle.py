"""Every registered query against its DuckDB twin (the driver's gate), on sf0.001."""

import pytest

from meterwise.plans.catalog import REGISTRY
from meterwise.plans.compare import compare
from meterwise.plans.oracle_fixtures import FIXTURE_CTES, with_fixtures
from meterwise.sources.fixtures import Fixtures

WITH_ORACLE = sorted(n for n, q in REGISTRY.items() if q.oracle is not None)
ROWS_ONLY = sorted(n for n, q in REGISTRY.items() if q.oracle is None)


@pytest.mark.parametrize("name", [n for n in FIXTURE_CTES if hasattr(Fixtures, n)])
def test_fixture_twins(fx, con, name):
    r = compare(getattr(fx, name), con, with_fixtures(f"SELECT * FROM {name}"))
    assert r["match"], r


@pytest.mark.parametrize("name", WITH_ORACLE)
def test_query_matches_oracle(fx, con, name):
    r = compare(REGISTRY[name].build(fx), con, REGISTRY[name].oracle_sql())
    assert r["match"], r


def test_every_query_of_the_core_has_a_twin():
    assert ROWS_ONLY == []


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.columns == ["account_id", "purchased_micros", "spent_micros", "balance_micros"]
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
