import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("METERWISE_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from meterwise.session import build_session

    s = build_session("local[4]", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def fx(spark):
    from meterwise.sources.fixtures import Fixtures

    return Fixtures(spark, SF)


@pytest.fixture(scope="session")
def con():
    from meterwise.plans.compare import duckdb_connection

    return duckdb_connection(SF)
