"""Named queries: a Spark builder over the fixtures plus its DuckDB twin.

``register`` is used by the ``meterwise.plans.q_*`` modules; importing
``meterwise.plans.catalog`` loads all of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame

from meterwise.plans.oracle_fixtures import with_fixtures
from meterwise.sources.fixtures import Fixtures


@dataclass(frozen=True)
class Query:
    name: str
    op_id: str
    build: Callable[[Fixtures], DataFrame]
    oracle: str | None
    oracle_ctes: dict | None = None

    def oracle_sql(self) -> str | None:
        if self.oracle is None:
            return None
        return with_fixtures(self.oracle, self.oracle_ctes)


REGISTRY: dict[str, Query] = {}


def register(name: str, op_id: str, oracle: str | None = None, ctes: dict | None = None):
    def deco(fn: Callable[[Fixtures], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, op_id, fn, oracle, ctes)
        return fn

    return deco
