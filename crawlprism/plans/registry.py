"""The registered queries: a name, a Spark plan over the roles, and the same question as SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from crawlprism.plans.roles import Roles


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Roles], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def register(name: str, build: Callable[[Roles], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name!r} is registered twice")
    QUERIES[name] = Query(name, build, sql)


def load_all() -> dict[str, Query]:
    from crawlprism.plans import ads, entities, pixels, sources, statistics, values  # noqa: F401

    return QUERIES
