"""Named queries with their independent SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from hushline.catalog.views import Views, with_views


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Views], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Views(spark, sf_dir))


QUERIES: dict[str, Query] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register a query; ``views`` names the bridge views its SQL reads."""

    def keep(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = Query(name, build, None if sql is None else with_views(views, sql))
        return build

    return keep
