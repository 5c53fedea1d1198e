"""The query registry: a Spark plan and, where SQL can say it, the DuckDB statement to check it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tonelake.session import utc
from tonelake.sources.roles import Roles

Plan = Callable[[Roles], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register `plan(roles)` under `name`, with its oracle statement if there is one."""

    def register(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, sf_dir: plan(Roles(utc(spark), sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register
