"""The table of registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .standins import oracle, plain, stand_in

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of stand-ins: it is called with a getter of stand-ins by name."""

    def keep(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: plain(f(lambda v: stand_in(spark, sf_dir, v)))
        if sql:
            ORACLES[name] = oracle(sql)
        return f

    return keep
