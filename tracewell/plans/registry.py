"""Registry of runnable queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, rounded: tuple[str, ...] = ()):
    """Register ``fn(tables)`` under ``name``, with the SQL that must give the same rows.

    ``rounded`` names floating columns that are cut to six places on both sides, because the order of
    a distributed sum is not fixed.
    """

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            from tracewell.views import Tables

            result = fn(Tables(tune(spark), folder))
            return result.withColumns({c: F.round(c, 6) for c in rounded}) if rounded else result

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            places = ", ".join(f"round({c}, 6) AS {c}" for c in rounded)
            ORACLES[name] = f"SELECT * REPLACE ({places}) FROM ({sql}) q" if rounded else sql
        return fn

    return register
