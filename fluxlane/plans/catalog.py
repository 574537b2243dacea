"""Queries over the test tables, and the SQL they must agree with.

The tables have no magnetics, so operators run on stand-ins: ``events.value`` is
a sensor along ``user_id`` (the line), ``embeddings`` a vector sensor with
features, and ``orders`` averaged by month and customer makes a grid.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


from fluxlane.plans import earth, fields, navigation, recurrent, sequences, vectors  # noqa: E402, F401
