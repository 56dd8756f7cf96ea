"""Where the queries of the engine and their SQL are gathered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, base: str = "") -> Callable[[Query], Query]:
    """Registers a function (spark, sf_dir) -> DataFrame by its name, and the SQL of the same rows.

    base: common table expressions (without WITH) that sql builds on.
    """

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            body = sql.strip()
            if base:
                body = f"WITH {base}" + (f",\n{body[len('WITH '):]}" if body.startswith("WITH ") else f"\n{body}")
            ORACLES[f.__name__] = body
        return f

    return register
