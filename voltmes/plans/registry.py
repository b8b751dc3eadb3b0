"""Named queries over the supplied tables and, where SQL can say it, the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded for comparison, without negative zeros; ``special`` sets digits per column."""
    return df.select(*[
        (F.round(F.col(f.name), special.get(f.name, digits)) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


def r(expression: str, digits: int = 6, name: str | None = None) -> str:
    """The SQL side of ``rounded``."""
    return f"(round({expression}, {digits}) + 0.0::DOUBLE) AS {name or expression}"


def rs(columns: str, digits: int = 6) -> str:
    return ", ".join(r(c, digits) for c in columns.split())
