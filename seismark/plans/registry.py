"""Registered queries by name, and the DuckDB SQL of those that have a twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, *views: str):
    """Registers a query under its function's name, with its DuckDB twin over the named views."""

    def register(make: Callable[[SparkSession, str], DataFrame]):
        QUERIES[make.__name__] = make
        if oracle:
            ORACLES[make.__name__] = (f"WITH RECURSIVE {', '.join(views)} " if views else "") + oracle
        return make

    return register


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Rounded, without negative zeros."""
    return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c in columns})
