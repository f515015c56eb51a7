"""Event catalogs and station inventories."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import glob

_RULE = re.compile(r"^\s*(\w+)\s*(<=|>=|<|>)\s*(.+?)\s*$")


def rule(text: str, strict_nulls: tuple[str, ...] = ("magnitude",)) -> Column:
    """``"key op value"``. A null passes < and <= and fails > and >=; for ``strict_nulls`` keys it always fails."""
    found = _RULE.match(text)
    if not found:
        raise ValueError(f"not a rule: {text!r}")
    key, op, value = found.groups()
    column = F.col(key)
    right = F.lit(float(value)) if re.fullmatch(r"[-+]?[0-9.]+([eE][-+]?[0-9]+)?", value) else F.lit(value).cast("timestamp")
    test = {"<": column < right, "<=": column <= right, ">": column > right, ">=": column >= right}[op]
    return F.coalesce(test, F.lit(op.startswith("<") and key not in strict_nulls))


def filter_catalog(events: DataFrame, *rules: str, inverse: bool = False) -> DataFrame:
    out = F.lit(True)
    for text in rules:
        out = out & rule(text)
    return events.where(~out if inverse else out)


def select_codes(rows: DataFrame, **patterns: str) -> DataFrame:
    """Rows whose code columns match all glob patterns."""
    out = F.lit(True)
    for column, pattern in patterns.items():
        out = out & glob(F.col(column), pattern)
    return rows.where(out)


def remove_codes(rows: DataFrame, **patterns: str) -> DataFrame:
    """The complement of ``select_codes``."""
    out = F.lit(True)
    for column, pattern in patterns.items():
        out = out & F.coalesce(glob(F.col(column), pattern), F.lit(False))
    return rows.where(~out)


def preferred(children: DataFrame, parent: str, wanted: str, child: str) -> DataFrame:
    """Each parent's child whose id is the preferred one; no fallback."""
    return children.where(F.col(wanted) == F.col(child)).dropDuplicates([parent])


def channel_priority(rows: DataFrame, station: list[str], code: str, priorities: list[str]) -> DataFrame:
    """Rows of each station's first pattern that matches any of its channels."""
    place = F.coalesce(*[F.when(glob(F.col(code), p), F.lit(i)) for i, p in enumerate(priorities)])
    return rows.withColumn("_place", place).where("_place IS NOT NULL").withColumn("_best", F.min("_place").over(Window.partitionBy(*station))).where("_place = _best").drop("_place", "_best")


def contents(rows: DataFrame, levels: list[str]) -> DataFrame:
    """Number of distinct codes at each level below the ones before."""
    return rows.groupBy(*levels[:1]).agg(*[F.countDistinct(*levels[1 : i + 1]).alias(f"n_{levels[i]}") for i in range(1, len(levels))])
