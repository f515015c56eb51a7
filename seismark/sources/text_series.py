"""Text formats of evenly sampled series: SLIST (values) and TSPAIR (time and value), one record per segment.

A record starts at its TIMESERIES header, which is taken as the line separator, so a file of many segments is cut by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MARK = "TIMESERIES "


def _header(kind: str) -> Column:
    name = F.concat_ws("_", "network", "station", "location", "channel", F.lit("R"))
    start = F.date_format(F.timestamp_micros("start"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.lit(_MARK), F.concat_ws(", ", name, F.concat(F.size("data"), F.lit(" samples")), F.concat("rate", F.lit(" sps")), start, F.lit(kind), F.lit("FLOAT"), F.lit("Counts")))


def write_slist(traces: DataFrame, path: str) -> None:
    """(network, station, location, channel, start in microseconds, rate, data)"""
    body = F.array_join(F.transform("data", lambda x: x.cast("string")), "\n")
    traces.select(F.concat(_header("SLIST"), F.lit("\n"), body)).write.text(path)


def write_tspair(traces: DataFrame, path: str) -> None:
    at = lambda i: F.date_format(F.timestamp_micros(F.col("start") + F.round(i * 1e6 / F.col("rate")).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    body = F.array_join(F.transform("data", lambda x, i: F.concat(at(i), F.lit("  "), x.cast("string"))), "\n")
    traces.select(F.concat(_header("TSPAIR"), F.lit("\n"), body)).write.text(path)


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """Segments of SLIST and TSPAIR files."""
    records = spark.read.option("lineSep", _MARK).text(path).where(F.trim("value") != "")
    head = F.split(F.substring_index("value", "\n", 1), ",\\s*")
    rows = records.select(head.alias("h"), F.expr("substring(value, instr(value, '\n') + 1)").alias("body"))
    code = F.split(F.get("h", F.lit(0)), "_")
    words = F.filter(F.split("body", "\\s+"), lambda w: w != "")
    pairs = F.get("h", F.lit(4)) == "TSPAIR"
    numbers = F.when(pairs, F.filter(words, lambda _w, i: i % 2 == 1)).otherwise(words)
    names = ("network", "station", "location", "channel")
    return rows.select(
        *[F.get(code, i).alias(n) for i, n in enumerate(names)],
        F.unix_micros(F.to_timestamp(F.get("h", F.lit(3)))).alias("start"),
        F.split(F.get("h", F.lit(2)), " ")[0].cast("double").alias("rate"),
        F.transform(numbers, lambda w: w.cast("double")).alias("data"),
    )
