"""Queries of the index of an archive and of reads from one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import micros
from ..sources import archive
from . import data
from .data import TIMED
from .registry import query, rounded

_DAY = 86_400_000_000
# spans of a user's events of a type in a day; requests by nation: wildcards in stations, channels, both or none, open or closed
_INDEX = f"ix AS (SELECT 'N' || (trace % 3) AS network, 'S' || trace AS station, '' AS location, upper(left(channel, 3)) AS channel, min(t) AS a, max(t) AS z, count(*) AS samples FROM e GROUP BY trace, upper(left(channel, 3)), t // {_DAY})"
_REQUESTS = (
    "rq AS (SELECT n_nationkey AS request, CASE WHEN n_nationkey % 2 = 0 THEN '*' ELSE 'N' || (n_nationkey % 3) END AS network, CASE n_nationkey % 4 WHEN 0 THEN 'S' || n_nationkey WHEN 1 THEN 'S?' || (n_nationkey % 10) WHEN 2 THEN 'S1*' ELSE 'X' || n_nationkey END AS station, '*' AS location, CASE n_nationkey % 3 WHEN 0 THEN '*' WHEN 1 THEN '?I?' ELSE 'CLI' END AS channel,"
    f" CASE WHEN n_nationkey % 5 > 0 THEN epoch_us(TIMESTAMP '2024-01-01') + n_nationkey * {_DAY} + 7200000000 END AS lo, CASE WHEN n_nationkey % 7 > 0 THEN epoch_us(TIMESTAMP '2024-01-01') + (n_nationkey + 4) * {_DAY} + 3600000000 END AS hi FROM nation)"
)


def _index(spark, d) -> DataFrame:
    rows = data.timed(spark, d)
    grouped = rows.groupBy("trace", F.upper(F.left("channel", F.lit(3))).alias("channel"), F.floor(F.col("t") / _DAY).alias("_day")).agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("samples"))
    return grouped.select(F.concat(F.lit("N"), F.col("trace") % 3).alias("network"), F.concat(F.lit("S"), "trace").alias("station"), F.lit("").alias("location"), "channel", "start", "end", "samples")


def _requests(spark, d) -> DataFrame:
    key = F.col("n_nationkey")
    first = micros(F.lit("2024-01-01 00:00:00"))
    text = lambda prefix, value: F.concat(F.lit(prefix), value.cast("string"))
    station = F.when(key % 4 == 0, text("S", key)).when(key % 4 == 1, text("S?", key % 10)).when(key % 4 == 2, "S1*").otherwise(text("X", key))
    channel = F.when(key % 3 == 0, "*").when(key % 3 == 1, "?I?").otherwise("CLI")
    return data.table(spark, d, "nation").select(
        key.alias("request"),
        F.when(key % 2 == 0, "*").otherwise(text("N", key % 3)).alias("network"),
        station.alias("station"),
        F.lit("*").alias("location"),
        channel.alias("channel"),
        F.when(key % 5 > 0, first + key * _DAY + 7_200_000_000).alias("start"),
        F.when(key % 7 > 0, first + (key + 4) * _DAY + 3_600_000_000).alias("end"),
    )


_MATCH = "ix.network GLOB rq.network AND ix.station GLOB rq.station AND ix.channel GLOB rq.channel"
_SPANS = "sp AS (SELECT network, station, channel, min(a) AS earliest, max(z) AS latest FROM ix GROUP BY 1, 2, 3)"
_HITS = f"hi AS (SELECT request, ix.*, coalesce(lo, earliest) AS requeststart, coalesce(hi, latest) AS requestend FROM rq JOIN ix ON {_MATCH} JOIN sp ON sp.network = ix.network AND sp.station = ix.station AND sp.channel = ix.channel WHERE a <= coalesce(hi, latest) AND z >= coalesce(lo, earliest))"


@query("SELECT request, network, station, location, channel, a AS start, z AS \"end\", samples, requeststart, requestend FROM hi", TIMED, _INDEX, _REQUESTS, _SPANS, _HITS)
def index_rows(spark, d):
    """Rows of the index that 25 requests with wildcards touch."""
    return archive.index_rows(_index(spark, d), _requests(spark, d))


@query("SELECT request, request IN (SELECT request FROM hi) AS has_data FROM rq", TIMED, _INDEX, _REQUESTS, _SPANS, _HITS)
def has_data(spark, d):
    return archive.has_data(_index(spark, d), _requests(spark, d))


@query(
    f"SELECT request, count(*) AS samples, min(t) AS first, max(t) AS last, round(sum(x), 5) AS total FROM (SELECT 'N' || (trace % 5) AS network, 'S' || (trace % 5) AS station, upper(left(channel, 3)) AS channel, t, x FROM e) ix JOIN rq ON ix.network GLOB rq.network AND ix.station GLOB replace(rq.station, '1*', '*') AND ix.channel GLOB rq.channel WHERE t >= coalesce(lo, 0) AND t <= coalesce(hi, t) GROUP BY 1",
    TIMED,
    _REQUESTS,
)
def archive_waveforms(spark, d):
    """An archive of the events by station and day is written, and read as far as the requests ask."""
    rows = data.timed(spark, d)
    codes = rows.select(F.concat(F.lit("N"), F.col("trace") % 5).alias("network"), F.concat(F.lit("S"), F.col("trace") % 5).alias("station"), F.lit("").alias("location"), F.upper(F.left("channel", F.lit(3))).alias("channel"), "t", "x")
    path = data.folder(spark)
    archive.write_archive(codes, path)
    requests = _requests(spark, d).withColumn("station", F.regexp_replace("station", r"1\*", "*"))
    held = archive.read_archive(spark, path, requests)
    return rounded(held.groupBy("request").agg(F.count("*").alias("samples"), F.min("t").alias("first"), F.max("t").alias("last"), F.sum("x").alias("total")), 5, "total")
