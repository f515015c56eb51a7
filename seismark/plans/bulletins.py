"""Queries of bulletins: tables written as fixed-column text and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import bulletins, tables
from . import data
from .registry import query, rounded

_T = "o_orderdate + to_microseconds(CAST(o_orderkey % 86399 * 1000000 + o_orderkey % 10 * 100000 AS BIGINT))"
_ORDERS = f"oe AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS event, CAST({_T} AS TIMESTAMP) AS time, o_orderkey % 90 + 0.25 AS latitude, -(o_orderkey % 180) + 0.5 AS longitude FROM orders)"
_LINES = "ol AS (SELECT l_orderkey AS k, l_linenumber AS n FROM lineitem GROUP BY 1, 2)"


def _orders(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    time = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + k % 86399 * 1_000_000 + k % 10 * 100_000)
    return data.table(spark, d, "orders").select(k.alias("k"), k.cast("string").alias("event"), time.alias("time"), (k % 90 + 0.25).alias("latitude"), (-(k % 180) + 0.5).alias("longitude"))


def _lines(spark, d) -> DataFrame:
    return data.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(F.lit(1).alias("_")).drop("_")


_TENSOR = [f"{c}" for name in ("rr", "tt", "pp", "rt", "rp", "tp") for c in (f"m_{name}", f"m_{name}_error")]
_FIGURES = {"depth": "(k % 600) + 0.5", "mb": "k % 9 + 0.5", "ms": "k % 8 + 0.5", "shift": "k % 20 - 0.5", "shift_error": "0.1", "centroid_latitude": "latitude + 0.25", "latitude_error": "0.05", "centroid_longitude": "longitude - 0.25", "longitude_error": "0.02", "centroid_depth": "k % 500 + 1.5", "depth_error": "0.4", "duration": "k % 30 + 0.5"}
_UNITS = {c: f"(k % {41 + i} - 20 + 0.125) * 1e17" if i % 2 == 0 else "(k % 5 + 1) * 1e16" for i, c in enumerate(_TENSOR)}
_AXES = {"t_length": "(k % 9 + 0.5) * 1e17", "n_length": "0.25 * 1e17", "p_length": "-(k % 9 + 0.75) * 1e17", "t_plunge": "k % 90 + 0.0", "n_plunge": "k % 80 + 0.0", "p_plunge": "k % 70 + 0.0", "t_azimuth": "k % 360 + 0.0", "n_azimuth": "k % 350 + 0.0", "p_azimuth": "k % 340 + 0.0", "moment": "(k % 9 + 0.625) * 1e17"}
_PLANES = {"strike1": "k % 360 + 0.0", "dip1": "k % 90 + 0.0", "rake1": "k % 360 - 180.0", "strike2": "k % 359 + 0.0", "dip2": "k % 89 + 0.0", "rake2": "k % 359 - 179.0"}
_ALL = _FIGURES | _UNITS | _AXES | _PLANES


@query(
    "SELECT event, 'PDEW' AS catalog, epoch_us(time) AS time, latitude, longitude, concat('PLACE ', k % 100) AS place, 'FREE' AS depth_type, round(2.0 / 3 * (log10((k % 9 + 0.625) * 1e17) - 9.1), 6) AS mw, "
    + ", ".join(f"round(({x}) / {1e16 if c in _UNITS or c in ('t_length', 'n_length', 'p_length', 'moment') else 1}, 4) + 0.0 AS {c}" for c, x in _ALL.items())
    + " FROM oe",
    _ORDERS,
)
def moment_tensor_round_trip(spark, d):
    """Records of five lines: times, errors, tensors, axes and planes at their columns."""
    rows = _orders(spark, d).withColumns({c: F.expr(x).cast("double") for c, x in _ALL.items()})
    rows = rows.withColumns({"catalog": F.lit("PDEW"), "place": F.concat(F.lit("PLACE "), F.col("k") % 100), "depth_type": F.lit("FREE")})
    path = data.folder(spark)
    bulletins.write_moment_tensors(rows, path)
    held = bulletins.read_moment_tensors(spark, path).drop("file", "record").withColumn("time", F.unix_micros("time"))
    large = [c for c in _ALL if c in _UNITS or c in ("t_length", "n_length", "p_length", "moment")]
    return rounded(rounded(held.withColumns({c: F.col(c) / 1e16 for c in large}), 4, *_ALL), 6, "mw")


def _phases(spark, d):
    events = _orders(spark, d).withColumns({"depth": (F.col("k") % 50) * 500.0, "magnitude": F.when(F.col("k") % 7 > 0, F.col("k") % 6 + 0.5), "horizontal_error": F.when(F.col("k") % 3 > 0, (F.col("k") % 9) * 250.0), "vertical_error": F.lit(500.0), "rms": F.lit(0.25)})
    picks = events.join(_lines(spark, d), "k").select("event", F.concat(F.lit("ST"), F.col("n").cast("string")).alias("station"), F.timestamp_micros(F.unix_micros("time") + F.col("n") * 1_250_000).alias("time"), (F.col("n") / 8).alias("weight"), F.when(F.col("n") % 2 == 0, "S").otherwise("P").alias("phase"))
    return events, picks


_PHASES = "ph AS (SELECT event, 'ST' || n AS station, epoch_us(time) + n * 1250000 AS time, n / 8.0 AS weight, CASE WHEN n % 2 = 0 THEN 'S' ELSE 'P' END AS phase, n FROM oe JOIN ol ON ol.k = oe.k)"


@query("SELECT event, epoch_us(time) AS time, latitude, longitude, k % 50 * 500.0 AS depth, CASE WHEN k % 7 > 0 THEN k % 6 + 0.5 END AS magnitude, CASE WHEN k % 3 > 0 THEN k % 9 * 250.0 END AS horizontal_error, 500.0 AS vertical_error, 0.25 AS rms FROM oe", _ORDERS)
def phase_list_events(spark, d):
    path = data.folder(spark)
    events, picks = _phases(spark, d)
    bulletins.write_phase_lists(events, picks, path)
    return bulletins.read_phase_lists(spark, path)[0].withColumn("time", F.unix_micros("time"))


@query("SELECT event, station, time, weight, phase FROM ph", _ORDERS, _LINES, _PHASES)
def phase_list_picks(spark, d):
    path = data.folder(spark)
    bulletins.write_phase_lists(*_phases(spark, d), path)
    return bulletins.read_phase_lists(spark, path)[1].withColumn("time", F.unix_micros("time"))


def _nordic(spark, d):
    events, picks = _phases(spark, d)
    events = events.withColumn("magnitude_type", F.when(F.col("magnitude").isNotNull(), "L"))
    picks = picks.withColumns({"component": F.lit("Z"), "weight": F.when(F.col("phase") == "P", 1).otherwise(2), "polarity": F.when(F.col("phase") == "P", "C")})
    path = data.folder(spark)
    bulletins.write_nordic(events, picks, path)
    return bulletins.read_nordic(spark, path)


@query("SELECT epoch_us(time) // 100000 * 100000 AS time, latitude, longitude, k % 50 * 500.0 AS depth, CASE WHEN k % 7 > 0 THEN k % 6 + 0.5 END AS magnitude, CASE WHEN k % 7 > 0 THEN 'L' END AS magnitude_type, round(0.25 + 0.01, 1) AS rms FROM oe", _ORDERS)
def nordic_events(spark, d):
    return _nordic(spark, d)[0].drop("event").withColumn("time", F.unix_micros("time"))


@query("SELECT station, 'Z' AS component, phase, CASE WHEN phase = 'P' THEN 1 ELSE 2 END AS weight, CASE WHEN phase = 'P' THEN 'C' END AS polarity, count(*) AS n, min(time // 10000 * 10000) AS first, max(time // 10000 * 10000) AS last FROM ph GROUP BY ALL", _ORDERS, _LINES, _PHASES)
def nordic_picks(spark, d):
    """Picks of Nordic blocks by station; some lie on the day after their event."""
    held = _nordic(spark, d)[1].withColumn("time", F.unix_micros("time"))
    return held.groupBy("station", "component", "phase", "weight", "polarity").agg(F.count("*").alias("n"), F.min("time").alias("first"), F.max("time").alias("last"))


_SOLVED = {"latitude": "latitude", "longitude": "longitude", "depth": "k % 600 + 0.5", "mb": "k % 9 + 0.5", "ms": "k % 8 + 0.5", "shift": "k % 20 - 0.5", "half_duration": "k % 30 + 0.25", "centroid_latitude": "latitude + 0.25", "centroid_longitude": "longitude - 0.125", "centroid_depth": "k % 500 + 1.5"}
_MOMENTS = {c: f"(k % {41 + i} - 20 + 0.125) * 1e17" for i, c in enumerate(("m_rr", "m_tt", "m_pp", "m_rt", "m_rp", "m_tp"))}


@query("SELECT concat('C', event) AS event, 'PDE' AS catalog, epoch_us(time) AS time, concat('NEAR PLACE ', k % 100) AS place, " + ", ".join([f"round({x}, 4) + 0.0 AS {c}" for c, x in _SOLVED.items()] + [f"round(({x}) / 1e16, 4) + 0.0 AS {c}" for c, x in _MOMENTS.items()]) + " FROM oe", _ORDERS)
def solution_round_trip(spark, d):
    """Centroid solutions, a figure a line."""
    rows = _orders(spark, d).withColumns({c: F.expr(x).cast("double") for c, x in (_SOLVED | _MOMENTS).items()})
    path = data.folder(spark)
    bulletins.write_solutions(rows.withColumns({"event": F.concat(F.lit("C"), "event"), "catalog": F.lit("PDE"), "place": F.concat(F.lit("NEAR PLACE "), F.col("k") % 100)}), path)
    held = bulletins.read_solutions(spark, path).withColumn("time", F.unix_micros("time"))
    return rounded(held.withColumns({c: F.col(c) / 1e16 for c in _MOMENTS}), 4, *_SOLVED, *_MOMENTS)


@query("SELECT event, epoch_us(time) AS time, latitude, longitude, CASE WHEN k % 5 > 0 THEN k % 600 * 1000.0 END AS depth, 'Mw' AS magnitude_type, k % 7 + 0.5 AS magnitude, concat('PLACE ', k % 9) AS place, CAST(NULL AS VARCHAR) AS author FROM oe", _ORDERS)
def event_text_round_trip(spark, d):
    rows = _orders(spark, d).withColumns({"depth": F.when(F.col("k") % 5 > 0, F.col("k") % 600 * 1000.0), "magnitude_type": F.lit("Mw"), "magnitude": F.col("k") % 7 + 0.5, "place": F.concat(F.lit("PLACE "), F.col("k") % 9)})
    path = data.folder(spark)
    tables.write_event_text(rows, path)
    return tables.read_event_text(spark, path).select("event", F.unix_micros("time").alias("time"), "latitude", "longitude", "depth", "magnitude_type", "magnitude", "place", "author")
