"""Queries of spectral densities by octaves, running periods and moments, tables as text, instants, metadata lookups and checks."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geodesy, text
from ..operators import arrays, catalog, correlation, segments, series
from ..operators import spectra_histogram as ppsd
from ..sources import tables
from ..streaming import processes
from . import data
from .data import PACKETS, QUAKES, SAMPLES, STATIONS, TIMED, VECTORS
from .registry import query, rounded

# --- power spectral densities: segments, overlapping windows, octaves

_WINDOWS = (
    "wn AS (SELECT trace, b AS win, idx - 8 * b AS idx, x FROM v, (SELECT unnest(range(0, 5)) AS b) WHERE idx >= 8 * b AND idx < 8 * b + 32)",
    "dt AS (SELECT wn.trace, wn.win, wn.idx, (wn.x - (i + k * wn.idx)) * w AS x, w FROM wn JOIN (SELECT trace, win, regr_slope(x, idx) AS k, regr_intercept(x, idx) AS i FROM wn GROUP BY 1, 2) m ON m.trace = wn.trace AND m.win = wn.win JOIN (SELECT i AS j, CASE WHEN least(i, 31 - i) < 3 THEN 0.5 * (1 - cos(pi() * least(i, 31 - i) / 2)) ELSE 1 END AS w FROM (SELECT unnest(range(0, 32)) AS i)) ON j = wn.idx)",
    "pw AS (SELECT trace, win, k, (pow(sum(x * cos(2 * pi() * k * idx / 32)), 2) + pow(sum(x * sin(2 * pi() * k * idx / 32)), 2)) / (100 * sum(w * w)) * CASE WHEN k = 16 THEN 1 ELSE 2 END AS p FROM dt, (SELECT unnest(range(1, 17)) AS k) GROUP BY 1, 2, 3)",
    "av AS (SELECT trace, k, 10 * log10(avg(p) * pow(2 * pi() * 3.125 * k, 2)) AS db FROM pw GROUP BY 1, 2)",
    "oc AS (SELECT j, 0.02 * pow(2, j / 8.0) AS period FROM (SELECT unnest(range(0, 33)) AS j))",
    "ps AS (SELECT trace, j AS bin, any_value(period) AS period, avg(db) AS db FROM av JOIN oc ON 0.32 / k BETWEEN period / sqrt(2) * (1 - 1e-9) AND period * sqrt(2) * (1 + 1e-9) GROUP BY 1, 2)",
)


def _densities(spark, d) -> DataFrame:
    """Squared accelerations from velocities with unit response."""
    return ppsd.octave_densities(data.vectors(spark, d).select("trace", "data"), "data", 100.0, 32, 24)


@query("SELECT trace, bin, round(period, 6) AS period, round(db, 5) AS db FROM ps", VECTORS, *_WINDOWS)
def psd_octaves(spark, d):
    return rounded(rounded(_densities(spark, d), 6, "period"), 5, "db")


@query("SELECT trace, round(db, 5) AS db FROM ps WHERE bin = (SELECT arg_min(j, abs(period - 0.1)) FROM oc)", VECTORS, *_WINDOWS)
def psd_at_period(spark, d):
    return rounded(ppsd.at_period(_densities(spark, d), "trace", 0.1), 5, "db")


@query("SELECT round(period, 6) AS period, greatest(least(CAST(ceil((db + 60) / 5) - 1 AS BIGINT), 19), 0) AS bin, count(*) AS n FROM ps GROUP BY 1, 2", VECTORS, *_WINDOWS)
def psd_chain_histogram(spark, d):
    return ppsd.histogram(rounded(_densities(spark, d), 6, "period"), -60, 40, 5)


# --- running periods and moments

_PERIODS = "dv AS (SELECT trace, t, x, (x - coalesce(lag(x) OVER (PARTITION BY trace ORDER BY t), x)) / 0.5 AS v FROM pk)"


@query("SELECT trace, t, round(CASE WHEN sum(v * v) OVER w > 1e-20 THEN 2 * pi() * sqrt(sum(x * x) OVER w / sum(v * v) OVER w) ELSE 0 END, 6) AS y FROM dv WINDOW w AS (PARTITION BY trace ORDER BY t ROWS 9 PRECEDING)", PACKETS, _PERIODS)
def rt_tauc(spark, d):
    return rounded(processes.finish(processes.run_process(data.packets(spark, d), processes.dominant_period(0.5, 10)), data.folder(spark)), 6, "y")


@query("SELECT trace, idx, round(CASE WHEN sum(v * v) OVER w > 1e-20 THEN 2 * pi() * sqrt(sum(x * x) OVER w / sum(v * v) OVER w) ELSE 0 END, 6) AS y FROM (SELECT *, (x - coalesce(lag(x) OVER (PARTITION BY trace ORDER BY idx), x)) / 0.5 AS v FROM s) WINDOW w AS (PARTITION BY trace ORDER BY idx ROWS 9 PRECEDING)", SAMPLES)
def dominant_periods(spark, d):
    return rounded(series.dominant_period(data.samples(spark, d), 10, 0.5).drop("x"), 6, "y")


_MOMENTS = (
    "pk0 AS (SELECT s.trace, s.idx, s.x - p.x AS a FROM s JOIN s p ON p.trace = s.trace AND p.idx = 5 WHERE s.idx >= 5 AND s.idx < 35)",
    "tu AS (SELECT *, CASE WHEN (a >= 0) = lag(a >= 0) OVER (PARTITION BY trace ORDER BY idx) THEN 0 ELSE 1 END AS turn FROM pk0)",
    "ru AS (SELECT *, sum(turn) OVER (PARTITION BY trace ORDER BY idx) AS run FROM tu)",
    "mw AS (SELECT trace, idx, sum(a) OVER (PARTITION BY trace, run ORDER BY idx) * 0.01 / 2.5 AS y FROM ru)",
)


@query("SELECT trace, idx, round(y, 7) + 0.0 AS y FROM mw", SAMPLES, *_MOMENTS)
def moment_integral(spark, d):
    return rounded(series.moment_integral(data.samples(spark, d), 5, 30, 0.01, 2.5), 7, "y")


@query("SELECT trace, round(2.0 / 3 * (log10(max(abs(y)) * (1 + trace % 90) * (4 * pi() * 3400 * pow(7900, 3) * 2 * (10000 / 90.0) * 1000)) - 9.1), 6) AS magnitude FROM mw GROUP BY 1 HAVING max(abs(y)) > 0", SAMPLES, *_MOMENTS)
def moment_magnitude(spark, d):
    peaks = series.moment_integral(data.samples(spark, d), 5, 30, 0.01, 2.5).groupBy("trace").agg(F.max(F.abs("y")).alias("peak")).where("peak > 0")
    return rounded(peaks.select("trace", series.moment_magnitude(F.col("peak"), 1 + F.col("trace") % 90).alias("magnitude")), 6, "magnitude")


# --- window sums, tapers, correlation without demeaning or norm


@query("SELECT trace, idx, round(y, 6) + 0.0 AS y FROM (SELECT trace, idx, sum(x) OVER w AS y, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY trace ORDER BY idx ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) WHERE n = 8", SAMPLES)
def window_sums(spark, d):
    return rounded(series.window_sum(data.samples(spark, d), 8), 6, "y")


@query("SELECT s.trace, idx, round(CASE WHEN idx IN (0, n - 1) THEN 0 WHEN idx < (n + 1) // 2 THEN x * pi() * (1 - pow(((n + 1) // 2 - 1 - idx) / ((n + 1) // 2)::DOUBLE, 2)) ELSE x * pi() * (1 - pow((idx - (n + 1) // 2) / (n // 2)::DOUBLE, 2)) END, 6) + 0.0 AS y FROM s JOIN (SELECT trace, count(*) AS n FROM s GROUP BY 1) m ON m.trace = s.trace", SAMPLES)
def taper_welch(spark, d):
    return rounded(series.taper_welch(data.samples(spark, d).withColumn("x", F.col("x") * pi)).drop("x"), 6, "y")


_NEXT = (
    "pr AS (SELECT a.trace, a.idx, a.x AS a, b.x AS b FROM v a JOIN v b ON b.trace = a.trace + 1 AND b.idx = a.idx)",
    "pm AS (SELECT trace, idx, a - avg(a) OVER (PARTITION BY trace) AS a, b - avg(b) OVER (PARTITION BY trace) AS b FROM pr)",
)
_LAGGED = "SELECT p.trace, lag + 4 AS place, round(sum(q.a * p.b){norm}, 7) + 0.0 AS cc FROM {source} p JOIN (SELECT unnest(range(-4, 5)) AS lag) ON true JOIN {source} q ON q.trace = p.trace AND q.idx = p.idx + lag JOIN (SELECT trace, sqrt(sum(a * a) * sum(b * b)) AS norm FROM {source} GROUP BY 1) n ON n.trace = p.trace GROUP BY 1, 2"


def _neighbours(spark, d) -> DataFrame:
    rows = data.vectors(spark, d).select("trace", F.col("data").alias("a"))
    return rows.join(rows.select((F.col("trace") - 1).alias("trace"), F.col("a").alias("b")), "trace")


@query(_LAGGED.format(source="pm", norm=" / any_value(norm)"), VECTORS, *_NEXT)
def xcorr_demeaned(spark, d):
    cc = correlation.correlate(F.col("a"), F.col("b"), 4, demean=True)
    return rounded(_neighbours(spark, d).select("trace", F.posexplode(cc).alias("place", "cc")).withColumn("place", F.col("place").cast("long")), 7, "cc")


@query(_LAGGED.format(source="pr", norm=""), VECTORS, *_NEXT)
def xcorr_without_norm(spark, d):
    cc = correlation.correlate(F.col("a"), F.col("b"), 4, normalize=False)
    return rounded(_neighbours(spark, d).select("trace", F.posexplode(cc).alias("place", "cc")).withColumn("place", F.col("place").cast("long")), 7, "cc")


@query("SELECT sx, sy, round(sum(wt * (re * re + im * im)) / sum(wt), 8) + 0.0 AS power, network FROM (SELECT network, f, wt, round(-0.2 + i * 0.1, 6) + 0.0 AS sx, round(-0.2 + j * 0.1, 6) + 0.0 AS sy, avg(cos(2 * pi() * f * (x * (-0.2 + i * 0.1) + y * (-0.2 + j * 0.1)))) AS re, avg(sin(2 * pi() * f * (x * (-0.2 + i * 0.1) + y * (-0.2 + j * 0.1)))) AS im FROM pl, (SELECT unnest(range(0, 5)) AS i), (SELECT unnest(range(0, 5)) AS j), (SELECT 1.0 + k * 0.5 AS f, CASE WHEN k IN (0, 4) THEN 0.5 ELSE 1 END AS wt FROM (SELECT unnest(range(0, 5)) AS k)) GROUP BY network, f, wt, i, j) GROUP BY network, sx, sy", STATIONS, "pl AS (SELECT station, network % 4 AS network, latitude / 100 - avg(latitude / 100) OVER (PARTITION BY network % 4) AS y, longitude / 100 - avg(longitude / 100) OVER (PARTITION BY network % 4) AS x FROM st)")
def array_transfer_slowness(spark, d):
    rows = data.stations(spark, d).select("station", (F.col("network") % 4).alias("network"), (F.col("longitude") / 100).alias("x"), (F.col("latitude") / 100).alias("y"))
    power = arrays.transfer_slowness(arrays.centred(rows, "network", "x", "y"), "network", 0.2, 0.1, 1.0, 3.0, 0.5)
    return rounded(rounded(power, 6, "sx", "sy"), 8, "power")


@query("SELECT event, round(degrees * 6371 * 2 * pi() / 360, 6) AS km, round(degrees * 10 / (6371 * 2 * pi() / 360), 8) AS degrees, CASE WHEN azimuth < 180 THEN azimuth + 180 ELSE azimuth - 180 END AS back FROM (SELECT event, abs(longitude) AS degrees, longitude + 180 AS azimuth FROM q)", QUAKES)
def arc_lengths(spark, d):
    """Degrees as kilometers, kilometers (ten a degree) as degrees, and the back azimuth of an azimuth."""
    rows = data.quakes(spark, d).select("event", F.abs("longitude").alias("deg"), (F.col("longitude") + 180).alias("azimuth"))
    out = rows.select("event", geodesy.degrees_to_kilometers(F.col("deg")).alias("km"), geodesy.kilometers_to_degrees(F.col("deg") * 10).alias("degrees"), geodesy.back_azimuth(F.col("azimuth")).alias("back"))
    return rounded(rounded(out, 6, "km"), 8, "degrees")


# --- instants

_CLOCK = "date_part('year', ts) AS y, dayofyear(ts) AS j, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS i, second(ts) AS s, CAST(microsecond(ts) % 1000000 AS BIGINT) AS u"


@query(
    f"SELECT event_id, CASE WHEN h + i + s + u = 0 THEN printf('%04d,%03d', y, j) ELSE printf('%04d,%03d,%02d:%02d:%02d.%04d', y, j, h, i, s, u // 100) END AS seed, CASE WHEN u > 0 THEN printf('%04d,%03d,%02d:%02d:%02d.%04d', y, j, h, i, s, u // 100) WHEN s > 0 THEN printf('%04d,%03d,%02d:%02d:%02d', y, j, h, i, s) WHEN i > 0 THEN printf('%04d,%03d,%02d:%02d', y, j, h, i) WHEN h > 0 THEN printf('%04d,%03d,%02d', y, j, h) ELSE printf('%04d,%03d', y, j) END AS seed_compact, printf('%04d%03dT%02d%02d%02d.%04dZ', y, j, h, i, s, u // 100) AS fissures, printf('%d,%d,%d,%d,%d,%d,%d', y, m, d, h, i, s, u) AS arclink, printf('%d,%d,%d,%d,%d,%d', y, m, d, h, i, s) AS seedlink, printf('%04d-%02d-%02dT%02d:%02d:%02d.%03d', y, m, d, h, i, s, u // 1000) AS iris FROM (SELECT event_id, {_CLOCK} FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ts WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('minute', ts) WHEN 3 THEN date_trunc('hour', ts) ELSE date_trunc('day', ts) END AS ts FROM events))"
)
def instant_formats(spark, d):
    ts = F.col("ts").cast("timestamp")
    cut = F.col("event_id") % 5
    instant = F.when(cut == 0, ts).when(cut == 1, F.date_trunc("second", ts)).when(cut == 2, F.date_trunc("minute", ts)).when(cut == 3, F.date_trunc("hour", ts)).otherwise(F.date_trunc("day", ts))
    rows = data.table(spark, d, "events").select("event_id", instant.alias("t"))
    return rows.select("event_id", *[text.format_instant(F.col("t"), style).alias(style) for style in ("seed", "seed_compact", "fissures", "arclink", "seedlink", "iris")])


@query("SELECT event_id, epoch_us(ts + INTERVAL 90 MINUTE) AS later, epoch_us(date_trunc('day', ts) + INTERVAL 25 HOUR + INTERVAL 61 MINUTE) AS carried, epoch_us(date_trunc('year', ts)) + (dayofyear(ts) % 365) * 86400000000 AS other_day FROM events")
def instant_arithmetic(spark, d):
    """Seconds added, hours and minutes beyond their range, and a day of the year replaced."""
    ts = F.col("ts").cast("timestamp")
    day, year = F.date_trunc("day", ts), F.date_trunc("year", ts)
    return data.table(spark, d, "events").select(
        "event_id",
        F.unix_micros(text.add_seconds(ts, F.lit(5400.0))).alias("later"),
        F.unix_micros(text.add_seconds(day, F.lit(25 * 3600.0 + 61 * 60))).alias("carried"),
        F.unix_micros(text.add_seconds(year, (F.dayofyear(ts) % 365) * 86400.0)).alias("other_day"),
    )


# --- tables as text

_CHANNELS = "ch AS (SELECT c_mktsegment AS network, 'S' || (c_nationkey) AS station, CASE WHEN c_custkey % 3 <> 0 THEN lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') END AS location, 'C' || c_custkey AS channel, CAST(c_custkey % 90 AS DOUBLE) AS latitude, CAST(c_custkey % 180 AS DOUBLE) AS longitude, c_acctbal AS elevation, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey / 4.0 END AS depth, CAST(c_custkey % 360 AS DOUBLE) AS azimuth, CASE WHEN c_custkey % 7 <> 0 THEN -90.0 END AS dip, CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_custkey AS DOUBLE) END AS scale, CASE WHEN c_custkey % 2 = 0 THEN 100.0 ELSE 0.5 END AS samplerate, CAST(c_custkey AS BIGINT) * 60000000 AS starttime, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey AS BIGINT) * 120000000 END AS endtime FROM customer)"


def _channels(spark, d) -> DataFrame:
    c = F.col("c_custkey")
    return data.table(spark, d, "customer").select(
        F.col("c_mktsegment").alias("network"),
        F.concat(F.lit("S"), "c_nationkey").alias("station"),
        F.when(c % 3 != 0, F.lpad((c % 100).cast("string"), 2, "0")).alias("location"),
        F.concat(F.lit("C"), c).alias("channel"),
        (c % 90).cast("double").alias("latitude"),
        (c % 180).cast("double").alias("longitude"),
        F.col("c_acctbal").alias("elevation"),
        F.when(c % 5 != 0, c / 4).alias("depth"),
        (c % 360).cast("double").alias("azimuth"),
        F.when(c % 7 != 0, F.lit(-90.0)).alias("dip"),
        F.when(c % 11 != 0, c.cast("double")).alias("scale"),
        F.when(c % 2 == 0, 100.0).otherwise(0.5).alias("samplerate"),
        F.timestamp_micros(c * 60_000_000).alias("starttime"),
        F.when(c % 4 != 0, F.timestamp_micros(c * 120_000_000)).alias("endtime"),
    )


def _as_micros(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.unix_micros(c) for c in ("starttime", "endtime")})


@query("SELECT * FROM ch", _CHANNELS)
def channel_text_round_trip(spark, d):
    path = data.folder(spark)
    tables.write_station_text(_channels(spark, d), path, "channel")
    return _as_micros(tables.read_station_text(spark, path, "channel")).drop("sensordescription", "scalefreq", "scaleunits")


@query("SELECT network, station, max(elevation) AS elevation, min(starttime) AS starttime, count(*) AS channels FROM ch GROUP BY 1, 2", _CHANNELS)
def stations_of_channels(spark, d):
    path = data.folder(spark)
    tables.write_station_text(_channels(spark, d), path, "channel")
    rows = _as_micros(tables.read_station_text(spark, path, "channel"))
    return rows.groupBy("network", "station").agg(F.max("elevation").alias("elevation"), F.min("starttime").alias("starttime"), F.count("*").alias("channels"))


@query("SELECT network, count(*) AS totalstations, min(starttime) AS starttime FROM ch GROUP BY 1", _CHANNELS)
def network_text_round_trip(spark, d):
    path = data.folder(spark)
    networks = _channels(spark, d).groupBy("network").agg(F.count("*").alias("totalstations"), F.min("starttime").alias("starttime"))
    tables.write_station_text(networks, path, "network")
    return tables.read_station_text(spark, path, "network").select("network", "totalstations", F.unix_micros("starttime").alias("starttime"))


@query("SELECT CAST(event AS VARCHAR) AS event, epoch_us(time) + (event % 60) * 1000000 + 300000 AS t, latitude, longitude, depth * 1000 AS depth, magnitude FROM q", QUAKES)
def event_csv_parts_round_trip(spark, d):
    """A comma-separated catalog whose times stand in six columns and depths in kilometers; missing numbers are nan."""
    path = data.folder(spark)
    t = F.col("time")
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nan"))
    cells = [F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.minute(t), F.format_string("%.1f", F.col("event") % 60 + 0.3), F.lit("x"), *[number(c) for c in ("latitude", "longitude", "depth", "magnitude")], F.col("event")]
    data.quakes(spark, d).select(F.concat_ws(",", *[c.cast("string") for c in cells])).write.text(path)
    rows = tables.read_event_csv(spark, path, "year mon day hour minu sec _ lat lon dep mag id")
    return rows.select("event", F.unix_micros("time").alias("t"), "latitude", "longitude", "depth", "magnitude")


# --- metadata lookups and checks

_EPOCHS = "ep AS (SELECT p_partkey % 150 AS trace, a + (p_partkey // 150) * w AS start, CASE WHEN (p_partkey // 150) % 3 <> 2 THEN a + (p_partkey // 150 + 1) * w END AS stop, 2.0 + p_partkey % 7 AS gain, CAST(p_partkey % 360 AS DOUBLE) AS azimuth, CAST(p_partkey % 181 - 90 AS DOUBLE) AS dip FROM part, (SELECT min(epoch_us(ts)) AS a, (max(epoch_us(ts)) - min(epoch_us(ts))) // 3 + 1 AS w FROM events))"


def _epochs(spark, d) -> DataFrame:
    span = data.timed(spark, d).agg(F.min("t").alias("a"), (F.floor((F.max("t") - F.min("t")) / 3) + 1).alias("w"))
    number, key = F.floor(F.col("p_partkey") / 150), F.col("p_partkey")
    return data.table(spark, d, "part").crossJoin(F.broadcast(span)).select(
        (key % 150).alias("trace"),
        (F.col("a") + number * F.col("w")).alias("start"),
        F.when(number % 3 != 2, F.col("a") + (number + 1) * F.col("w")).alias("end"),
        (2.0 + key % 7).alias("gain"),
        (key % 360).cast("double").alias("azimuth"),
        (key % 181 - 90).cast("double").alias("dip"),
    )


_HELD = "FROM e JOIN ep ON ep.trace = e.trace AND e.t >= ep.start AND (ep.stop IS NULL OR e.t < ep.stop)"


@query(f"SELECT e.event_id, round(x / gain, 7) + 0.0 AS y, gain {_HELD}", TIMED, _EPOCHS)
def remove_sensitivity(spark, d):
    held = segments.epoch_join(data.timed(spark, d), _epochs(spark, d), "trace", "t", 86_400_000_000)
    return rounded(held.select("event_id", F.try_divide("x", "gain").alias("y"), "gain"), 7, "y")


@query(f"SELECT e.trace, min(azimuth) AS azimuth_low, max(azimuth) AS azimuth_high, min(dip) AS dip_low, max(dip) AS dip_high, count(*) AS samples {_HELD} GROUP BY 1", TIMED, _EPOCHS)
def orientation_lookup(spark, d):
    held = segments.epoch_join(data.timed(spark, d), _epochs(spark, d), "trace", "t", 86_400_000_000)
    return held.groupBy("trace").agg(F.min("azimuth").alias("azimuth_low"), F.max("azimuth").alias("azimuth_high"), F.min("dip").alias("dip_low"), F.max("dip").alias("dip_high"), F.count("*").alias("samples"))


_COMMON = "cm AS (SELECT trace, max(lo) AS lo, min(hi) AS hi FROM (SELECT trace, channel, min(t) AS lo, max(t) AS hi FROM e GROUP BY 1, 2) GROUP BY 1)"


@query("SELECT event_id, e.trace, channel, t FROM e JOIN cm ON cm.trace = e.trace WHERE t BETWEEN lo AND hi", TIMED, _COMMON)
def trim_common_channels(spark, d):
    return segments.trim_common(data.timed(spark, d), ["trace"], "channel", "t").drop("x")


@query("SELECT trace, count(DISTINCT channel) AS rates, CASE WHEN count(DISTINCT channel) > 1 THEN 'differing channel' END AS problem FROM e GROUP BY 1", TIMED)
def merge_checks(spark, d):
    """Channels stand for the headers that segments to be merged must share."""
    found = segments.merge_checks(data.timed(spark, d), "trace", ["channel"])
    return found.select("trace", F.col("n_channel").alias("rates"), "problem")


@query("SELECT DISTINCT l_orderkey AS event, l_linenumber AS origin FROM lineitem JOIN (SELECT o_orderkey, 1 + o_custkey % 4 AS wanted FROM orders) ON o_orderkey = l_orderkey AND wanted = l_linenumber")
def preferred_origin(spark, d):
    wanted = data.table(spark, d, "orders").select(F.col("o_orderkey").alias("event"), (1 + F.col("o_custkey") % 4).alias("wanted"))
    origins = data.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_linenumber").alias("origin"))
    return catalog.preferred(origins.join(wanted, "event"), "event", "wanted", "origin").select("event", "origin")


@query("SELECT network, station, channel FROM ch WHERE starttime <= 9000000000 AND (endtime IS NULL OR endtime >= 9000000000)", _CHANNELS)
def active_channels(spark, d):
    """Channels whose epoch holds an instant, open ends included."""
    rows = _as_micros(_channels(spark, d))
    return rows.where(segments.active(F.col("starttime"), F.col("endtime"), F.lit(9_000_000_000))).select("network", "station", "channel")
