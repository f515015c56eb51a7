"""Queries of processing by name, of streams and catalogs as tables, of regions, calibration and mean spectra."""

from __future__ import annotations

from math import pi

import numpy as np
from pyspark.sql import functions as F

from ..functions import geodesy, text
from ..operators import calibration, collections, named
from . import data
from .data import QUAKES, SAMPLES, STATIONS, VECTORS
from .registry import query, rounded

# --- by name

_DETRENDS = "SELECT '{}' AS name, trace, idx, round({}, 6) + 0.0 AS y FROM (SELECT *, avg(x) OVER w AS m, arg_min(x, idx) OVER w AS a, arg_max(x, idx) OVER w AS z, count(*) OVER w AS n, regr_slope(x, idx) OVER w AS k, regr_intercept(x, idx) OVER w AS i FROM (SELECT trace, idx, x * pi() AS x FROM s) WINDOW w AS (PARTITION BY trace))"


@query(" UNION ALL ".join(_DETRENDS.format(*p) for p in (("demean", "x - m"), ("simple", "x - a - CASE WHEN n > 1 THEN idx * (z - a) / (n - 1) ELSE 0 END"), ("linear", "x - coalesce(i + k * idx, m)"))), SAMPLES)
def detrend_by_name(spark, d):
    rows = data.samples(spark, d).withColumn("x", F.col("x") * pi)
    parts = [named.apply("detrend", name, rows).select(F.lit(name).alias("name"), "trace", "idx", "y") for name in ("demean", "simple", "linear")]
    return rounded(collections.joined(*parts), 6, "y")


_CLASSIC = "SELECT 'classicstalta' AS name, trace, idx, round(CASE WHEN idx >= 11 THEN coalesce(avg(x * x) OVER a / nullif(avg(x * x) OVER b, 0), 0) ELSE 0 END, 6) AS cft FROM {0} WINDOW a AS (PARTITION BY trace ORDER BY idx ROWS 2 PRECEDING), b AS (PARTITION BY trace ORDER BY idx ROWS 11 PRECEDING)"
_Z = "SELECT 'zdetect', trace, idx, round((e - avg(e) OVER w) / nullif(stddev_pop(e) OVER w, 0), 6) + 0.0 FROM (SELECT trace, idx, CASE WHEN idx >= 4 THEN sum(x * x) OVER (PARTITION BY trace ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) ELSE 0 END AS e FROM {0}) WINDOW w AS (PARTITION BY trace)"


@query(_CLASSIC.format("s") + " UNION ALL " + _Z.format("s"), SAMPLES)
def trigger_by_name(spark, d):
    rows = data.samples(spark, d)
    parts = [named.apply("trigger", "classicSTALTA", rows, nsta=3, nlta=12), named.apply("trigger", "zdetect", rows, nsta=4)]
    out = [p.select(F.lit(n).alias("name"), "trace", "idx", "cft") for n, p in zip(("classicstalta", "zdetect"), parts, strict=True)]
    return rounded(out[0].union(out[1]), 6, "cft")


_DEAD = "dd AS (SELECT trace, idx, CASE WHEN trace % 3 = 0 OR idx % 40 < 20 THEN 0 ELSE x END AS x FROM s)"
_DELAYED = "SELECT 'delayedstalta', trace, idx, round(CASE WHEN idx >= 56 THEN (sum(a + b) OVER w / 2) / nullif(sum(c + e) OVER w / 4, 0) ELSE 0 END, 6) FROM (SELECT s.trace, s.idx, s.x * s.x AS a, p.x * p.x AS b, q.x * q.x AS c, r.x * r.x AS e FROM dd s JOIN (SELECT trace, count(*) AS n FROM dd GROUP BY 1) m ON m.trace = s.trace JOIN dd p ON p.trace = s.trace AND p.idx = (s.idx - 2 + n) % n JOIN dd q ON q.trace = s.trace AND q.idx = (s.idx - 3 + n) % n JOIN dd r ON r.trace = s.trace AND r.idx = (s.idx - 7 + n) % n WHERE n >= 7) WINDOW w AS (PARTITION BY trace ORDER BY idx)"


@query(_CLASSIC.format("dd") + " UNION ALL " + _Z.format("dd") + " UNION ALL " + _DELAYED, SAMPLES, _DEAD)
def triggers_of_dead_channels(spark, d):
    """The same on traces of which every third is silent and the others are in stretches."""
    rows = data.samples(spark, d).withColumn("x", F.when((F.col("trace") % 3 == 0) | (F.col("idx") % 40 < 20), 0.0).otherwise(F.col("x")))
    parts = [named.apply("trigger", "classicstalta", rows, nsta=3, nlta=12), named.apply("trigger", "zdetect", rows, nsta=4), named.apply("trigger", "delayedstalta", rows, nsta=2, nlta=4)]
    out = [p.select(F.lit(n).alias("name"), "trace", "idx", "cft") for n, p in zip(("classicstalta", "zdetect", "delayedstalta"), parts, strict=True)]
    return rounded(collections.joined(*out), 6, "cft")


# --- tables put together, picked and checked


@query("SELECT event, latitude, magnitude FROM q WHERE event % 4 = 0 UNION ALL SELECT event, NULL, magnitude FROM q WHERE event % 4 = 1", QUAKES)
def catalogs_joined(spark, d):
    """Two catalogs, of which the second has no places."""
    rows = data.quakes(spark, d)
    return collections.joined(rows.where("event % 4 = 0").select("event", "latitude", "magnitude"), rows.where("event % 4 = 1").select("event", "magnitude"))


@query("SELECT trace, idx, copy, x FROM s, (SELECT unnest([0, 1, 2]) AS copy)", SAMPLES)
def stream_repeated(spark, d):
    return collections.repeated(data.samples(spark, d), 3)


@query("SELECT place, event, magnitude FROM (SELECT *, row_number() OVER (ORDER BY magnitude NULLS FIRST, event) - 1 AS place, count(*) OVER () AS n FROM q) WHERE place >= 10 AND place < n - 5 AND (place - 10) % 7 = 0", QUAKES)
def catalog_slice(spark, d):
    """Every seventh event by magnitude, from the tenth to the sixth last."""
    return collections.picked(data.quakes(spark, d).select("event", "magnitude"), ["magnitude", "event"], 10, -5, 7)


@query("SELECT trace, idx, x FROM (SELECT *, count(*) OVER (PARTITION BY trace) AS n FROM s) WHERE idx >= greatest(n - 20, 0) AND idx < n - 2 AND (idx - greatest(n - 20, 0)) % 3 = 0", SAMPLES)
def trace_slice(spark, d):
    return collections.sample_slice(data.samples(spark, d), -20, -2, 3)


_LABELS = "lb AS (SELECT concat('N', trace % 4, '.', trace % 3) AS label, trace, idx, x, count(*) OVER (PARTITION BY trace) AS n, CASE WHEN trace % 12 = 5 THEN trace / 4.0 ELSE 0.0 END AS start FROM s)"


@query(
    "SELECT label, idx, round(avg(x), 6) + 0.0 AS y, any_value(traces) AS traces, NULL AS problem FROM lb JOIN lz USING (label) WHERE problem IS NULL AND idx < low GROUP BY label, idx UNION ALL SELECT label, NULL, NULL, traces, problem FROM lz WHERE problem IS NOT NULL",
    SAMPLES,
    _LABELS,
    "lz AS (SELECT label, min(n) AS low, count(DISTINCT trace) AS traces, CASE WHEN max(n) - min(n) > 20 THEN 'different lengths' WHEN max(start) - min(start) > 0.5 THEN 'different starts' END AS problem FROM lb GROUP BY 1)",
)
def stack_by_label(spark, d):
    """Stacks by a label made of codes, with tolerance for lengths and starts."""
    rows = data.samples(spark, d).withColumns({"network": F.concat(F.lit("N"), F.col("trace") % 4), "station": F.col("trace") % 3, "start": F.when(F.col("trace") % 12 == 5, F.col("trace") / 4).otherwise(0.0)})
    return rounded(collections.stack(rows, "{network}.{station}", samples_tolerance=20, time_tolerance=0.5), 6, "y")


@query(
    "SELECT trace, CASE WHEN trace % 11 = 0 THEN 'no sampling rate' WHEN trace % 7 = 0 THEN 'rate and interval differ' WHEN trace % 5 = 0 THEN 'other number of samples' WHEN trace % 3 = 0 THEN 'ends before its start' WHEN trace % 2 = 0 THEN 'end does not follow' END AS problem FROM (SELECT DISTINCT trace FROM s)", SAMPLES
)
def streams_checked(spark, d):
    k = F.col("trace")
    rows = data.samples(spark, d).groupBy("trace").agg(F.count("*").alias("samples"))
    rate = F.when(k % 11 == 0, 0.0).otherwise(20.0)
    heads = rows.withColumns({"rate": rate, "delta": F.when(k % 7 == 0, 0.1).otherwise(0.05), "npts": F.col("samples") + (k % 5 == 0).cast("int"), "start": F.lit(100.0)})
    end = F.when(k % 3 == 0, 99.0).otherwise(100.0 + (F.col("npts") - 1) / 20 + F.when(k % 2 == 0, 0.5).otherwise(0.0))
    return collections.checked(heads.withColumn("end", end))


# --- regions: a raster whose runs start every 30 degrees, with nations as names


@query(
    "SELECT event, number, n_name AS name FROM (SELECT event, ((latitude >= 0)::INT * 2 + (longitude >= 0)::INT + CAST(floor(abs(latitude)) AS INTEGER) + CAST(floor(abs(longitude) / 30) AS INTEGER) * 3) % 25 AS number FROM q) JOIN nation ON n_nationkey = number",
    QUAKES,
)
def event_regions(spark, d):
    """Region number and name of each event, by runs of longitude in bands of latitude."""
    flags = F.explode(F.array(F.lit(False), F.lit(True)))
    grid = spark.range(91).select(F.col("id").cast("int").alias("degree")).withColumn("north", flags).withColumn("east", flags).withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(180), F.lit(30))))
    number = (F.col("north").cast("int") * 2 + F.col("east").cast("int") + F.col("degree") + F.floor(F.col("start") / 30) * 3) % 25
    runs = grid.withColumn("number", number.cast("int"))
    names = data.table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("number"), F.col("n_name").alias("name"))
    return collections.regions(data.quakes(spark, d), runs, names).select("event", "number", "name")


# --- calibration and mean spectra

_TWO = (
    "hn AS (SELECT i, 0.5 - 0.5 * cos(2 * pi() * i / 31) AS w FROM (SELECT unnest(range(0, 32)) AS i))",
    "wn AS (SELECT trace, win, i, x * w AS x FROM v JOIN (SELECT unnest(range(0, 3)) AS win) ON idx BETWEEN 16 * win AND 16 * win + 31 JOIN hn ON i = idx - 16 * win)",
    "ft AS (SELECT trace, win, k, sum(x * cos(2 * pi() * k * i / 32)) AS re, -sum(x * sin(2 * pi() * k * i / 32)) AS im FROM wn, (SELECT unnest(range(0, 17)) AS k) GROUP BY 1, 2, 3)",
)


@query("SELECT trace, k, round(CASE WHEN k = 0 THEN max(CASE WHEN k = 1 THEN p END) OVER (PARTITION BY trace) ELSE p END, 8) AS power FROM (SELECT trace, k, avg(re * re + im * im) / (SELECT sum(w * w) FROM hn) AS p FROM ft GROUP BY 1, 2)", VECTORS, *_TWO)
def welch_spectra(spark, d):
    rows = data.vectors(spark, d).select(F.lit(0).alias("array"), F.col("trace").alias("station"), F.posexplode("data").alias("idx", "x"))
    return rounded(calibration.welch_spectra(rows, np.hanning(32), 32, 0.5).select(F.col("station").alias("trace"), "k", "power"), 8, "power")


@query(
    "SELECT trace AS array, k, k * 3.125 AS frequency, round(sqrt(re * re + im * im), 5) AS amplitude, round(cos(atan2(im, re)), 4) + 0.0 AS cosine, round(sin(atan2(im, re)), 4) + 0.0 AS sine FROM (SELECT trace, k, p * (1.0 + k) - q * (0.5 * k) AS re, p * (0.5 * k) + q * (1.0 + k) AS im FROM (SELECT b.trace - 1 AS trace, b.k, avg((b.re * a.re + b.im * a.im) / (a.re * a.re + a.im * a.im)) AS p, avg((b.re * a.im - b.im * a.re) / (a.re * a.re + a.im * a.im)) AS q FROM ft a JOIN ft b ON b.trace = a.trace + 1 AND b.win = a.win AND b.k = a.k WHERE a.trace % 2 = 0 AND a.k > 0 GROUP BY 1, 2))",
    VECTORS,
    *_TWO,
)
def relative_calibration(spark, d):
    """Response of every odd vector's sensor from that of the even one before it."""
    rows = data.vectors(spark, d).select((F.col("trace") - F.col("trace") % 2).alias("array"), F.when(F.col("trace") % 2 == 0, "known").otherwise("new").alias("station"), F.posexplode("data").alias("idx", "x"))
    known = spark.range(17).select(F.col("id").alias("k"), (1.0 + F.col("id")).alias("re"), (0.5 * F.col("id")).alias("im"))
    found = calibration.relative_response(rows, known, 32, 100.0)
    out = found.select("array", "k", "frequency", "amplitude", F.cos("phase").alias("cosine"), F.sin("phase").alias("sine"))
    return rounded(rounded(out, 5, "amplitude"), 4, "cosine", "sine")


# --- a local plane, lengths of transforms

_REDUCED = "atan(9.9330647e-1 * tan(({}) * 1.7453292e-2))"
_FLAT = (
    f"pl AS (SELECT *, 10.0 + station % 7 AS lon0, latitude / 2 + 1 AS lat0, {_REDUCED.format('latitude / 2 + 1')} AS u, {_REDUCED.format('latitude / 2 + 1 + 1 / 60.0')} AS v FROM st WHERE abs(latitude) < 80)",
    "pf AS (SELECT *, 6378.163 * (1 - pow(sin(u), 2) / 298.26) * (v - u) AS north, 6378.163 * (1 - pow(sin(u), 2) / 298.26) * acos(1 - (1 - cos(1.7453292e-2 / 60)) * pow(cos(u), 2)) / cos(u) AS east FROM pl)",
)


@query(
    f"SELECT station, round((longitude - lon0) * 60 * east * cos({_REDUCED.format('(latitude + lat0) / 2')}), 4) + 0.0 AS x, round((latitude - lat0) * 60 * north, 4) + 0.0 AS y, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude FROM pf",
    STATIONS,
    *_FLAT,
)
def local_plane(spark, d):
    """Kilometers from an origin, and degrees again from those."""
    rows = data.stations(spark, d).where("abs(latitude) < 80").withColumns({"lon0": 10.0 + F.col("station") % 7, "lat0": F.col("latitude") / 2 + 1})
    x, y = geodesy.to_plane(F.col("lon0"), F.col("lat0"), F.col("longitude"), F.col("latitude"))
    flat = rows.select("station", "lon0", "lat0", x.alias("x"), y.alias("y"))
    lon, lat = geodesy.from_plane(F.col("lon0"), F.col("lat0"), F.col("x"), F.col("y"))
    return rounded(rounded(flat.select("station", "x", "y", lon.alias("longitude"), lat.alias("latitude")), 4, "x", "y"), 6, "longitude", "latitude")


@query(
    "SELECT station, array_to_string(factors, ' ') AS factors, CASE WHEN twice <= 5000 OR list_max(f2) < 500 THEN twice ELSE coalesce((SELECT min(t) FROM tr WHERE tr.station = fa.station AND NOT EXISTS (SELECT 1 FROM pr WHERE p >= 500 AND tr.t % p = 0)), CAST(pow(2, ceil(log2(twice))) AS BIGINT)) END AS length FROM fa",
    STATIONS,
    "pr AS (SELECT n AS p FROM (SELECT unnest(range(2, 20000)) AS n) c WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(range(2, 142)) AS m) d WHERE m < n AND n % m = 0))",
    "nu AS (SELECT station, 2400 + station * 7 AS x, 2 * (2400 + station * 7 + (2400 + station * 7) % 2) AS twice FROM st)",
    "pw AS (SELECT station, p, e FROM nu, pr, (SELECT unnest(range(1, 15)) AS e) WHERE x % p = 0 AND x % pow(p, e) = 0)",
    "fa AS (SELECT nu.station, any_value(twice) AS twice, list(p ORDER BY p) AS factors, (SELECT list(p) FROM pr WHERE any_value(nu.twice) % p = 0) AS f2 FROM nu JOIN pw ON pw.station = nu.station GROUP BY 1)",
    "tr AS (SELECT station, twice + 2 * i AS t FROM nu, (SELECT unnest(range(1, 11)) AS i))",
)
def transform_lengths(spark, d):
    rows = data.stations(spark, d).select("station", (2400 + F.col("station") * 7).alias("x"))
    factors = F.array_join(F.transform(text.prime_factors(F.col("x")), lambda f: f.cast("string")), " ")
    return rows.select("station", factors.alias("factors"), text.transform_length(F.col("x")).alias("length"))
