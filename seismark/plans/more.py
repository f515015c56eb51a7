"""Further registered queries: merging with options, cutting and padding, interpolation, tapers, rotations back, archives, responses, arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geodesy, response, text
from ..operators import arrays, merging, segments, series
from ..streaming import processes
from . import data
from .data import DAYS, QUAKES, SAMPLES, STATIONS, TIMED, VECTORS
from .registry import query, rounded

# --- merging


_PIECES = "w AS (SELECT s.trace, k AS part, s.idx, s.x FROM s JOIN (SELECT trace, count(*) AS n FROM s GROUP BY 1) m ON m.trace = s.trace JOIN (SELECT unnest(range(0, 100000)) AS k) r ON r.k * 15 <= s.idx AND s.idx < r.k * 15 + 20 WHERE r.k * 15 + 20 <= m.n)"


def _pieces(spark, d, shift) -> DataFrame:
    """Segments of 20 samples that overlap by five; ``shift`` of the part is added to their values."""
    cut = series.slide(data.samples(spark, d), 20, 15).withColumnRenamed("window", "part")
    return cut.select("trace", "part", "idx", (F.col("x") + shift(F.col("part"))).alias("x"))


_OVERLAPS = "SELECT trace, idx, CASE WHEN part > 0 AND idx - part * 15 < 5 AND (part // 2 <> (part - 1) // 2) THEN {fill} ELSE round(x + part // 2, 6) END AS x FROM (SELECT *, row_number() OVER (PARTITION BY trace, idx ORDER BY part DESC) AS place FROM w) WHERE place = 1"


@query(_OVERLAPS.format(fill="NULL"), SAMPLES, _PIECES)
def merge_overlaps_to_gaps(spark, d):
    return rounded(merging.merge(_pieces(spark, d, lambda p: F.floor(p / 2)), 0), 6, "x")


@query(_OVERLAPS.format(fill="-7.0"), SAMPLES, _PIECES)
def merge_overlaps_filled(spark, d):
    return rounded(merging.merge(_pieces(spark, d, lambda p: F.floor(p / 2)), 0, fill=-7.0), 6, "x")


_LINES = "SELECT l.trace, l.idx, round(CASE WHEN l.part > 0 AND l.idx - l.part * 15 < {n} THEN a.x + 10 * (l.part - 1) + (b.x + 10 * l.part - a.x - 10 * (l.part - 1)) * (l.idx - l.part * 15 + 1) / {n1}.0 ELSE l.x + 10 * l.part END, 6) + 0.0 AS x FROM (SELECT *, row_number() OVER (PARTITION BY trace, idx ORDER BY part DESC) AS place FROM w) l LEFT JOIN s a ON a.trace = l.trace AND a.idx = l.part * 15 - 1 LEFT JOIN s b ON b.trace = l.trace AND b.idx = l.part * 15 + {n} WHERE place = 1"


@query(_LINES.format(n=2, n1=3), SAMPLES, _PIECES)
def merge_interpolate_two(spark, d):
    return rounded(merging.merge(_pieces(spark, d, lambda p: 10 * p), 1, 2), 6, "x")


@query(_LINES.format(n=5, n1=6), SAMPLES, _PIECES)
def merge_interpolate_overlap(spark, d):
    return rounded(merging.merge(_pieces(spark, d, lambda p: 10 * p), 1, -1), 6, "x")


# --- cutting, windows, frames


_ENDS = "ends AS (SELECT trace, min(idx) AS lo, max(idx) AS hi FROM d GROUP BY 1)"


@query("SELECT d.trace, idx, x FROM d JOIN ends ON ends.trace = d.trace WHERE idx BETWEEN floor(lo + 3.4 + 0.5) AND floor(hi - 2.6 + 0.5)", DAYS, _ENDS)
def trim_nearest(spark, d):
    return merging.trim(data.days(spark, d), F.col("lo") + 3.4, F.col("hi") - 2.6)


@query("SELECT d.trace, idx, x FROM d JOIN ends ON ends.trace = d.trace WHERE idx BETWEEN ceil(lo + 3.4) AND floor(hi - 2.6)", DAYS, _ENDS)
def trim_inwards(spark, d):
    return merging.trim(data.days(spark, d), F.col("lo") + 3.4, F.col("hi") - 2.6, nearest=False)


@query("SELECT trace, idx, x FROM d UNION ALL SELECT trace, unnest(range(lo - 2, lo)), 9.0 FROM ends UNION ALL SELECT trace, unnest(range(hi + 1, hi + 4)), 9.0 FROM ends", DAYS, _ENDS)
def trim_pad(spark, d):
    return merging.trim(data.days(spark, d), F.col("lo") - 2, F.col("hi") + 3, pad=True, fill=9.0)


_WINDOWS = "SELECT trace, k AS \"window\", lo + 1.5 + k * 20.0 AS start, least(lo + 1.5 + k * 20.0 + 50, hi) AS \"end\" FROM (SELECT trace, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, unnest(range(0, CAST(ceil((hi - lo - 1.5) / 20 - 0.001) AS BIGINT))) AS k FROM ends) WHERE {keep}"


def _ends(spark, d) -> DataFrame:
    return data.days(spark, d).groupBy("trace").agg(F.min("idx").cast("double").alias("start"), F.max("idx").cast("double").alias("end"))


@query(_WINDOWS.format(keep="least(lo + 1.5 + k * 20.0 + 50, hi) - (lo + 1.5 + k * 20.0) > 0.999 * 50"), DAYS, _ENDS)
def window_times_full(spark, d):
    return merging.window_times(_ends(spark, d), 50.0, 20.0, 1.5)


@query(_WINDOWS.format(keep="true"), DAYS, _ENDS)
def window_times_partial(spark, d):
    return merging.window_times(_ends(spark, d), 50.0, 20.0, 1.5, partial=True)


@query("SELECT trace, part AS \"window\", idx, round(x - avg(x) OVER (PARTITION BY trace, part), 6) + 0.0 AS y FROM w", SAMPLES, _PIECES)
def frames_demeaned(spark, d):
    return rounded(series.frames(data.samples(spark, d), 20, 15), 6, "y")


# --- interpolation, tapers


_STEPS = "p AS (SELECT trace, k, 0.3 + k * 0.7 AS pos, n FROM (SELECT trace, count(*) AS n FROM s GROUP BY 1), (SELECT unnest(range(0, 100000)) AS k) WHERE 0.3 + k * 0.7 <= n - 1)"


@query("SELECT p.trace, k, round(a.x + CASE WHEN b.x IS NULL THEN 0 ELSE (b.x - a.x) * (pos - a.idx) END, 5) + 0.0 AS y FROM p JOIN s a ON a.trace = p.trace AND a.idx = CAST(floor(pos) AS BIGINT) LEFT JOIN s b ON b.trace = p.trace AND b.idx = a.idx + 1", SAMPLES, _STEPS)
def interpolate_linear(spark, d):
    return rounded(series.interpolate(data.samples(spark, d), 0.3, 0.7), 5, "y")


@query("SELECT p.trace, k, a.x AS y FROM p JOIN s a ON a.trace = p.trace AND a.idx = CASE WHEN pos - floor(pos) < 0.5 THEN CAST(floor(pos) AS BIGINT) ELSE CAST(floor(pos) AS BIGINT) + 1 END", SAMPLES, _STEPS.replace("0.3 + k * 0.7", "0.31 + k * 0.45"))
def interpolate_nearest(spark, d):
    return series.interpolate(data.samples(spark, d), 0.31, 0.45, "nearest")


_FLANKS = "SELECT trace, idx, round(CASE WHEN pos < f THEN x * ({shape}) ELSE x END, 6) + 0.0 AS y FROM (SELECT *, {at} AS pos, CASE WHEN 2 * f = n THEN 2 * f ELSE 2 * f + 1 END AS m FROM (SELECT s.*, n, {flank} AS f FROM s JOIN (SELECT trace, count(*) AS n FROM s GROUP BY 1) c ON c.trace = s.trace))"


@query(_FLANKS.format(shape="0.5 - 0.5 * cos(2 * pi() * pos / (m - 1))", at="least(idx, n - 1 - idx)", flank="least(CAST(floor(n * 0.2) AS BIGINT), n // 2)"), SAMPLES)
def taper_hann(spark, d):
    return rounded(series.taper(data.samples(spark, d), "hann", 0.2).drop("x"), 6, "y")


@query(_FLANKS.format(shape="0.54 - 0.46 * cos(2 * pi() * pos / (m - 1))", at="idx", flank="least(3, n // 2)"), SAMPLES)
def taper_hamming_left(spark, d):
    return rounded(series.taper(data.samples(spark, d), "hamming", None, 3, "left").drop("x"), 6, "y")


@query(_FLANKS.format(shape="CASE WHEN m % 2 = 1 THEN 2.0 * (pos + 1) / (m + 1) ELSE (2.0 * pos + 1) / m END", at="n - 1 - idx", flank="least(CAST(floor(n * 0.5) AS BIGINT), 4, n // 2)"), SAMPLES)
def taper_triangle_right(spark, d):
    return rounded(series.taper(data.samples(spark, d), "triang", 0.5, 4, "right").drop("x"), 6, "y")


# --- rotations back


def _three(spark, d) -> DataFrame:
    """(trace, idx, a, b, c): a vector and the next two, sample by sample."""
    rows = data.vectors(spark, d).select("trace", F.col("data").alias("a"))
    later = lambda k, name: rows.select((F.col("trace") - k).alias("trace"), F.col("a").alias(name))
    sets = rows.join(later(1, "b"), "trace").join(later(2, "c"), "trace")
    return sets.select("trace", F.posexplode(F.arrays_zip("a", "b", "c")).alias("idx", "s")).select("trace", F.col("idx").cast("long").alias("idx"), "s.*")


_THREE = "u AS (SELECT a.trace, a.idx, a.x AS a, b.x AS b, c.x AS c, radians((a.trace * 7) % 360) AS ba, radians(a.trace % 90) AS i FROM v a JOIN v b ON b.trace = a.trace + 1 AND b.idx = a.idx JOIN v c ON c.trace = a.trace + 2 AND c.idx = a.idx)"


@query("SELECT trace, idx, round(-b * sin(ba - 2 * ba) - a * cos(ba), 8) + 0.0 AS n, round(-b * cos(ba) + a * sin(-ba), 8) + 0.0 AS e FROM u", VECTORS, _THREE)
def rotate_rt_ne(spark, d):
    """Radial and transverse back to north and east: the same rotation by 360 degrees less the back azimuth."""
    n, e = geodesy.rotate_ne_rt(F.col("a"), F.col("b"), F.radians(360 - (F.col("trace") * 7) % 360))
    return rounded(_three(spark, d).select("trace", "idx", n.alias("n"), e.alias("e")), 8, "n", "e")


@query("SELECT trace, idx, round(a * cos(i) + b * sin(i), 8) + 0.0 AS z, round(-a * sin(i) * cos(ba) + b * cos(i) * cos(ba) + c * sin(ba), 8) + 0.0 AS n, round(-a * sin(i) * sin(ba) + b * cos(i) * sin(ba) - c * cos(ba), 8) + 0.0 AS e FROM u", VECTORS, _THREE)
def rotate_lqt_zne(spark, d):
    i, ba = F.radians(F.col("trace") % 90), F.radians((F.col("trace") * 7) % 360)
    out = geodesy.rotate_lqt_zne(F.col("a"), F.col("b"), F.col("c"), ba, i)
    return rounded(_three(spark, d).select("trace", "idx", *[x.alias(name) for x, name in zip(out, "zne", strict=True)]), 8, "z", "n", "e")


@query("SELECT trace, idx, round(-a, 8) + 0.0 AS z, round((b - c) / sqrt(2), 8) + 0.0 AS n, round((b + c) / sqrt(2), 8) + 0.0 AS e FROM u", VECTORS, _THREE)
def rotate_any_zne(spark, d):
    """Components that point down, north-east and south-east."""
    out = geodesy.rotate_to_zne([F.col("a"), F.col("b"), F.col("c")], [(0.0, 90.0), (45.0, 0.0), (135.0, 0.0)])
    return rounded(_three(spark, d).select("trace", "idx", *[x.alias(name) for x, name in zip(out, "zne", strict=True)]), 8, "z", "n", "e")


# --- archives, codes, instants


def _archive(spark, d) -> DataFrame:
    """Paths of daily files, as an archive's folders hold them."""
    ts = F.col("ts").cast("timestamp")
    path = F.concat(F.date_format(ts, "yyyy"), F.lit("/XX/S"), F.col("user_id") % 40, F.lit("/"), F.upper(F.left("event_type", F.lit(3))), F.lit(".D/XX.S"), F.col("user_id") % 40, F.lit(".."), F.upper(F.left("event_type", F.lit(3))), F.lit(".D."), F.date_format(ts, "yyyy.DDD"))
    return data.table(spark, d, "events").select(path.alias("path")).distinct()


_ARCHIVE = "f AS (SELECT DISTINCT 'S' || (user_id % 40) AS station, upper(left(event_type, 3)) AS channel, CAST(ts AS DATE) AS day FROM events)"


@query("SELECT DISTINCT 'XX' AS network, station, '' AS location, channel FROM f", _ARCHIVE)
def archive_codes(spark, d):
    return segments.archive_files(_archive(spark, d)).select("network", "station", "location", "channel").distinct()


@query("SELECT station, count(DISTINCT channel) AS channels, CAST(min(day) AS VARCHAR) AS first, CAST(max(day) AS VARCHAR) AS last FROM f WHERE station LIKE 'S1%' GROUP BY 1", _ARCHIVE)
def archive_stations(spark, d):
    files = segments.archive_files(_archive(spark, d)).where(text.glob(F.col("station"), "S1*"))
    return files.groupBy("station").agg(F.countDistinct("channel").alias("channels"), F.min("day").cast("string").alias("first"), F.max("day").cast("string").alias("last"))


@query("SELECT station, channel, date_diff('day', max(day), (SELECT max(day) FROM f)) AS latency FROM f GROUP BY 1, 2", _ARCHIVE)
def archive_latency(spark, d):
    files = segments.archive_files(_archive(spark, d))
    now = files.agg(F.max("day").alias("_now"))
    last = files.groupBy("station", "channel").agg(F.max("day").alias("_last")).crossJoin(F.broadcast(now))
    return last.select("station", "channel", F.datediff("_now", "_last").cast("long").alias("latency"))


@query("SELECT event_id, epoch_us(date_trunc('day', ts)) AS ordinal, epoch_us(date_trunc('day', ts)) AS week, epoch_us(date_trunc('second', ts)) AS calendar FROM events")
def instants_parsed(spark, d):
    """Instants written as ordinal, week and calendar dates and read again."""
    ts = F.col("ts").cast("timestamp")
    week_year = F.year(F.date_add(ts.cast("date"), 3 - F.weekday(ts)))
    written = {
        "ordinal": F.date_format(ts, "yyyy-DDD"),
        "week": F.format_string("%04d-W%02d-%d", week_year, F.weekofyear(ts), F.weekday(ts) + 1),
        "calendar": F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
    }
    return data.table(spark, d, "events").select("event_id", *[F.unix_micros(text.parse_instant(x)).alias(name) for name, x in written.items()])


@query("SELECT event_id, CASE upper(left(event_type, 1)) WHEN 'F' THEN 0.001 WHEN 'C' THEN 0.004 WHEN 'D' THEN 0.004 WHEN 'E' THEN 0.0125 WHEN 'S' THEN 0.1 WHEN 'V' THEN 10 WHEN 'L' THEN 1 WHEN 'M' THEN 1 WHEN 'R' THEN 10000 WHEN 'P' THEN 1e6 WHEN 'U' THEN 100 WHEN 'H' THEN 0.0125 WHEN 'B' THEN 0.1 ELSE 0 END AS delta FROM events")
def band_code_delta(spark, d):
    return data.table(spark, d, "events").select("event_id", F.round(text.band_delta(F.upper("event_type")), 9).alias("delta"))


@query("SELECT trace, n, CAST(pow(2, floor(log2(n))) AS BIGINT) AS previous, CAST(pow(2, ceil(log2(n))) AS BIGINT) AS next, CAST(CASE WHEN pow(2, ceil(log2(n))) - n < n - pow(2, floor(log2(n))) THEN pow(2, ceil(log2(n))) ELSE pow(2, floor(log2(n))) END AS BIGINT) AS nearest FROM (SELECT trace, count(*) AS n FROM s GROUP BY 1)", SAMPLES)
def powers_of_two(spark, d):
    sizes = data.samples(spark, d).groupBy("trace").agg(F.count("*").alias("n"))
    return sizes.select("trace", "n", *[text.power_of_two(F.col("n"), which).alias(which) for which in ("previous", "next", "nearest")])


# --- metrics, responses, arrays


_RUNS = "g AS (SELECT trace, min(idx) AS start, count(*) AS samples, min(x) AS low, max(x) AS high, round(avg(x), 4) AS mean, round(sqrt(avg(x * x)), 3) AS rms, round(stddev_pop(x), 3) AS deviation FROM (SELECT trace, idx, x, idx - row_number() OVER (PARTITION BY trace ORDER BY idx) AS run FROM d) GROUP BY trace, run)"


@query("SELECT * FROM g", DAYS, _RUNS)
def segment_metrics(spark, d):
    rows = data.days(spark, d)
    runs = segments.islands(rows.select("trace", F.col("idx").alias("start"), (F.col("idx") + 1).alias("end")), 0)
    found = segments.epoch_join(rows, runs.select("trace", "start", "end"), "trace", "idx", 64)
    figures = found.groupBy("trace", "start").agg(F.count("*").alias("samples"), F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.stddev_pop("x").alias("deviation"))
    return rounded(rounded(figures, 4, "mean"), 3, "rms", "deviation")


@query("SELECT trace, round(quantile_cont(x, 0.3), 6) AS score FROM s WHERE x > 5 AND x < 95 GROUP BY 1", SAMPLES)
def score_within_limits(spark, d):
    """Interpolated percentile of the values within open limits."""
    return rounded(data.samples(spark, d).where("x > 5 AND x < 95").groupBy("trace").agg(F.percentile("x", 0.3).alias("score")), 6, "score")


_FREQUENCY = "fr AS (SELECT event_id, 0.05 + abs(value) / 10 AS f, 1 + abs(value) AS a, 10.0 + event_id % 300 AS km FROM events)"


def _frequencies(spark, d) -> DataFrame:
    return data.table(spark, d, "events").select("event_id", (0.05 + F.abs("value") / 10).alias("f"), (1 + F.abs("value")).alias("a"), (10.0 + F.col("event_id") % 300).alias("km"))


@query("SELECT event_id, round(CASE WHEN f BETWEEN 0.5 AND 2 THEN 0.5 * (1 - cos(pi() * (f - 0.5) / 1.5)) WHEN f > 2 AND f < 6 THEN 1 WHEN f BETWEEN 6 AND 9 THEN 0.5 * (1 + cos(pi() * (f - 6) / 3)) ELSE 0 END, 8) + 0.0 AS weight FROM fr", _FREQUENCY)
def frequency_taper(spark, d):
    return rounded(_frequencies(spark, d).select("event_id", response.cosine_frequency_taper(F.col("f"), 0.5, 2.0, 6.0, 9.0).alias("weight")), 8, "weight")


_PENDULUM = "pow(2 * pi() * {f}, 2) / (sqrt(pow(0.707 * 2 * pi() * 1.5, 2) + pow(2 * pi() * {f} - sqrt(1 - pow(0.707, 2)) * 2 * pi() * 1.5, 2)) * sqrt(pow(0.707 * 2 * pi() * 1.5, 2) + pow(2 * pi() * {f} + sqrt(1 - pow(0.707, 2)) * 2 * pi() * 1.5, 2)))"
_WOOD = "2 * pi() * {f} / (sqrt(pow(6.283, 2) + pow(2 * pi() * {f} - 4.7124, 2)) * sqrt(pow(6.283, 2) + pow(2 * pi() * {f} + 4.7124, 2)))"


@query(f"SELECT event_id, round({_PENDULUM.format(f='f')}, 9) AS amplitude FROM fr", _FREQUENCY)
def response_amplitude(spark, d):
    return rounded(_frequencies(spark, d).select("event_id", response.amplitude(response.corner_response(1.5), F.col("f")).alias("amplitude")), 9, "amplitude")


@query(f"SELECT event_id, round(log10(a / 2 / ({_PENDULUM.format(f='f')}) * ({_WOOD.format(f='f')}) * 2080 * 1000) + log10(km / 100) + 0.00301 * (km - 100) + 3, 6) AS magnitude FROM fr", _FREQUENCY)
def magnitude_estimate(spark, d):
    """Local magnitude from a peak-to-peak amplitude over half a period."""
    mm = response.wood_anderson_amplitude(response.corner_response(1.5), F.col("a"), 1 / (2 * F.col("f")))
    return rounded(_frequencies(spark, d).select("event_id", response.local_magnitude(mm, F.col("km")).alias("magnitude")), 6, "magnitude")


_PLACES = "pl AS (SELECT station, network % 4 AS network, latitude / 100 - avg(latitude / 100) OVER (PARTITION BY network % 4) AS y, longitude / 100 - avg(longitude / 100) OVER (PARTITION BY network % 4) AS x FROM st)"


def _places(spark, d) -> DataFrame:
    rows = data.stations(spark, d).select("station", (F.col("network") % 4).alias("network"), (F.col("longitude") / 100).alias("x"), (F.col("latitude") / 100).alias("y"))
    return arrays.centred(rows, "network", "x", "y")


@query("SELECT station, sx, sy, round(x * sx + y * sy, 8) + 0.0 AS delay FROM pl, (SELECT -0.4 + i * 0.2 AS sx, -0.4 + j * 0.2 AS sy FROM (SELECT unnest(range(0, 5)) AS i), (SELECT unnest(range(0, 5)) AS j))".replace("-0.4 + i * 0.2 AS sx, -0.4 + j * 0.2 AS sy", "round(-0.4 + i * 0.2, 6) + 0.0 AS sx, round(-0.4 + j * 0.2, 6) + 0.0 AS sy"), STATIONS, _PLACES)
def array_time_shifts(spark, d):
    return rounded(rounded(arrays.time_shifts(_places(spark, d), -0.4, 0.2, 5), 6, "sx", "sy").select("station", "sx", "sy", "delay"), 8, "delay")


@query("SELECT network, round(kx, 6) + 0.0 AS kx, round(ky, 6) + 0.0 AS ky, round(pow(avg(cos(kx * x + ky * y)), 2) + pow(avg(sin(kx * x + ky * y)), 2), 8) + 0.0 AS power FROM pl, (SELECT -3.0 + i AS kx, -3.0 + j AS ky FROM (SELECT unnest(range(0, 7)) AS i), (SELECT unnest(range(0, 7)) AS j)) GROUP BY network, kx, ky", STATIONS, _PLACES)
def array_transfer(spark, d):
    return rounded(rounded(arrays.transfer_wavenumber(_places(spark, d), "network", 3.0, 1.0), 6, "kx", "ky"), 8, "power")


_NEAR = "n AS (SELECT q.event, st.station, round(degrees(acos(least(1, greatest(-1, sin(radians(q.latitude)) * sin(radians(st.latitude)) + cos(radians(q.latitude)) * cos(radians(st.latitude)) * cos(radians(st.longitude - q.longitude)))))), 5) AS degrees FROM q, st)"


@query("SELECT event, arg_min(station, struct_pack(a := degrees, b := station)) AS station, min(degrees) AS degrees FROM n WHERE degrees <= 25.3 GROUP BY 1", QUAKES, STATIONS, _NEAR)
def nearest_station(spark, d):
    """The nearest station of each event, if one lies within 25.3 degrees."""
    events = data.quakes(spark, d).select("event", "latitude", "longitude")
    return geodesy.nearest(events, "event", data.stations(spark, d), "station", 25.3, 5)


# --- streams


def _stream(spark, d, process) -> DataFrame:
    return processes.finish(processes.run_process(data.packets(spark, d), process), data.folder(spark))


@query("SELECT user_id AS trace, epoch_us(ts) * 64 + event_id % 64 AS t, round(value * 2.5, 6) AS y FROM events")
def rt_scale(spark, d):
    return rounded(_stream(spark, d, processes.scale(2.5)), 6, "y")


@query("SELECT user_id AS trace, epoch_us(ts) * 64 + event_id % 64 AS t, round(value + 7.25, 6) AS y FROM events")
def rt_offset(spark, d):
    return rounded(_stream(spark, d, processes.offset(7.25)), 6, "y")
