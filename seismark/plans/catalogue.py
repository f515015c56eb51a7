"""The registered queries and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geodesy, text
from ..operators import catalog, correlation, segments, series
from ..operators import spectra_histogram as ppsd
from ..sources import sac, tables, text_series
from ..streaming import processes
from . import archives, bulletins, data, detecting, further, handling, more, polarizing, splines, timefreq, trees, waveforms  # noqa: F401 - these register queries of their own
from .data import DAYS, PACKETS, QUAKES, SAMPLES, STATIONS, TIMED, VECTORS
from .registry import ORACLES, QUERIES, query, rounded

DAY_US = 86_400_000_000


# --- selection, slicing, windowing


@query("SELECT event_id, user_id, event_type FROM events WHERE upper(event_type) LIKE '%L%' AND CAST(user_id AS VARCHAR) GLOB '1*'")
def select_glob(spark, d):
    rows = data.table(spark, d, "events").select("event_id", "user_id", "event_type")
    return catalog.select_codes(rows.withColumn("station", F.col("user_id").cast("string")), event_type="*l*", station="1*").drop("station")


@query("SELECT event_id, user_id, event_type FROM events WHERE NOT (upper(event_type) LIKE 'C%' AND CAST(user_id AS VARCHAR) GLOB '[12]*')")
def remove_glob(spark, d):
    rows = data.table(spark, d, "events").select("event_id", "user_id", "event_type")
    return catalog.remove_codes(rows.withColumn("station", F.col("user_id").cast("string")), event_type="c*", station="[12]*").drop("station")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type, ts, event_id) AS place FROM events")
def sort_traces(spark, d):
    order = Window.partitionBy("user_id").orderBy("event_type", "ts", "event_id")
    return data.table(spark, d, "events").select("event_id", F.row_number().over(order).cast("long").alias("place"))


_EDGES = "b AS (SELECT trace, min(t) + (max(t) - min(t)) // 4 AS a, min(t) + 3 * ((max(t) - min(t)) // 4) AS z FROM e GROUP BY trace)"


def _edges(rows: DataFrame) -> DataFrame:
    quarter = F.floor((F.max("t") - F.min("t")) / 4)
    return rows.groupBy("trace").agg((F.min("t") + quarter).alias("a"), (F.min("t") + 3 * quarter).alias("z"))


@query("SELECT event_id, e.trace, t, x FROM e JOIN b ON e.trace = b.trace WHERE t BETWEEN a AND z", TIMED, _EDGES)
def trim_window(spark, d):
    rows = data.timed(spark, d)
    return rows.join(_edges(rows), "trace").where(F.col("t").between(F.col("a"), F.col("z"))).select("event_id", "trace", "t", "x")


@query("SELECT event_id, e.trace, CASE WHEN t < a THEN 0 ELSE 1 END AS piece FROM e JOIN b ON e.trace = b.trace WHERE t < a OR t > z", TIMED, _EDGES)
def cutout_window(spark, d):
    rows = data.timed(spark, d)
    cut = rows.join(_edges(rows), "trace").where((F.col("t") < F.col("a")) | (F.col("t") > F.col("z")))
    return cut.select("event_id", "trace", F.when(F.col("t") < F.col("a"), 0).otherwise(1).alias("piece"))


@query(
    "SELECT s.trace AS trace, w.k AS window, count(*) AS n, round(sum(x), 4) AS total FROM s JOIN (SELECT trace, max(idx) + 1 AS n FROM s GROUP BY 1) m ON s.trace = m.trace JOIN (SELECT unnest(range(0, 100000)) AS k) w ON w.k * 5 <= s.idx AND s.idx < w.k * 5 + 20 WHERE w.k * 5 + 20 <= m.n GROUP BY 1, 2",
    SAMPLES,
)
def slide_windows(spark, d):
    return rounded(series.slide(data.samples(spark, d), 20, 5).groupBy("trace", "window").agg(F.count("*").alias("n"), F.sum("x").alias("total")), 4, "total")


@query("SELECT event_id, (t - min(t) OVER (PARTITION BY trace)) / 1000000.0 AS relative FROM e", TIMED)
def relative_times(spark, d):
    rows = data.timed(spark, d)
    first = rows.groupBy("trace").agg(F.min("t").alias("first"))
    return rows.join(first, "trace").select("event_id", ((F.col("t") - F.col("first")) / 1e6).alias("relative"))


@query("SELECT trace, idx // 16 AS piece, count(*) AS samples, min(x) AS low, max(x) AS high FROM s GROUP BY 1, 2", SAMPLES)
def pieces_of_n(spark, d):
    return data.samples(spark, d).groupBy("trace", F.floor(F.col("idx") / 16).alias("piece")).agg(F.count("*").alias("samples"), F.min("x").alias("low"), F.max("x").alias("high"))


@query("SELECT trace, least(idx // ((n + 3) // 4), 3) AS piece, count(*) AS samples FROM (SELECT *, count(*) OVER (PARTITION BY trace) AS n FROM s) GROUP BY 1, 2", SAMPLES)
def equal_pieces(spark, d):
    rows = data.samples(spark, d)
    sizes = rows.groupBy("trace").agg(F.count("*").alias("n"))
    return rows.join(sizes, "trace").groupBy("trace", F.least(F.floor(F.col("idx") / F.floor((F.col("n") + 3) / 4)), F.lit(3)).alias("piece")).agg(F.count("*").alias("samples"))


@query("SELECT trace, idx // 4 AS idx, x FROM v WHERE idx % 4 = 0", VECTORS)
def decimate_plain(spark, d):
    every = F.expr("filter(data, (x, i) -> i % 4 = 0)")
    return data.vectors(spark, d).select("trace", F.posexplode(every).alias("idx", "x")).withColumn("idx", F.col("idx").cast("long"))


# --- gaps, merging, availability


_RUNS = "g AS (SELECT trace, min(idx) AS a, max(idx) + 1 AS z, count(*) AS n FROM (SELECT trace, idx, idx - row_number() OVER (PARTITION BY trace ORDER BY idx) AS run FROM d) GROUP BY trace, run)"


def _day_runs(spark, d) -> DataFrame:
    rows = data.days(spark, d).select("trace", F.col("idx").alias("start"), (F.col("idx") + 1).alias("end"))
    return segments.islands(rows, 0)


@query("SELECT trace, a AS start, z AS \"end\", n AS segments FROM g", DAYS, _RUNS)
def availability(spark, d):
    return _day_runs(spark, d)


@query("SELECT trace, prev AS gap_start, a AS gap_end, a - prev AS days FROM (SELECT *, lag(z) OVER (PARTITION BY trace ORDER BY a) AS prev FROM g) WHERE prev IS NOT NULL", DAYS, _RUNS)
def gaps(spark, d):
    runs = _day_runs(spark, d).withColumn("end", F.col("end") - 1)
    found = segments.gaps(runs, 1)
    return found.select("trace", (F.col("gap_start") + 1).alias("gap_start"), "gap_end", F.col("samples").alias("days"))


@query("SELECT trace, round(sum(least(z, 9500) - greatest(a, 8500)) / 1000.0, 6) AS share, count(*) - 1 AS gaps FROM g WHERE z > 8500 AND a < 9500 GROUP BY trace", DAYS, _RUNS)
def availability_percentage(spark, d):
    return rounded(segments.cover(_day_runs(spark, d), 8500, 9500), 6, "share")


@query("SELECT trace, channel, min(t) AS earliest, max(t) AS latest, count(*) AS samples FROM e GROUP BY 1, 2", TIMED)
def index_summary(spark, d):
    return data.timed(spark, d).groupBy("trace", "channel").agg(F.min("t").alias("earliest"), F.max("t").alias("latest"), F.count("*").alias("samples"))


@query("SELECT DISTINCT trace, channel FROM e", TIMED)
def distinct_codes(spark, d):
    return data.timed(spark, d).select("trace", "channel").distinct()


@query("SELECT o_custkey AS trace, min(o_orderdate) AS earliest, max(o_orderdate) AS latest, count(DISTINCT CAST(o_orderdate AS DATE)) AS days FROM orders GROUP BY 1")
def availability_extent(spark, d):
    return data.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("trace")).agg(F.min("o_orderdate").alias("earliest"), F.max("o_orderdate").alias("latest"), F.countDistinct(F.col("o_orderdate").cast("date")).alias("days"))


_PARTS = "p AS (SELECT l_orderkey AS trace, l_linenumber AS part, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) // 30 AS idx, l_quantity AS x FROM lineitem)"


def _parts(spark, d) -> DataFrame:
    """Order lines as overlapping segments: one sample per month, the line number tells the segment."""
    month = F.floor(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")) / 30)
    return data.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trace"), F.col("l_linenumber").alias("part"), month.alias("idx"), F.col("l_quantity").alias("x"))


@query("SELECT trace, idx, CASE WHEN min(x) = max(x) THEN max(x) END AS x FROM p GROUP BY 1, 2", _PARTS)
def merge_conflicts_to_gaps(spark, d):
    return segments.merge_samples(_parts(spark, d), 0)


@query("SELECT trace, idx, arg_max(x, struct_pack(a := part, b := x)) AS x FROM p GROUP BY 1, 2", _PARTS)
def merge_later_wins(spark, d):
    return segments.merge_samples(_parts(spark, d), 1)


@query("SELECT trace, idx, min(x) AS x FROM p WHERE trace NOT IN (SELECT trace FROM p GROUP BY trace, idx HAVING min(x) <> max(x)) GROUP BY 1, 2", _PARTS)
def cleanup_agreeing(spark, d):
    return segments.cleanup(_parts(spark, d))


_GRID = "f AS (SELECT r.trace, r.idx, d.x FROM (SELECT trace, unnest(range(min(idx), max(idx) + 1)) AS idx FROM d GROUP BY trace) r LEFT JOIN d ON d.trace = r.trace AND d.idx = r.idx)"


@query("SELECT trace, idx, last_value(x IGNORE NULLS) OVER (PARTITION BY trace ORDER BY idx) AS x FROM f", DAYS, _GRID)
def fill_latest(spark, d):
    return segments.fill(data.days(spark, d), "latest")


@query(
    "SELECT trace, idx, coalesce(x, x0 + (x1 - x0) * (idx - i0) / (i1 - i0)) AS x FROM (SELECT trace, idx, x, last_value(x IGNORE NULLS) OVER a AS x0, first_value(x IGNORE NULLS) OVER b AS x1, last_value(CASE WHEN x IS NOT NULL THEN idx END IGNORE NULLS) OVER a AS i0, first_value(CASE WHEN x IS NOT NULL THEN idx END IGNORE NULLS) OVER b AS i1 FROM f WINDOW a AS (PARTITION BY trace ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY trace ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))",
    DAYS,
    _GRID,
)
def fill_interpolate(spark, d):
    return segments.fill(data.days(spark, d), "interpolate")


@query("SELECT trace, idx, coalesce(x, -1.0) AS x FROM f", DAYS, _GRID)
def fill_constant(spark, d):
    return segments.fill(data.days(spark, d), -1.0)


# --- point-wise and whole-trace operators


@query("SELECT s.trace, idx, round(x - m, 9) + 0.0 AS y FROM s JOIN (SELECT trace, avg(x) AS m FROM s GROUP BY 1) a ON s.trace = a.trace", SAMPLES)
def demean(spark, d):
    return rounded(series.demean(data.samples(spark, d)).drop("x"), 9, "y")


@query("SELECT s.trace, idx, round(x - (f + CASE WHEN n > 0 THEN idx * (l - f) / n ELSE 0 END), 9) + 0.0 AS y FROM s JOIN (SELECT trace, arg_min(x, idx) AS f, arg_max(x, idx) AS l, max(idx) AS n FROM s GROUP BY 1) a ON s.trace = a.trace", SAMPLES)
def detrend_simple(spark, d):
    return rounded(series.detrend_simple(data.samples(spark, d)).drop("x"), 9, "y")


@query("SELECT s.trace, idx, round(x - coalesce(i + k * idx, m), 5) + 0.0 AS y FROM s JOIN (SELECT trace, CASE WHEN count(*) > 1 THEN regr_slope(x, idx) END AS k, CASE WHEN count(*) > 1 THEN regr_intercept(x, idx) END AS i, avg(x) AS m FROM s GROUP BY 1) a ON s.trace = a.trace", SAMPLES)
def detrend_linear(spark, d):
    return rounded(series.detrend_linear(data.samples(spark, d)).drop("x"), 5, "y")


@query("SELECT s.trace, idx, round(x / m, 6) + 0.0 AS y FROM s JOIN (SELECT trace, max(abs(x)) AS m FROM s GROUP BY 1) a ON s.trace = a.trace", SAMPLES)
def normalize(spark, d):
    return rounded(series.normalize(data.samples(spark, d)).drop("x"), 6, "y")


@query("SELECT trace, idx, round(x / (SELECT max(abs(x)) FROM s), 6) + 0.0 AS y FROM s", SAMPLES)
def normalize_global(spark, d):
    return rounded(series.normalize(data.samples(spark, d), over_all=True).drop("x"), 6, "y")


@query("SELECT trace, idx, round((coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x)) / nullif((lead(x) OVER w IS NOT NULL)::INT + (lag(x) OVER w IS NOT NULL)::INT, 0), 6) + 0.0 AS y FROM s WINDOW w AS (PARTITION BY trace ORDER BY idx)", SAMPLES)
def differentiate(spark, d):
    return rounded(series.differentiate(data.samples(spark, d)).drop("x"), 6, "y")


@query("SELECT trace, idx, round(sum(h) OVER (PARTITION BY trace ORDER BY idx), 4) + 0.0 AS y FROM (SELECT trace, idx, coalesce((x + lag(x) OVER (PARTITION BY trace ORDER BY idx)) / 2, 0) AS h FROM s)", SAMPLES)
def integrate_cumtrapz(spark, d):
    return rounded(series.integrate(data.samples(spark, d)).drop("x"), 4, "y")


@query(
    "SELECT trace, idx, round(coalesce(y, first_value(y IGNORE NULLS) OVER (PARTITION BY trace ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), last_value(y IGNORE NULLS) OVER (PARTITION BY trace ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)), 5) + 0.0 AS y FROM (SELECT trace, idx, CASE WHEN count(*) OVER (PARTITION BY trace ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 7 THEN (sum(x) OVER (PARTITION BY trace ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) - x) / 6 END AS y FROM s)",
    SAMPLES,
)
def smooth(spark, d):
    return rounded(series.smooth(data.samples(spark, d), 3).drop("x"), 5, "y")


@query("SELECT trace, arg_max(x, struct_pack(a := abs(x), b := -idx)) AS largest, round(stddev_pop(x), 6) AS std FROM s GROUP BY 1", SAMPLES)
def max_and_std(spark, d):
    return rounded(data.samples(spark, d).groupBy("trace").agg(F.max_by("x", F.struct(F.abs("x"), -F.col("idx"))).alias("largest"), F.stddev_pop("x").alias("std")), 6, "std")


@query("SELECT trace, idx, round(x * CASE WHEN idx < 6 THEN 0.5 * (1 - cos(pi() * idx / 5)) WHEN idx >= 58 THEN 0.5 * (1 + cos(pi() * (idx - 58) / 5)) ELSE 1 END, 9) + 0.0 AS y FROM v", VECTORS)
def taper_cosine(spark, d):
    rise = lambda i: 0.5 * (1 - F.cos(F.lit(3.141592653589793) * i / 5))
    fall = lambda i: 0.5 * (1 + F.cos(F.lit(3.141592653589793) * (i - 58) / 5))
    tapered = F.transform("data", lambda x, i: x * F.when(i < 6, rise(i)).when(i >= 58, fall(i)).otherwise(1.0))
    return rounded(data.vectors(spark, d).select("trace", F.posexplode(tapered).alias("idx", "y")).withColumn("idx", F.col("idx").cast("long")), 9, "y")


# --- triggers


_STA = "c AS (SELECT trace, idx, CASE WHEN idx >= 19 THEN avg(x * x) OVER (PARTITION BY trace ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / avg(x * x) OVER (PARTITION BY trace ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) ELSE 0 END AS cft FROM s)"
_ONSET = "o AS (SELECT trace, min(CASE WHEN round(cft, 6) >= 1.5 THEN idx END) AS on_idx, max(idx) AS off_idx FROM (SELECT *, idx - row_number() OVER (PARTITION BY trace ORDER BY idx) AS run FROM c WHERE round(cft, 6) >= 1.0) GROUP BY trace, run HAVING min(CASE WHEN round(cft, 6) >= 1.5 THEN idx END) IS NOT NULL)"


def _cft(spark, d) -> DataFrame:
    return rounded(series.classic_sta_lta(data.samples(spark, d), 5, 20), 6, "cft")


@query("SELECT trace, idx, round(cft, 6) AS cft FROM c", SAMPLES, _STA)
def classic_sta_lta(spark, d):
    return _cft(spark, d).drop("x")


@query()
def recursive_sta_lta(spark, d):
    return rounded(series.recursive_sta_lta(data.samples(spark, d), 3, 10), 6, "cft").withColumn("idx", F.col("idx").cast("long"))


ORACLES["recursive_sta_lta"] = (
    f"WITH RECURSIVE {SAMPLES}, r AS (SELECT trace, idx, 0.0::DOUBLE AS sta, 1e-99::DOUBLE AS lta FROM s WHERE idx = 0 UNION ALL SELECT s.trace, s.idx, x * x / 3.0 + (1 - 1.0::DOUBLE / 3) * sta, x * x / 10.0 + (1 - 1.0::DOUBLE / 10) * lta FROM r JOIN s ON s.trace = r.trace AND s.idx = r.idx + 1) "
    "SELECT trace, idx, round(CASE WHEN idx < 10 THEN 0 ELSE sta / lta END, 6) AS cft FROM r"
)


@query(
    "SELECT z.trace, idx, round((e - m) / sd, 5) + 0.0 AS cft FROM z JOIN (SELECT trace, avg(e) AS m, nullif(stddev_pop(e), 0) AS sd FROM z GROUP BY 1) a ON a.trace = z.trace",
    SAMPLES,
    "z AS (SELECT trace, idx, CASE WHEN idx >= 5 THEN sum(x * x) OVER (PARTITION BY trace ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) ELSE 0 END AS e FROM s)",
)
def z_detect(spark, d):
    return rounded(series.z_detect(data.samples(spark, d), 5).drop("x"), 5, "cft")


_ENERGY = "r AS (SELECT trace, idx, x, CASE WHEN idx >= 5 AND count(*) OVER f = 5 AND sum(x * x) OVER p > 0 THEN sum(x * x) OVER f / sum(x * x) OVER p ELSE 0 END AS er FROM s WINDOW p AS (PARTITION BY trace ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY trace ORDER BY idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))"


@query("SELECT trace, idx, round(er, 5) AS cft FROM r", SAMPLES, _ENERGY)
def energy_ratio(spark, d):
    return rounded(series.energy_ratio(data.samples(spark, d), 5).drop("x"), 5, "cft")


@query("SELECT trace, idx, round(log10(1 + pow(er * abs(x), 3)), 5) AS cft FROM r", SAMPLES, _ENERGY)
def modified_energy_ratio(spark, d):
    return series.modified_energy_ratio(data.samples(spark, d), 5).select("trace", "idx", F.round(F.log10(1 + F.col("cft")), 5).alias("cft"))


@query(
    "SELECT trace, idx, CASE WHEN idx >= 1 AND n - idx - 1 >= 2 AND lv > 1e-9 AND rv > 1e-9 THEN round((idx + 1) * ln(lv) + (n - idx - 2) * ln(rv), 2) + 0.0 END AS cft FROM (SELECT *, q / (idx + 1) - pow(a / (idx + 1), 2) AS lv, CASE WHEN n > idx + 1 THEN (Q2 - q) / (n - idx - 1) - pow((A2 - a) / (n - idx - 1), 2) END AS rv FROM (SELECT trace, idx, count(*) OVER (PARTITION BY trace) AS n, sum(x) OVER w AS a, sum(x * x) OVER w AS q, sum(x) OVER (PARTITION BY trace) AS A2, sum(x * x) OVER (PARTITION BY trace) AS Q2 FROM s WINDOW w AS (PARTITION BY trace ORDER BY idx)))",
    SAMPLES,
)
def aic_simple(spark, d):
    return rounded(series.aic_simple(data.samples(spark, d)).drop("x"), 2, "cft")


@query("SELECT trace, on_idx, off_idx FROM o", SAMPLES, _STA, _ONSET)
def trigger_onset(spark, d):
    return series.trigger_onset(_cft(spark, d), 1.5, 1.0)


@query(
    "SELECT min(a) AS start, max(z) AS \"end\", count(DISTINCT trace) AS stations, count(*) AS triggers FROM (SELECT *, sum(fresh) OVER (ORDER BY a, z, trace ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN a > coalesce(max(z) OVER (ORDER BY a, z, trace ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS fresh FROM w)) GROUP BY g HAVING count(DISTINCT trace) >= 2",
    TIMED,
    "w AS (SELECT trace, t - t % 60000000 AS a, t - t % 60000000 + 3600000000 AS z FROM e WHERE x > 90)",
)
def coincidence(spark, d):
    rows = data.timed(spark, d).where("x > 90")
    minute = F.col("t") - F.col("t") % 60_000_000
    return series.coincidences(rows.select("trace", minute.alias("a"), (minute + 3_600_000_000).alias("z")), "a", "z", "trace", 2)


# --- aggregation


@query("SELECT trace, t // 86400000000 AS bucket, round(max(x) - min(x), 6) AS peak_to_peak, count(*) AS samples FROM e GROUP BY 1, 2", TIMED)
def preview_minmax(spark, d):
    return rounded(series.preview(data.timed(spark, d), F.col("t") / 1e6, 86400), 6, "peak_to_peak")


@query(
    "SELECT trace, count(*) AS samples, min(x) AS sample_min, max(x) AS sample_max, round(avg(x), 9) AS sample_mean, round(quantile_cont(x, 0.5), 6) AS sample_median, round(quantile_cont(x, 0.25), 6) AS sample_lower_quartile, round(quantile_cont(x, 0.75), 6) AS sample_upper_quartile, round(sqrt(avg(x * x)), 6) AS sample_rms, round(stddev_pop(x), 6) AS sample_stdev FROM s GROUP BY 1",
    SAMPLES,
)
def quality_metrics(spark, d):
    out = series.statistics(data.samples(spark, d))
    return rounded(rounded(out, 9, "sample_mean"), 6, "sample_median", "sample_lower_quartile", "sample_upper_quartile", "sample_rms", "sample_stdev")


@query("SELECT label, idx, round(avg(x), 7) + 0.0 AS y FROM v GROUP BY 1, 2", VECTORS)
def stack_linear(spark, d):
    rows = data.vectors(spark, d).select("label", F.posexplode("data").alias("idx", "x"))
    return rounded(rows.groupBy("label", F.col("idx").cast("long").alias("idx")).agg(F.avg("x").alias("y")), 7, "y")


@query("SELECT label, idx, round(sign(m) * m * m, 7) + 0.0 AS y FROM (SELECT label, idx, avg(sign(x) * sqrt(abs(x))) AS m FROM v GROUP BY 1, 2)", VECTORS)
def stack_root(spark, d):
    rows = data.vectors(spark, d).select("label", F.posexplode("data").alias("idx", "x"))
    mean = rows.groupBy("label", F.col("idx").cast("long").alias("idx")).agg(F.avg(F.signum("x") * F.sqrt(F.abs("x"))).alias("m"))
    return rounded(mean.select("label", "idx", (F.signum("m") * F.col("m") * F.col("m")).alias("y")), 7, "y")


@query("SELECT network, round(degrees(atan2(avg(sin(radians(longitude))), avg(cos(radians(longitude))))), 6) + 0.0 AS longitude FROM st GROUP BY 1", STATIONS)
def mean_longitude(spark, d):
    out = data.stations(spark, d).groupBy("network").agg(F.degrees(F.atan2(F.avg(F.sin(F.radians("longitude"))), F.avg(F.cos(F.radians("longitude"))))).alias("longitude"))
    return rounded(out, 6, "longitude")


@query("SELECT trace, round(regr_slope(y, t), 6) + 0.0 AS slope, round(regr_intercept(y, t), 4) + 0.0 AS intercept, round(corr(y, t), 6) + 0.0 AS correlation FROM (SELECT l_returnflag || l_linestatus AS trace, l_quantity AS t, l_extendedprice AS y FROM lineitem) GROUP BY 1")
def linear_regression(spark, d):
    rows = data.table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("trace"), F.col("l_quantity").alias("t"), F.col("l_extendedprice").alias("y"))
    out = rows.groupBy("trace").agg(F.regr_slope("y", "t").alias("slope"), F.regr_intercept("y", "t").alias("intercept"), F.corr("y", "t").alias("correlation"))
    return rounded(rounded(out, 6, "slope", "correlation"), 4, "intercept")


_PSD = "h AS (SELECT event_type AS period, least(greatest(CAST(ceil((value - 10) / 5) AS BIGINT) - 1, 0), 15) AS bin, count(*) AS n FROM events GROUP BY 1, 2)"


def _histogram(spark, d) -> DataFrame:
    return ppsd.histogram(data.table(spark, d, "events").select(F.col("event_type").alias("period"), F.col("value").alias("db")), 10, 90, 5)


@query("SELECT * FROM h", _PSD)
def ppsd_histogram(spark, d):
    return _histogram(spark, d)


@query("SELECT period, min(bin) * 5.0 + 15 AS db FROM (SELECT *, sum(n) OVER (PARTITION BY period ORDER BY bin) * 100.0 / sum(n) OVER (PARTITION BY period) AS share FROM h) WHERE share >= 50 GROUP BY 1", _PSD)
def ppsd_percentile(spark, d):
    return ppsd.percentile(_histogram(spark, d), 50, 10.0, 5.0)


@query("SELECT period, arg_max(bin, struct_pack(a := n, b := -bin)) * 5.0 + 12.5 AS db FROM h GROUP BY 1", _PSD)
def ppsd_mode(spark, d):
    return ppsd.mode(_histogram(spark, d), 10.0, 5.0)


@query("SELECT period, round(sum(n * (bin * 5.0 + 12.5)) / sum(n), 6) AS db FROM h GROUP BY 1", _PSD)
def ppsd_mean(spark, d):
    return rounded(ppsd.mean(_histogram(spark, d), 10.0, 5.0), 6, "db")


@query("SELECT event_type AS period, count(*) AS segments, round(avg(value), 6) AS mean FROM events WHERE isodow(ts) IN (1, 3, 5) AND hour(ts) + minute(ts) / 60.0 + second(ts) / 3600.0 BETWEEN 6 AND 18 GROUP BY 1")
def ppsd_calendar(spark, d):
    rows = data.table(spark, d, "events").where(ppsd.calendar(F.col("ts").cast("timestamp"), weekdays=[1, 3, 5], hours=(6, 18)))
    return rounded(rows.groupBy(F.col("event_type").alias("period")).agg(F.count("*").alias("segments"), F.avg("value").alias("mean")), 6, "mean")


# --- catalogs, stations, geometry


@query("SELECT * FROM q WHERE coalesce(magnitude >= 2, false) AND coalesce(depth < 300, true) AND latitude > -60", QUAKES)
def catalog_filter(spark, d):
    return catalog.filter_catalog(data.quakes(spark, d).withColumn("time", F.col("time").cast("timestamp_ntz")), "magnitude >= 2", "depth < 300", "latitude > -60")


@query("SELECT * FROM q WHERE NOT (coalesce(magnitude >= 2, false) AND coalesce(depth < 300, true) AND latitude > -60)", QUAKES)
def catalog_filter_inverse(spark, d):
    return catalog.filter_catalog(data.quakes(spark, d).withColumn("time", F.col("time").cast("timestamp_ntz")), "magnitude >= 2", "depth < 300", "latitude > -60", inverse=True)


@query("SELECT event FROM q WHERE latitude BETWEEN -30 AND 60 AND (longitude >= 150 OR longitude <= -120)", QUAKES)
def geobounds(spark, d):
    return data.quakes(spark, d).where(geodesy.in_bounds(F.col("latitude"), F.col("longitude"), -30, 60, 150, -120)).select("event")


_ARC = "degrees(atan2(sqrt(pow(cos(radians(B.latitude)) * sin(radians(B.longitude - A.longitude)), 2) + pow(cos(radians(A.latitude)) * sin(radians(B.latitude)) - sin(radians(A.latitude)) * cos(radians(B.latitude)) * cos(radians(B.longitude - A.longitude)), 2)), sin(radians(A.latitude)) * sin(radians(B.latitude)) + cos(radians(A.latitude)) * cos(radians(B.latitude)) * cos(radians(B.longitude - A.longitude))))"


@query(f"SELECT * FROM (SELECT a.station AS one, b.station AS other, round({_ARC.replace('A.', 'a.').replace('B.', 'b.')}, 6) AS degrees FROM st a JOIN st b ON a.station < b.station) WHERE degrees <= 10.3", STATIONS)
def great_circle_pairs(spark, d):
    """Stations at most 10.3 degrees apart."""
    pairs = geodesy.near_pairs(data.stations(spark, d).drop("network"), "station", 10.3)
    return pairs.select(F.col("station").alias("one"), F.col("_station").alias("other"), F.round("degrees", 6).alias("degrees"))


_EPOCHS = "ep AS (SELECT p_partkey % 150 AS trace, p_partkey AS epoch, a + (p_partkey // 150) * w AS start, CASE WHEN (p_partkey // 150) % 3 <> 2 THEN a + (p_partkey // 150 + 1) * w END AS stop FROM part, (SELECT min(epoch_us(ts)) AS a, (max(epoch_us(ts)) - min(epoch_us(ts))) // 3 + 1 AS w FROM events))"


@query("SELECT e.event_id, ep.epoch FROM e JOIN ep ON ep.trace = e.trace AND e.t >= ep.start AND (ep.stop IS NULL OR e.t < ep.stop)", TIMED, _EPOCHS)
def station_epoch_join(spark, d):
    rows = data.timed(spark, d)
    span = rows.agg(F.min("t").alias("a"), (F.floor((F.max("t") - F.min("t")) / 3) + 1).alias("w"))
    number = F.floor(F.col("p_partkey") / 150)
    epochs = data.table(spark, d, "part").crossJoin(F.broadcast(span)).select(
        (F.col("p_partkey") % 150).alias("trace"),
        F.col("p_partkey").alias("epoch"),
        (F.col("a") + number * F.col("w")).alias("start"),
        F.when(number % 3 != 2, F.col("a") + (number + 1) * F.col("w")).alias("end"),
    )
    return segments.epoch_join(rows, epochs, "trace", "t", DAY_US).select("event_id", "epoch")


@query("SELECT c_mktsegment AS network, count(DISTINCT c_nationkey) AS n_station, count(DISTINCT (c_nationkey, c_custkey)) AS n_channel FROM customer GROUP BY 1")
def inventory_contents(spark, d):
    rows = data.table(spark, d, "customer").select(F.col("c_mktsegment").alias("network"), F.col("c_nationkey").alias("station"), F.col("c_custkey").alias("channel"))
    return catalog.contents(rows, ["network", "station", "channel"])


@query("SELECT event_id, trace FROM (SELECT *, min(p) OVER (PARTITION BY trace) AS b FROM (SELECT event_id, trace, CASE WHEN upper(channel) LIKE 'P%' THEN 0 WHEN upper(channel) LIKE '%C%' THEN 1 END AS p FROM e) WHERE p IS NOT NULL) WHERE p = b", TIMED)
def channel_priority(spark, d):
    return catalog.channel_priority(data.timed(spark, d), ["trace"], "channel", ["p*", "*c*"]).select("event_id", "trace")


_BA = "rad AS (SELECT a.trace, a.idx, a.x AS n, b.x AS e, radians((a.trace * 7) % 360) AS ba FROM v a JOIN v b ON b.trace = a.trace + 1 AND b.idx = a.idx)"


@query("SELECT trace, idx, round(-e * sin(ba) - n * cos(ba), 8) + 0.0 AS r, round(-e * cos(ba) + n * sin(ba), 8) + 0.0 AS t FROM rad", VECTORS, _BA)
def rotate_ne_rt(spark, d):
    rows = data.vectors(spark, d).select("trace", F.col("data").alias("n"))
    other = rows.select((F.col("trace") - 1).alias("trace"), F.col("n").alias("e"))
    pairs = rows.join(other, "trace").withColumn("ba", F.radians((F.col("trace") * 7) % 360)).select("trace", "ba", F.posexplode(F.arrays_zip("n", "e")).alias("idx", "s"))
    r, t = -F.col("s.e") * F.sin("ba") - F.col("s.n") * F.cos("ba"), -F.col("s.e") * F.cos("ba") + F.col("s.n") * F.sin("ba")
    return rounded(pairs.select("trace", F.col("idx").cast("long").alias("idx"), r.alias("r"), t.alias("t")), 8, "r", "t")


@query("SELECT event_id, dayofyear(ts) AS julday, weekofyear(ts) AS isoweek, isodow(ts) AS weekday, strftime(ts, '%Y,%j,%H:%M:%S.%f') AS seed FROM events")
def instant_parts(spark, d):
    ts = F.col("ts").cast("timestamp")
    return data.table(spark, d, "events").select("event_id", F.dayofyear(ts).cast("long").alias("julday"), F.weekofyear(ts).cast("long").alias("isoweek"), (F.weekday(ts) + 1).cast("long").alias("weekday"), text.seed_time(ts).alias("seed"))


@query("SELECT event_id, 'XX.' || user_id || '..' || event_type AS seed_id FROM events")
def seed_ids(spark, d):
    return data.table(spark, d, "events").select("event_id", text.seed_id(F.lit("XX"), F.col("user_id"), F.lit(""), F.col("event_type")).alias("seed_id"))


# --- correlation


_PAIRS = "pr AS (SELECT a.trace, a.idx, a.x AS a, b.x AS b FROM v a JOIN v b ON b.trace = a.trace + 1 AND b.idx = a.idx)"


def _vector_pairs(spark, d) -> DataFrame:
    rows = data.vectors(spark, d).select("trace", F.col("data").alias("a"))
    return rows.join(rows.select((F.col("trace") - 1).alias("trace"), F.col("a").alias("b")), "trace")


_LAGS = "lg AS (SELECT p.trace, l.lag + 5 AS place, sum(q.a * p.b) / any_value(n.norm) AS cc FROM pr p JOIN (SELECT unnest(range(-5, 6)) AS lag) l ON true JOIN pr q ON q.trace = p.trace AND q.idx = p.idx + l.lag JOIN (SELECT trace, sqrt(sum(a * a) * sum(b * b)) AS norm FROM pr GROUP BY 1) n ON n.trace = p.trace GROUP BY 1, 2)"


@query("SELECT trace, place, round(cc, 8) + 0.0 AS cc FROM lg", VECTORS, _PAIRS, _LAGS)
def xcorr_lags(spark, d):
    out = _vector_pairs(spark, d).select("trace", F.posexplode(correlation.correlate(F.col("a"), F.col("b"), 5)).alias("place", "cc"))
    return rounded(out.withColumn("place", F.col("place").cast("long")), 8, "cc")


@query("SELECT trace, arg_max(place, struct_pack(a := abs(cc), b := -place)) - 5.0 AS shift, round(arg_max(cc, struct_pack(a := abs(cc), b := -place)), 8) AS value FROM lg GROUP BY 1", VECTORS, _PAIRS, _LAGS)
def xcorr_max(spark, d):
    out = _vector_pairs(spark, d).select("trace", correlation.correlation_peak(correlation.correlate(F.col("a"), F.col("b"), 5)).alias("p"))
    return rounded(out.select("trace", F.col("p.shift").alias("shift"), F.col("p.value").alias("value")), 8, "value")


_MATCH = "mt AS (SELECT w.trace, w.idx, CASE WHEN (w.q - w.s * w.s / 8) * f.e > 1e-9 THEN (p.p - w.s * f.m) / sqrt((w.q - w.s * w.s / 8) * f.e) ELSE 0 END AS cc FROM (SELECT trace, idx, sum(x) OVER z AS s, sum(x * x) OVER z AS q, count(*) OVER z AS n FROM s WINDOW z AS (PARTITION BY trace ORDER BY idx ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) w JOIN (SELECT a.trace, a.idx - b.idx AS idx, sum(a.x * b.x) AS p FROM s a JOIN s b ON a.trace = b.trace AND b.idx < 8 GROUP BY 1, 2) p ON p.trace = w.trace AND p.idx = w.idx JOIN (SELECT trace, avg(x) AS m, sum(x * x) - pow(sum(x), 2) / 8 AS e FROM s WHERE idx < 8 GROUP BY 1) f ON f.trace = w.trace WHERE w.n = 8)"


@query("SELECT trace, idx, round(cc, 6) + 0.0 AS cc FROM mt", SAMPLES, _MATCH)
def match_template(spark, d):
    rows = data.samples(spark, d)
    template = rows.where("idx < 8").select("trace", F.col("idx").alias("k"), F.col("x").alias("t"))
    return rounded(correlation.match_template(rows, template, 8), 6, "cc")


@query("SELECT trace, idx, cc FROM (SELECT trace, idx, round(cc, 6) + 0.0 AS cc, max(struct_pack(v := round(cc, 6), i := -idx)) OVER (PARTITION BY trace ORDER BY idx RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS b FROM mt) WHERE cc >= 0.5 AND -b.i = idx", SAMPLES, _MATCH)
def template_detector(spark, d):
    return correlation.peaks(match_template(spark, d), "cc", 0.5, 4)


@query(
    "SELECT label AS array, sx, sy, round(avg(b * b), 9) AS power FROM (SELECT label, sx, sy, idx - CAST(round(sx * (trace % 5) + sy * (trace % 3)) AS BIGINT) AS i, avg(x) AS b FROM v, (SELECT CAST(unnest(range(-1, 2)) AS DOUBLE) AS sx) gx, (SELECT CAST(unnest(range(-1, 2)) AS DOUBLE) AS sy) gy GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3",
    VECTORS,
)
def beam_power(spark, d):
    rows = data.vectors(spark, d).select(F.col("label").alias("array"), "trace", F.posexplode("data").alias("idx", "x"))
    offsets = data.vectors(spark, d).select("trace", (F.col("trace") % 5).cast("double").alias("dx"), (F.col("trace") % 3).cast("double").alias("dy"))
    return rounded(correlation.beam_power(rows, offsets, [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1)]), 9, "power")


# --- formats: written in full and read back


_TRACES = "SELECT CAST(c_custkey AS VARCHAR) AS station, min(epoch_us(o_orderdate)) AS start, list(o_totalprice ORDER BY o_orderkey) AS data FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"


def _order_traces(spark, d) -> DataFrame:
    """Order totals of a customer as one segment."""
    o = data.table(spark, d, "orders")
    grouped = o.groupBy(F.col("o_custkey").cast("string").alias("station")).agg(F.min(text.micros(F.col("o_orderdate"))).alias("start"), F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("s"))
    return grouped.select(F.lit("XX").alias("network"), "station", F.lit("").alias("location"), F.lit("TOT").alias("channel"), "start", F.lit(1.0).alias("rate"), F.transform("s", lambda x: x["o_totalprice"]).alias("data"))


_READ_BACK = f"SELECT station, start, n - 1 AS idx, data[n] AS x FROM (SELECT *, unnest(range(1, len(data) + 1)) AS n FROM ({_TRACES}))"


def _samples_of(traces: DataFrame) -> DataFrame:
    return traces.select("station", "start", F.posexplode("data").alias("idx", "x")).withColumn("idx", F.col("idx").cast("long"))


@query(_READ_BACK)
def slist_round_trip(spark, d):
    path = data.folder(spark)
    text_series.write_slist(_order_traces(spark, d), path)
    return _samples_of(text_series.read_series(spark, path))


@query(_READ_BACK)
def tspair_round_trip(spark, d):
    path = data.folder(spark)
    text_series.write_tspair(_order_traces(spark, d), path)
    return _samples_of(text_series.read_series(spark, path))


@query("SELECT 'XX' AS network, CAST(trace AS VARCHAR) AS station, concat('E', trace % 3) AS channel, 1600000000000000 + trace * 1001000 AS start, CAST(20 * (1 + trace % 5) AS DOUBLE) AS rate, idx, round(x, 7) + 0.0 AS x FROM v", VECTORS)
def sac_round_trip(spark, d):
    key = F.col("trace")
    traces = data.vectors(spark, d).select(
        F.lit("XX").alias("network"), key.cast("string").alias("station"), F.lit("").alias("location"), F.concat(F.lit("E"), key % 3).alias("channel"), (1_600_000_000_000_000 + key * 1_001_000).alias("start"), (20.0 * (1 + key % 5)).alias("rate"), "data"
    )
    held = sac.decode_sac(sac.encode_sac(traces)).select("network", "station", "channel", "start", "rate", F.posexplode("data").alias("idx", "x"))
    return rounded(rounded(held.withColumn("idx", F.col("idx").cast("long")), 7, "x"), 3, "rate")


@query("SELECT epoch_us(time) AS t, latitude, longitude, depth, magnitude FROM q", QUAKES)
def zmap_round_trip(spark, d):
    path = data.folder(spark)
    tables.write_zmap(data.quakes(spark, d), path)
    return tables.read_zmap(spark, path).select(F.unix_micros("time").alias("t"), "latitude", "longitude", "depth", "magnitude")


@query("SELECT CAST(event AS VARCHAR) AS event, epoch_us(time) AS t, latitude, longitude, depth, magnitude FROM q", QUAKES)
def event_xml_round_trip(spark, d):
    path = data.folder(spark)
    tables.write_events_xml(data.quakes(spark, d), path)
    return tables.read_events_xml(spark, path).select("event", F.unix_micros("time").alias("t"), "latitude", "longitude", "depth", "magnitude")


@query("SELECT CAST(network AS VARCHAR) AS network, CAST(station AS VARCHAR) AS station, latitude, longitude FROM st", STATIONS)
def station_text_round_trip(spark, d):
    path = data.folder(spark)
    tables.write_delimited(data.stations(spark, d).select("network", "station", "latitude", "longitude"), path)
    rows = tables.read_delimited(spark, path, ("network", "station", "latitude", "longitude"))
    return rows.select("network", "station", F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"))


@query("SELECT event_id, x FROM (SELECT event_id, CAST(json_extract(to_json(struct_pack(v := value)), '$.v') AS DOUBLE) AS x FROM events)")
def json_output(spark, d):
    rows = data.table(spark, d, "events").select("event_id", F.to_json(F.struct("event_type", "value")).alias("json"))
    return rows.select("event_id", F.get_json_object("json", "$.value").cast("double").alias("x"))


# --- streams


@query("SELECT trace, t, round(sum(x * 0.5) OVER (PARTITION BY trace ORDER BY t ROWS UNBOUNDED PRECEDING), 4) + 0.0 AS y FROM pk", PACKETS)
def rt_integrate(spark, d):
    return rounded(processes.finish(processes.run_process(data.packets(spark, d), processes.integrate(0.5)), data.folder(spark)), 4, "y")


@query("SELECT trace, t, round((x - coalesce(lag(x) OVER (PARTITION BY trace ORDER BY t), x)) / 0.5, 5) + 0.0 AS y FROM pk", PACKETS)
def rt_differentiate(spark, d):
    return rounded(processes.finish(processes.run_process(data.packets(spark, d), processes.differentiate(0.5)), data.folder(spark)), 5, "y")


@query("SELECT trace, t, round(sum(x) OVER (PARTITION BY trace ORDER BY t ROWS 4 PRECEDING) / 5, 5) + 0.0 AS y FROM pk", PACKETS)
def rt_boxcar(spark, d):
    return rounded(processes.finish(processes.run_process(data.packets(spark, d), processes.boxcar(4)), data.folder(spark)), 5, "y")


@query("SELECT trace, min(t) AS first, count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY trace ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY trace ORDER BY t, event_id) >= 21600000000 THEN 1 ELSE 0 END AS f FROM e)) GROUP BY trace, g", TIMED)
def session_windows(spark, d):
    return processes.sessions(data.timed(spark, d), "6 hours")


# --- further triggers and rotations


@query(
    "SELECT trace, idx, round(CASE WHEN idx < 12 THEN -1 ELSE star - 0.8 * CASE WHEN idx >= 13 THEN avg(star) OVER (PARTITION BY trace ORDER BY idx ROWS BETWEEN 13 PRECEDING AND 2 PRECEDING) ELSE 0 END - abs(sta - lta) - 0.8 END, 9) + 0.0 AS cft FROM (SELECT *, CASE WHEN idx >= 4 THEN avg(abs(x - lta)) OVER (PARTITION BY trace ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) ELSE 0 END AS star FROM (SELECT *, CASE WHEN idx >= 13 THEN avg(sta) OVER (PARTITION BY trace ORDER BY idx ROWS BETWEEN 13 PRECEDING AND 2 PRECEDING) ELSE 0 END AS lta FROM (SELECT *, CASE WHEN idx >= 4 THEN avg(x) OVER (PARTITION BY trace ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) ELSE 0 END AS sta FROM s)))",
    SAMPLES,
)
def carl_sta_trig(spark, d):
    return rounded(series.carl_sta_trig(data.samples(spark, d), 4, 12, 0.8, 0.8).drop("x"), 9, "cft")


@query(
    "SELECT trace, idx, round(CASE WHEN idx >= 58 THEN (sum(a + b) OVER w / 2) / (sum(c + e) OVER w / 6) ELSE 0 END, 6) AS cft FROM (SELECT s.trace, s.idx, s.x * s.x AS a, p.x * p.x AS b, q.x * q.x AS c, r.x * r.x AS e FROM s JOIN (SELECT trace, count(*) AS n FROM s GROUP BY 1) m ON m.trace = s.trace JOIN s p ON p.trace = s.trace AND s.idx = (p.idx + 2) % m.n JOIN s q ON q.trace = s.trace AND s.idx = (q.idx + 3) % m.n JOIN s r ON r.trace = s.trace AND s.idx = (r.idx + 9) % m.n) WINDOW w AS (PARTITION BY trace ORDER BY idx ROWS UNBOUNDED PRECEDING)",
    SAMPLES,
)
def delayed_sta_lta(spark, d):
    return rounded(series.delayed_sta_lta(data.samples(spark, d), 2, 6).drop("x"), 6, "cft")


@query(
    "SELECT a.trace, a.idx, round(a.x * cos(i) - b.x * sin(i) * cos(ba) - c.x * sin(i) * sin(ba), 8) + 0.0 AS l, round(a.x * sin(i) + b.x * cos(i) * cos(ba) + c.x * cos(i) * sin(ba), 8) + 0.0 AS q, round(b.x * sin(ba) - c.x * cos(ba), 8) + 0.0 AS t FROM (SELECT *, radians(trace % 90) AS i, radians((trace * 7) % 360) AS ba FROM v) a JOIN v b ON b.trace = a.trace + 1 AND b.idx = a.idx JOIN v c ON c.trace = a.trace + 2 AND c.idx = a.idx",
    VECTORS,
)
def rotate_zne_lqt(spark, d):
    rows = data.vectors(spark, d).select("trace", F.col("data").alias("z"))
    later = lambda k, name: rows.select((F.col("trace") - k).alias("trace"), F.col("z").alias(name))
    sets = rows.join(later(1, "n"), "trace").join(later(2, "e"), "trace").withColumn("i", F.radians(F.col("trace") % 90)).withColumn("ba", F.radians((F.col("trace") * 7) % 360))
    out = sets.select("trace", "i", "ba", F.posexplode(F.arrays_zip("z", "n", "e")).alias("idx", "s")).select("trace", F.col("idx").cast("long").alias("idx"), "i", "ba", "s.z", "s.n", "s.e")
    l = F.col("z") * F.cos("i") - F.col("n") * F.sin("i") * F.cos("ba") - F.col("e") * F.sin("i") * F.sin("ba")  # noqa: E741
    q = F.col("z") * F.sin("i") + F.col("n") * F.cos("i") * F.cos("ba") + F.col("e") * F.cos("i") * F.sin("ba")
    t = F.col("n") * F.sin("ba") - F.col("e") * F.cos("ba")
    return rounded(out.select("trace", "idx", l.alias("l"), q.alias("q"), t.alias("t")), 8, "l", "q", "t")
