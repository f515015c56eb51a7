"""Queries of multi-channel template detection, unequal and component-wise correlation, similarity, and coincidence in full."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import arrays, correlation, detection, network, picking, series
from . import data
from .data import SAMPLES, VECTORS
from .registry import query, rounded

# --- streams of three channels: traces in threes, on one grid of sample numbers


def _streams(spark, d) -> DataFrame:
    return data.samples(spark, d).select(F.floor(F.col("trace") / 3).alias("stream"), (F.col("trace") % 3).alias("channel"), "idx", "x")


#: Template: stream that it is cut from, its first sample and its length; channel c starts c samples later.
_CUTS = {0: (1, 5, 8), 1: (2, 20, 6)}


def _templates(spark, d) -> DataFrame:
    rows = _streams(spark, d)
    parts = []
    for template, (stream, first, length) in _CUTS.items():
        held = rows.where((F.col("stream") == stream) & F.col("idx").between(first + F.col("channel"), first + F.col("channel") + length - 1))
        parts.append(held.select(F.lit(template).alias("template"), "channel", (F.col("idx") - first).alias("k"), F.col("x").alias("t")))
    return parts[0].union(parts[1])


_STREAMS = "st3 AS (SELECT CAST(floor(trace / 3) AS BIGINT) AS stream, trace % 3 AS channel, idx, x FROM s)"
_CUT = " UNION ALL ".join(f"SELECT {n} AS template, channel, idx - {a} AS k, x AS t FROM st3 WHERE stream = {s} AND idx BETWEEN {a} + channel AND {a + size - 1} + channel" for n, (s, a, size) in _CUTS.items())
_TEMPLATES = (
    _STREAMS,
    f"tp AS ({_CUT})",
    "tf AS (SELECT template, channel, count(*) AS n, avg(t) AS m, sum(t * t) - pow(sum(t), 2) / count(*) AS e, min(k) AS late, avg(abs(t)) AS size FROM tp GROUP BY 1, 2)",
    "pd AS (SELECT template, st3.stream, channel, idx - k AS idx, sum(x * t) AS p, sum(x) AS s, sum(x * x) AS q, avg(abs(x)) AS a, count(*) AS n FROM st3 JOIN tp USING (channel) GROUP BY 1, 2, 3, 4)",
    "ch AS (SELECT pd.template, stream, pd.channel, idx, CASE WHEN (q - s * s / tf.n) * e > 1e-9 THEN (p - s * m) / sqrt((q - s * s / tf.n) * e) ELSE 0 END AS cc, a FROM pd JOIN tf ON tf.template = pd.template AND tf.channel = pd.channel AND tf.n = pd.n)",
    "ct AS (SELECT template, stream, count(*) AS channels FROM (SELECT DISTINCT stream, channel FROM st3) c JOIN tf USING (channel) GROUP BY 1, 2)",
    "sm AS (SELECT ch.template, ch.stream, idx, avg(cc) AS similarity, avg(a) AS a, count(*) AS n FROM ch GROUP BY 1, 2, 3 HAVING count(*) = (SELECT channels FROM ct WHERE ct.template = ch.template AND ct.stream = ch.stream))",
)


@query("SELECT template, stream, channel, idx, round(cc, 6) + 0.0 AS cc FROM ch", SAMPLES, *_TEMPLATES)
def stream_template(spark, d):
    """Correlations of each channel of a stream with two templates, placed where the template as a whole would start."""
    found = detection.stream_correlations(_streams(spark, d), _templates(spark, d))
    return rounded(found.select("template", "stream", "channel", "idx", "cc"), 6, "cc")


_DETECTED = (
    "pk3 AS (SELECT * FROM (SELECT *, lag(similarity) OVER w AS b, lead(similarity) OVER w AS f, lag(idx) OVER w AS bi, lead(idx) OVER w AS fi FROM sm WINDOW w AS (PARTITION BY template, stream ORDER BY idx)) WHERE similarity > b AND similarity > f AND bi = idx - 1 AND fi = idx + 1 AND similarity >= CASE WHEN template = 0 THEN 0.3 ELSE 0.35 END)",
    "r1 AS (SELECT *, row_number() OVER (PARTITION BY template, stream ORDER BY similarity DESC, idx DESC) AS r FROM pk3)",
    "g1 AS (SELECT template, stream, r, [idx] AS held FROM r1 WHERE r = 1 UNION ALL SELECT g.template, g.stream, n.r, CASE WHEN len(list_filter(held, lambda h: abs(h - n.idx) < 3)) > 0 THEN held ELSE list_append(held, n.idx) END FROM g1 g JOIN r1 n ON n.template = g.template AND n.stream = g.stream AND n.r = g.r + 1)",
    "k1 AS (SELECT r1.* FROM r1 JOIN (SELECT template, stream, arg_max(held, r) AS held FROM g1 GROUP BY 1, 2) h ON h.template = r1.template AND h.stream = r1.stream AND list_contains(held, idx))",
    "r2 AS (SELECT * EXCLUDE (r), row_number() OVER (PARTITION BY stream ORDER BY similarity DESC, template, idx) AS r FROM k1)",
    "g2 AS (SELECT stream, r, [idx] AS held, [r] AS kept FROM r2 WHERE r = 1 UNION ALL SELECT g.stream, n.r, CASE WHEN len(list_filter(held, lambda h: abs(h - n.idx) <= 3)) > 0 THEN held ELSE list_append(held, n.idx) END, CASE WHEN len(list_filter(held, lambda h: abs(h - n.idx) <= 3)) > 0 THEN kept ELSE list_append(kept, n.r) END FROM g2 g JOIN r2 n ON n.stream = g.stream AND n.r = g.r + 1)",
    "k2 AS (SELECT r2.* FROM r2 JOIN (SELECT stream, arg_max(kept, r) AS kept FROM g2 GROUP BY 1) h ON h.stream = r2.stream AND list_contains(kept, r2.r))",
)


@query(
    "SELECT k2.stream, k2.template, k2.idx, round(similarity, 6) AS similarity, round(k2.a / z.size, 6) AS amplitude_ratio, round(2 + k2.template + 4 / 3.0 * log10(k2.a / z.size), 6) AS magnitude, round(v, 6) AS best_channel FROM k2 JOIN (SELECT template, avg(size) AS size FROM tf GROUP BY 1) z ON z.template = k2.template JOIN (SELECT template, stream, idx, max(cc) AS v FROM ch GROUP BY 1, 2, 3) m ON m.template = k2.template AND m.stream = k2.stream AND m.idx = k2.idx",
    SAMPLES,
    *_TEMPLATES,
    *_DETECTED,
)
def detector_many(spark, d):
    """Detections of two templates over three channels, thinned to four samples, with amplitude ratios and magnitudes."""
    heights = spark.createDataFrame([(0, 0.3), (1, 0.35)], "template int, height double")
    magnitudes = spark.createDataFrame([(0, 2.0), (1, 3.0)], "template int, magnitude double")
    found = detection.detect(_streams(spark, d), _templates(spark, d), heights, 3, magnitudes)
    return rounded(found.withColumn("best_channel", F.array_max(F.map_values("values"))).drop("values"), 6, "similarity", "amplitude_ratio", "magnitude", "best_channel")


# --- correlation of unequal lengths, of long traces and over components

_UNEQUAL = (
    "ua AS (SELECT trace, idx, x - avg(x) OVER (PARTITION BY trace) AS x FROM v WHERE idx < 20 + trace % 4)",
    "ub AS (SELECT trace - 1 AS trace, idx, x - avg(x) OVER (PARTITION BY trace) AS x FROM v WHERE idx < 17)",
    "un AS (SELECT a.trace, a.n + b.n - 1 AS whole, b.n AS nb, sqrt(a.e * b.e) AS norm FROM (SELECT trace, count(*) AS n, sum(x * x) AS e FROM ua GROUP BY 1) a JOIN (SELECT trace, count(*) AS n, sum(x * x) AS e FROM ub GROUP BY 1) b USING (trace))",
    "ul AS (SELECT trace, place, whole // 2 - nb + 1 - 6 + place AS lag, norm FROM un, (SELECT unnest(range(0, 13)) AS place) WHERE place < 12 + whole % 2)",
)


@query("SELECT ul.trace, place, round(coalesce(sum(ua.x * ub.x), 0) / any_value(norm), 7) + 0.0 AS cc FROM ul JOIN ub ON ub.trace = ul.trace LEFT JOIN ua ON ua.trace = ul.trace AND ua.idx = ub.idx + lag GROUP BY 1, 2", VECTORS, *_UNEQUAL)
def correlate_unequal(spark, d):
    """Correlation of 20 to 23 samples with 17 of the next trace, aligned around their middles."""
    rows = data.vectors(spark, d)
    a = rows.select("trace", F.slice("data", F.lit(1), (20 + F.col("trace") % 4).cast("int")).alias("a"))
    b = rows.select((F.col("trace") - 1).alias("trace"), F.slice("data", 1, 17).alias("b"))
    cc = correlation.correlate(F.col("a"), F.col("b"), 6, demean=True)
    out = a.join(b, "trace").select("trace", F.posexplode(cc).alias("place", "cc"))
    return rounded(out.withColumn("place", F.col("place").cast("long")), 7, "cc")


_COMPONENTS = (
    "cp AS (SELECT CAST(floor(trace / 6) AS BIGINT) AS trace, trace % 3 AS component, trace % 6 >= 3 AS second, idx, x FROM s)",
    "cm AS (SELECT *, x - avg(x) OVER (PARTITION BY trace, component, second) AS y FROM cp)",
    "ce AS (SELECT trace, component, sqrt(sum(CASE WHEN second THEN 0 ELSE y * y END) * sum(CASE WHEN second THEN y * y ELSE 0 END)) AS norm FROM cm GROUP BY 1, 2 HAVING count(DISTINCT second) = 2)",
    "cl AS (SELECT ce.trace, ce.component, lag, coalesce(sum(a.y * b.y), 0) / any_value(norm) AS cc FROM ce, (SELECT unnest(range(-5, 6)) AS lag) l LEFT JOIN cm b ON b.trace = ce.trace AND b.component = ce.component AND b.second LEFT JOIN cm a ON a.trace = b.trace AND a.component = b.component AND NOT a.second AND a.idx = b.idx + lag GROUP BY 1, 2, 3)",
    "cs AS (SELECT trace, lag, avg(cc) AS cc FROM cl GROUP BY 1, 2)",
)


def _two_sets(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = data.samples(spark, d).select(F.floor(F.col("trace") / 6).alias("trace"), (F.col("trace") % 3).alias("component"), (F.col("trace") % 6 >= 3).alias("second"), "idx", "x")
    return rows.where("NOT second").drop("second"), rows.where("second").drop("second")


@query("SELECT trace, lag, round(cc, 7) + 0.0 AS cc FROM cs", SAMPLES, *_COMPONENTS)
def correlate_components(spark, d):
    """Correlation of two sets of three components for lags to 5, by sums over blocks of samples."""
    return rounded(detection.correlate_components(*_two_sets(spark, d), 5), 7, "cc")


@query("SELECT trace, arg_max(lag, struct_pack(a := abs(cc), b := -lag)) AS shift, round(arg_max(cc, struct_pack(a := abs(cc), b := -lag)), 7) AS value FROM cs GROUP BY 1", SAMPLES, *_COMPONENTS)
def xcorr_three_components(spark, d):
    return rounded(detection.lag_peak(detection.correlate_components(*_two_sets(spark, d), 5)), 7, "value")


# --- similarity of triggers to templates, coincidence with it

_SIMILAR = (
    _STREAMS,
    "q3 AS (SELECT stream * 100 + t0 AS trigger, stream AS station, t0 FROM (SELECT DISTINCT stream FROM st3), (SELECT unnest([9, 24]) AS t0))",
    "t3 AS (SELECT 0 AS template, channel, idx - 6 AS k, x AS t FROM st3 WHERE stream = 1 AND idx BETWEEN 6 AND 13 UNION ALL SELECT 1, channel, idx - 18, x FROM st3 WHERE stream = 2 AND idx BETWEEN 18 AND 25)",
    "w3 AS (SELECT trigger, st3.station, channel, idx - t0 + 3 AS j, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS z, x, count(*) OVER w AS n FROM (SELECT stream AS station, * FROM st3) st3 JOIN q3 ON q3.station = st3.station AND idx BETWEEN t0 - 3 AND t0 + 10 WINDOW w AS (PARTITION BY trigger, channel))",
    "z3 AS (SELECT *, (t - avg(t) OVER w) / stddev_pop(t) OVER w AS tz FROM t3 WINDOW w AS (PARTITION BY template, channel))",
    "p3 AS (SELECT trigger, template, j - k AS lag, sum(z * tz) AS total FROM w3 JOIN z3 USING (channel) WHERE n = 14 AND j - k BETWEEN 0 AND 6 GROUP BY 1, 2, 3)",
    "b3 AS (SELECT trigger, template, arg_max(lag, struct_pack(a := total, b := -lag)) AS lag FROM p3 GROUP BY 1, 2)",
    "c3 AS (SELECT b3.trigger, b3.template, w3.channel, corr(x, t) AS cc FROM b3 JOIN w3 ON w3.trigger = b3.trigger JOIN t3 ON t3.template = b3.template AND t3.channel = w3.channel AND w3.j = b3.lag + k GROUP BY 1, 2, 3)",
)


@query("SELECT trigger, round(max(cc), 7) AS similarity FROM (SELECT trigger, template, avg(cc) AS cc FROM c3 GROUP BY 1, 2) GROUP BY 1", SAMPLES, *_SIMILAR)
def template_similarity(spark, d):
    """Likeness of the samples around two triggers of each stream to two templates of three channels."""
    rows = _streams(spark, d)
    triggers = rows.select(F.col("stream").alias("station")).distinct().withColumn("at", F.explode(F.array(F.lit(9), F.lit(24)))).withColumn("trigger", F.col("station") * 100 + F.col("at"))
    cut = lambda n, stream, first: rows.where((F.col("stream") == stream) & F.col("idx").between(first, first + 7)).select(F.lit(n).alias("template"), "channel", (F.col("idx") - first).alias("k"), F.col("x").alias("t"))
    templates = cut(0, 1, 6).union(cut(1, 2, 18)).crossJoin(F.broadcast(triggers.select("station").distinct()))
    return rounded(detection.max_similarity(triggers, rows.withColumnRenamed("stream", "station"), templates), 7, "similarity")


_CFT = "c AS (SELECT trace, idx, CASE WHEN idx >= 19 THEN avg(x * x) OVER (PARTITION BY trace ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / avg(x * x) OVER (PARTITION BY trace ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) ELSE 0 END AS cft FROM s)"
_RUNS = "SELECT trace, min(idx) AS a, max(idx) AS z FROM (SELECT *, idx - row_number() OVER (PARTITION BY trace ORDER BY idx) AS run FROM c WHERE round(cft, 6) >= {}) GROUP BY trace, run"
_LIMITED = (
    _CFT,
    f"lo AS ({_RUNS.format(1.0)})",
    f"hi AS ({_RUNS.format(1.5)})",
    "on1 AS (SELECT lo.trace, lo.z AS last, min(hi.a) AS on_idx FROM lo JOIN hi ON hi.trace = lo.trace AND hi.a BETWEEN lo.a AND lo.z GROUP BY 1, 2 UNION ALL SELECT o.trace, o.last, (SELECT min(hi.a) FROM hi WHERE hi.trace = o.trace AND hi.a > o.on_idx + 6 AND hi.a <= o.last) FROM on1 o WHERE o.on_idx IS NOT NULL)",
    "tr AS (SELECT trace, on_idx, least(last, on_idx + 6) AS off_idx FROM on1 WHERE on_idx IS NOT NULL)",
    "w AS (SELECT tr.trace, on_idx AS a, off_idx AS z, 1.0 + tr.trace % 2 AS weight, max(cft) AS peak, stddev_pop(cft) AS std FROM tr JOIN c ON c.trace = tr.trace AND c.idx BETWEEN on_idx AND greatest(off_idx - 1, on_idx) GROUP BY ALL)",
    "w9 AS (SELECT *, row_number() OVER (ORDER BY a, z, trace) AS i, CASE WHEN trace % 5 = 0 THEN (trace * 7 + a) % 10 / 10.0 END AS likeness FROM w WHERE trace < 200)",
    "sc AS (SELECT i, i AS j, a, z AS off, [trace] AS members, [peak] AS peaks, [std] AS stds, [weight] AS ws, weight AS total, coalesce(likeness > 0.7, false) AS alike FROM w9 UNION ALL SELECT sc.i, t.i, sc.a, CASE WHEN list_contains(members, t.trace) THEN off ELSE greatest(off, t.z) END, CASE WHEN list_contains(members, t.trace) THEN members ELSE list_append(members, t.trace) END, CASE WHEN list_contains(members, t.trace) THEN peaks ELSE list_append(peaks, t.peak) END, CASE WHEN list_contains(members, t.trace) THEN stds ELSE list_append(stds, t.std) END, CASE WHEN list_contains(members, t.trace) THEN ws ELSE list_append(ws, t.weight) END, total + CASE WHEN list_contains(members, t.trace) THEN 0 ELSE t.weight END, alike OR (NOT list_contains(members, t.trace) AND coalesce(t.likeness > 0.7, false)) FROM sc JOIN w9 t ON t.i = sc.j + 1 WHERE list_contains(members, t.trace) OR t.a <= off)",
    "ev AS (SELECT i, any_value(a) AS a, max(off) AS off, arg_max(members, j) AS members, arg_max(peaks, j) AS peaks, arg_max(stds, j) AS stds, arg_max(ws, j) AS ws, max(total) AS total, bool_or(alike) AS alike FROM sc GROUP BY 1 HAVING max(total) >= 12 OR bool_or(alike))",
)


@query(
    "SELECT a AS start, off AS \"end\", CAST(total AS DOUBLE) AS coincidence_sum, array_to_string(members, ',') AS stations, round(list_dot_product(peaks, ws) / total, 6) AS peak_mean, round(list_dot_product(stds, ws) / total, 6) AS std_mean, round(list_max(peaks), 6) AS top, (SELECT count(*) FROM w9 WHERE w9.likeness IS NOT NULL AND w9.i IN (SELECT min(k.i) FROM w9 k WHERE k.i >= e.i AND list_contains(members, k.trace) GROUP BY k.trace)) AS likenesses FROM (SELECT *, max(off) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ev) e WHERE before IS NULL OR off > before",
    SAMPLES,
    *_LIMITED,
)
def coincidence_details(spark, d):
    """Triggers of at most six samples, their peaks and deviations, and network events by weight or likeness."""
    cft = series.classic_sta_lta(data.samples(spark, d), 5, 20).withColumn("cft", F.round("cft", 6))
    onsets = series.trigger_onset(cft, 1.5, 1.0, 6).where("trace < 200")
    raw = series.classic_sta_lta(data.samples(spark, d), 5, 20)
    likeness = F.when(F.col("trace") % 5 == 0, (F.col("trace") * 7 + F.col("on_idx")) % 10 / 10)
    triggers = network.trigger_figures(onsets, raw).withColumns({"weight": 1.0 + F.col("trace") % 2, "likeness": likeness})
    found = network.network_triggers(triggers, "on_idx", "off_idx", "trace", 12, "weight", similarity="likeness", details=("peak", "std"))
    found = found.select("start", "end", "coincidence_sum", F.array_join(F.col("stations").cast("array<string>"), ",").alias("stations"), "peak_mean", "std_mean", F.array_max("peak").alias("top"), F.size("likeness").cast("long").alias("likenesses"))
    return rounded(found, 6, "peak_mean", "std_mean", "top")


# --- phase picks: the twin runs the machine sample by sample

_PICK = (
    "x1 AS (SELECT trace, idx AS i, x, max(idx) OVER (PARTITION BY trace) AS n, max(abs(x)) OVER (PARTITION BY trace) AS scale FROM s WHERE idx >= 1)",
    "x2 AS (SELECT *, (x - coalesce(lag(x) OVER (PARTITION BY trace ORDER BY i), x)) * 2 AS rise, abs(CAST(trunc(256 * x / scale + 0.5) AS BIGINT)) AS size FROM x1)",
    "x0 AS (SELECT trace, sum(CASE WHEN i >= 2 THEN x * x ELSE 0 END) AS y, sum(CASE WHEN i >= 2 THEN rise * rise ELSE 0 END) AS t, sum(x) AS sx FROM x2 WHERE i <= 6 GROUP BY 1)",
    "m AS (SELECT trace, CAST(0 AS BIGINT) AS i, y, t, 0.0::DOUBLE AS ssx, 0.0::DOUBLE AS ssq, 0.0::DOUBLE AS num, CASE WHEN (6 * y - sx * sx) / 36 > 0 THEN sqrt(6 * y - sx * sx) / 36 ELSE 1 END AS sdev, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS ev, 0 AS flag, CAST(0 AS BIGINT) AS itar, 0 AS down, CAST(0 AS BIGINT) AS amp, CAST(0 AS BIGINT) AS noise, CAST(0 AS BIGINT) AS pamp, CAST(0 AS BIGINT) AS until, 0 AS first, CAST(0 AS BIGINT) AS pick FROM x0"
    " UNION ALL SELECT trace, i, y, t, ssx, ssq, num, CASE WHEN keep THEN CASE WHEN num * ssq - ssx * ssx >= 0 THEN sqrt((num * ssq - ssx * ssx) / (num * num)) ELSE 1 END ELSE sdev END, CASE WHEN keep THEN ssx / num ELSE mean END, ev,"
    " CASE WHEN over THEN CASE WHEN flag = 0 THEN 1 WHEN ev > 6 AND down = 0 THEN flag + 2 ELSE flag END WHEN flag > 0 AND down + 1 > 2 THEN 0 ELSE flag END,"
    " CASE WHEN over AND flag = 0 THEN i WHEN NOT over AND flag > 0 AND down + 1 > 2 THEN 0 ELSE itar END,"
    " CASE WHEN over THEN 0 WHEN flag > 0 THEN down + 1 ELSE down END, amp, CASE WHEN over AND flag = 0 AND noise = 0 THEN amp ELSE noise END, CASE WHEN i <= until THEN amp WHEN over AND flag = 0 THEN pamp ELSE pamp END, CASE WHEN over AND flag = 0 THEN i + 5 ELSE until END,"
    " CASE WHEN over AND flag = 0 THEN CASE WHEN rise < 0 THEN 1 WHEN rise > 0 THEN -1 ELSE first END ELSE first END,"
    " CASE WHEN NOT over AND flag > 0 AND down + 1 > 2 AND i - itar - (down + 1) + flag >= 4 THEN itar ELSE 0 END"
    " FROM (SELECT *, ssx0 + CASE WHEN keep THEN e ELSE 0 END AS ssx, ssq0 + CASE WHEN keep THEN e * e ELSE 0 END AS ssq, num0 + CASE WHEN keep THEN 1 ELSE 0 END AS num FROM (SELECT *, ev > 1.5 AND i > 12 AS over, ev < 3 OR i <= 12 AS keep FROM (SELECT *, CASE WHEN sdev > 0 THEN (e - mean) / sdev ELSE ev0 END AS ev FROM ("
    "SELECT m.trace, x2.i, x2.rise, m.y + x * x AS y, m.t + rise * rise AS t, pow(x * x + m.y / m.t * rise * rise, 2) AS e, m.ssx AS ssx0, m.ssq AS ssq0, m.num AS num0, sdev, mean, m.ev AS ev0, flag, itar, down, greatest(amp, size) AS amp, noise, pamp, until, first FROM m JOIN x2 ON x2.trace = m.trace AND x2.i = m.i + 1 WHERE m.pick = 0))))"
    ")",
    "lp AS (SELECT *, max(i) OVER (PARTITION BY trace) AS z FROM m)",
    "fp AS (SELECT trace, CASE WHEN pick > 0 THEN pick WHEN itar > 0 AND i + 1 - itar - down + flag >= 4 THEN itar ELSE 0 END AS onset, first, pamp / noise::DOUBLE AS ratio FROM lp WHERE i = z)",
    "gp AS (SELECT *, 4 - (ratio > 1.5)::INT - (ratio > 4)::INT - (ratio > 6)::INT - (ratio > 8)::INT AS grade FROM fp)",
)


@query("SELECT trace, onset + 1 AS pick, CASE WHEN onset = 0 THEN '' ELSE concat(CASE WHEN grade <= 1 THEN 'IP' ELSE 'EP' END, CASE WHEN first < 0 THEN concat('U', grade) WHEN first > 0 THEN concat('D', grade) ELSE '' END) END AS phase FROM gp", SAMPLES, *_PICK)
def first_picks(spark, d):
    """The first onset of each trace with its quality, the noise being settled block by block."""
    return picking.first_picks(data.samples(spark, d), 2.0, 2, 4, 1.5, 3.0, 6, 5, block=64)


@query("SELECT trace, i AS idx, round(ev, 5) + 0.0 AS value FROM (SELECT * FROM m WHERE i > 0)", SAMPLES, *[v.replace("WHERE m.pick = 0", "") for v in _PICK[:4]])
def noise_values(spark, d):
    """The characteristic function of the picker."""
    energies = picking.energy_function(data.samples(spark, d), 2.0, 6)
    return rounded(picking.noise_values(energies, 3.0, 6, block=64), 5, "value")


# --- beams in the frequency domain: arrays are the labels

_GRID = (-0.2, 0.2, -0.2, 0.2, 0.1)
_BEAMS = (
    "ge AS (SELECT label, trace, x - avg(x) OVER (PARTITION BY label) AS gx, y - avg(y) OVER (PARTITION BY label) AS gy, count(*) OVER (PARTITION BY label) AS n FROM (SELECT vec_id AS trace, label, (vec_id * 37 % 11) / 10.0 AS x, (vec_id * 53 % 7) / 10.0 AS y FROM embeddings))",
    "wx AS (SELECT trace, label, win, idx - 16 * win AS i, x - avg(x) OVER (PARTITION BY trace, win) AS x FROM v JOIN (SELECT unnest(range(0, 3)) AS win) ON idx BETWEEN 16 * win AND 16 * win + 31)",
    "wt AS (SELECT *, x * CASE WHEN i <= 3 THEN 0.5 * (1 - cos(pi() * i / 3)) WHEN i >= 28 THEN 0.5 * (1 + cos(pi() * (i - 28) / 3)) ELSE 1 END AS y FROM wx)",
    "ft AS (SELECT trace, label, win, k, sum(y * cos(2 * pi() * k * i / 32)) AS re, -sum(y * sin(2 * pi() * k * i / 32)) AS im FROM wt, (SELECT unnest([2, 3, 4]) AS k) GROUP BY 1, 2, 3, 4)",
    "gr AS (SELECT ix, iy, -0.2 + ix * 0.1 AS sx, -0.2 + iy * 0.1 AS sy FROM (SELECT unnest(range(0, 5)) AS ix), (SELECT unnest(range(0, 5)) AS iy))",
    "st AS (SELECT ft.label, win, k, ix, iy, sx, sy, sum(re * cos(a) - im * sin(a)) AS re, sum(re * sin(a) + im * cos(a)) AS im FROM (SELECT ft.*, gr.*, 2 * pi() * k * 3.125 * (sx * gx + sy * gy) AS a FROM ft JOIN ge ON ge.trace = ft.trace JOIN gr ON true) ft GROUP BY ALL)",
    "tw AS (SELECT label, win, sum(re * re + im * im) * max(n) AS total FROM ft JOIN ge USING (trace, label) GROUP BY 1, 2)",
    "mp AS (SELECT st.label, st.win, ix, iy, any_value(sx) AS sx, any_value(sy) AS sy, sum(re * re + im * im) AS power, sum(re * re + im * im) / any_value(total) AS rel FROM st JOIN tw ON tw.label = st.label AND tw.win = st.win GROUP BY 1, 2, 3, 4)",
    "be AS (SELECT *, row_number() OVER (PARTITION BY label, win ORDER BY rel DESC, ix, iy) AS r FROM mp)",
)


def _array(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = data.vectors(spark, d).select(F.col("label").alias("array"), F.col("trace").alias("station"), F.posexplode("data").alias("idx", "x"))
    key = F.col("trace")
    geometry = data.vectors(spark, d).select(F.col("label").alias("array"), key.alias("station"), (key * 37 % 11 / 10.0).alias("x"), (key * 53 % 7 / 10.0).alias("y"))
    return rows, geometry


@query(
    "SELECT label AS array, CAST(16 * win AS BIGINT) AS idx, round(rel, 8) AS relative, round(power, 7) AS absolute, round(CASE WHEN degrees(atan2(sx, sy)) > 0 THEN degrees(atan2(sx, sy)) - 180 ELSE degrees(atan2(sx, sy)) + 180 END, 5) + 0.0 AS back_azimuth, round(greatest(sqrt(sx * sx + sy * sy), 1e-8), 8) AS slowness FROM be WHERE r = 1 AND rel > 0.02",
    VECTORS,
    *_BEAMS,
)
def array_beams(spark, d):
    """Relative and absolute power, back azimuth and slowness of sliding windows."""
    found = arrays.array_processing(*_array(spark, d), 100.0, 32, 16, _GRID, 5.0, 12.0, semblance=0.02)
    return rounded(rounded(rounded(found, 8, "relative", "slowness"), 7, "absolute"), 5, "back_azimuth")


@query("SELECT label AS array, CAST(win AS BIGINT) AS \"window\", ix, iy, round(rel, 8) AS relative, round(power, 7) AS absolute FROM mp", VECTORS, *_BEAMS)
def array_power_maps(spark, d):
    """The whole maps over slowness, one for each window."""
    samples, geometry = _array(spark, d)
    stations = geometry.groupBy("array").agg(F.count("*").alias("stations"))
    spectra = arrays.window_spectra(samples, 32, 16, 100.0, 5.0, 12.0)
    return rounded(rounded(arrays.power_maps(spectra, arrays.centred(geometry, "array", "x", "y"), stations, _GRID, 32, 100.0, 5.0), 8, "relative"), 7, "absolute")


@query()
def array_capon(spark, d):
    found = arrays.array_processing(*_array(spark, d), 100.0, 32, 16, _GRID, 5.0, 12.0, capon=True)
    return rounded(found, 6, "relative", "absolute", "back_azimuth", "slowness")


# --- picks of pairs of traces corrected by their correlation

_CORRECTED = (
    "pw AS (SELECT trace - trace % 2 AS pair, trace % 2 AS side, idx - CASE WHEN trace % 2 = 0 THEN 11 ELSE 13 END AS i, x FROM s WHERE idx BETWEEN CASE WHEN trace % 2 = 0 THEN 11 ELSE 13 END AND CASE WHEN trace % 2 = 0 THEN 31 ELSE 33 END)",
    "pm AS (SELECT *, x - avg(x) OVER (PARTITION BY pair, side) AS y FROM pw WHERE pair IN (SELECT pair FROM pw GROUP BY 1 HAVING count(*) = 42))",
    "pc AS (SELECT a.pair, a.i - b.i AS t, sum(a.y * b.y) / (SELECT sqrt(sum(y * y) FILTER (side = 0) * sum(y * y) FILTER (side = 1)) FROM pm n WHERE n.pair = a.pair) AS c FROM pm a JOIN pm b ON b.pair = a.pair AND a.side = 0 AND b.side = 1 AND abs(a.i - b.i) <= 6 GROUP BY 1, 2)",
    "pb AS (SELECT *, coalesce(lead(c) OVER w - 2 * c + lag(c) OVER w, 0) AS bend, arg_max(t, struct_pack(c := c, t := -t)) OVER (PARTITION BY pair) AS peak FROM pc WINDOW w AS (PARTITION BY pair ORDER BY t))",
    "pn AS (SELECT * FROM (SELECT *, max(CASE WHEN bend > 0 AND t < peak THEN t END) OVER (PARTITION BY pair) AS lo, min(CASE WHEN bend > 0 AND t > peak THEN t END) OVER (PARTITION BY pair) AS hi FROM pb) WHERE (lo IS NULL OR t > lo) AND (hi IS NULL OR t < hi))",
    # the normal equations of a parabola by Cramer's rule
    "pe AS (SELECT pair, CAST(count(*) AS DOUBLE) AS n, sum(t) AS s1, sum(t * t) AS s2, sum(pow(t, 3)) AS s3, sum(pow(t, 4)) AS s4, sum(c) AS y0, sum(c * t) AS y1, sum(c * t * t) AS y2 FROM pn GROUP BY 1 HAVING count(*) >= 3)",
    "pf AS (SELECT pair, (y2 * (s2 * n - s1 * s1) - s3 * (y1 * n - s1 * y0) + s2 * (y1 * s1 - s2 * y0)) / d AS a, (s4 * (y1 * n - y0 * s1) - y2 * (s3 * n - s1 * s2) + s2 * (s3 * y0 - y1 * s2)) / d AS b, (s4 * (s2 * y0 - s1 * y1) - s3 * (s3 * y0 - s2 * y1) + y2 * (s3 * s1 - s2 * s2)) / d AS c FROM (SELECT *, s4 * (s2 * n - s1 * s1) - s3 * (s3 * n - s1 * s2) + s2 * (s3 * s1 - s2 * s2) AS d FROM pe))",
)


@query("SELECT pair, round(b / (2 * a), 6) AS correction, round(c - b * b / (4 * a), 6) AS coefficient FROM pf", SAMPLES, *_CORRECTED)
def pick_correction(spark, d):
    """Picks at samples 20 and 22 of pairs of traces."""
    rows = data.samples(spark, d)
    pairs = rows.select((F.col("trace") - F.col("trace") % 2).alias("pair")).distinct().select("pair", F.col("pair").alias("one"), F.lit(20).alias("pick_one"), (F.col("pair") + 1).alias("two"), F.lit(22).alias("pick_two"))
    return rounded(detection.correct_picks(pairs, rows, 6, 8, 6), 6, "correction", "coefficient")
