"""Queries of filters, spectra, envelopes, interpolation and polarisation; their twins are sums and recursions in SQL."""

from __future__ import annotations

from math import cos, pi, tan

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geodesy
from ..operators import kernels, network, series, spectra
from ..operators import polarization as polarization_operators
from ..streaming import processes
from . import data
from .data import DAYS, PACKETS, SAMPLES, STATIONS, TIMED, VECTORS
from .registry import query, rounded

RATE = 100.0


def _run(spark, d, *run, digits: int = 6) -> DataFrame:
    """(trace, idx, y) of kernels on the vectors."""
    out = data.vectors(spark, d).select("trace", F.posexplode(kernels.on_segments(*run)(F.col("data"))).alias("idx", "y"))
    return rounded(out.select("trace", F.col("idx").cast("long").alias("idx"), "y"), digits, "y")


def _rows(spark, d) -> DataFrame:
    return data.vectors(spark, d).select("trace", F.posexplode("data").alias("idx", "x")).withColumn("idx", F.col("idx").cast("long"))


def _pick(spark, d, names: list[str], *run, digits: int = 6) -> DataFrame:
    """(trace, names...) of kernels that give a few figures for each vector."""
    out = data.vectors(spark, d).select("trace", kernels.on_segments(*run)(F.col("data")).alias("a"))
    return rounded(out.select("trace", *[F.get("a", F.lit(i)).alias(name) for i, name in enumerate(names)]), digits, *names)


# --- filters: the twins run the difference equations, one section after another


def _quadratics(kind: str, corner: float, rate: float = RATE) -> list[tuple[float, ...]]:
    """Sections of a fourth-order low or high pass in closed form: b0 b1 b2 a1 a2."""
    out, k = [], tan(pi * corner / rate)
    for angle in (pi / 8, 3 * pi / 8):
        damping = 2 * cos(angle) * k
        scale = 1 + damping + k * k
        b = (k * k / scale, 2 * k * k / scale, k * k / scale) if kind == "low" else (1 / scale, -2 / scale, 1 / scale)
        out.append((*b, 2 * (k * k - 1) / scale, (1 - damping + k * k) / scale))
    return out


def _cascade(sections: list[tuple[float, ...]], source: str, name: str) -> tuple[str, ...]:
    """Views name1, name2, ...: one per section, each reads the one before; the last one's x is the result."""
    views = []
    for i, (b0, b1, b2, a1, a2) in enumerate(sections, 1):
        y = f"({b0!r} * p.x + f.s1)"
        views.append(
            f"{name}{i} AS (SELECT trace, idx, {b0!r} * x AS x, ({b1!r} - {a1!r} * {b0!r}) * x AS s1, ({b2!r} - {a2!r} * {b0!r}) * x AS s2 FROM {source} WHERE idx = 0"
            f" UNION ALL SELECT p.trace, p.idx, {y}, {b1!r} * p.x - {a1!r} * {y} + f.s2, {b2!r} * p.x - {a2!r} * {y} FROM {name}{i} f JOIN {source} p ON p.trace = f.trace AND p.idx = f.idx + 1)"
        )
        source = f"{name}{i}"
    return tuple(views)


def _quartics(kind: str, low: float, high: float, rate: float = RATE) -> list[tuple[float, ...]]:
    """The two fourth-order difference equations of a fourth-order band filter: b0 ... b4, a1 ... a4.

    s becomes (s^2 + w^2) / (B s), or the inverse, in each quadratic s^2 + 2 s cos(angle) + 1 of the prototype, and
    (1 - 1/z) / (1 + 1/z) then stands for s; powers of both binomials are multiplied out.
    """
    a, b = tan(pi * low / rate), tan(pi * high / rate)
    width, centre = b - a, a * b
    power = lambda k: np.polymul(np.poly1d([-1, 1]) ** k, np.poly1d([1, 1]) ** (4 - k)).coeffs[::-1]
    terms = [np.pad(power(k), (0, 5 - len(power(k)))) for k in range(5)]
    out = []
    for angle in (pi / 8, 3 * pi / 8):
        d = 2 * cos(angle) * width
        analog = [centre**2, d * centre, 2 * centre + width**2, d, 1]
        top = [0, 0, width**2, 0, 0] if kind == "bandpass" else [centre**2, 0, 2 * centre, 0, 1]
        bottom = sum(c * t for c, t in zip(analog, terms, strict=True))
        upper = sum(c * t for c, t in zip(top, terms, strict=True)) / bottom[0]
        out.append((*upper.tolist(), *(bottom[1:] / bottom[0]).tolist()))
    return out


def _wide_cascade(sections: list[tuple[float, ...]], source: str, name: str) -> tuple[str, ...]:
    """Views name1, name2 of fourth-order equations, each with four states."""
    views = []
    for i, (b0, b1, b2, b3, b4, a1, a2, a3, a4) in enumerate(sections, 1):
        first = lambda b, a: f"({b!r} - ({a!r}) * {b0!r}) * x"  # noqa: B023, E731
        y = f"({b0!r} * p.x + f.s1)"
        views.append(
            f"{name}{i} AS (SELECT trace, idx, {b0!r} * x AS x, {first(b1, a1)} AS s1, {first(b2, a2)} AS s2, {first(b3, a3)} AS s3, {first(b4, a4)} AS s4 FROM {source} WHERE idx = 0"
            f" UNION ALL SELECT p.trace, p.idx, {y}, {b1!r} * p.x - ({a1!r}) * {y} + f.s2, {b2!r} * p.x - ({a2!r}) * {y} + f.s3, {b3!r} * p.x - ({a3!r}) * {y} + f.s4, {b4!r} * p.x - ({a4!r}) * {y}"
            f" FROM {name}{i} f JOIN {source} p ON p.trace = f.trace AND p.idx = f.idx + 1)"
        )
        source = f"{name}{i}"
    return tuple(views)


_BAND, _STOP = _quartics("bandpass", 2.0, 20.0), _quartics("bandstop", 8.0, 20.0)
_FILTERED = "SELECT trace, idx, round(x, 6) + 0.0 AS y FROM {}"


def _filtered(spark, d, sections: np.ndarray, zero_phase: bool = False) -> DataFrame:
    return rounded(kernels.filter_blocks(_rows(spark, d), sections, zero_phase), 6, "y")


@query(_FILTERED.format("f2"), VECTORS, *_wide_cascade(_BAND, "v", "f"))
def bandpass(spark, d):
    return _filtered(spark, d, kernels.butterworth("bandpass", 4, RATE, 2.0, 20.0))


@query("SELECT trace, 63 - idx AS idx, round(x, 6) + 0.0 AS y FROM g2", VECTORS, *_wide_cascade(_BAND, "v", "f"), "r AS (SELECT trace, 63 - idx AS idx, x FROM f2)", *_wide_cascade(_BAND, "r", "g"))
def bandpass_zero_phase(spark, d):
    return _filtered(spark, d, kernels.butterworth("bandpass", 4, RATE, 2.0, 20.0), zero_phase=True)


@query(_FILTERED.format("f2"), VECTORS, *_wide_cascade(_STOP, "v", "f"))
def bandstop(spark, d):
    return _filtered(spark, d, kernels.butterworth("bandstop", 4, RATE, 8.0, 20.0))


@query(_FILTERED.format("f2"), VECTORS, *_cascade(_quadratics("low", 10.0), "v", "f"))
def lowpass(spark, d):
    return _filtered(spark, d, kernels.butterworth("lowpass", 4, RATE, high=10.0))


@query(_FILTERED.format("f2"), VECTORS, *_cascade(_quadratics("high", 10.0), "v", "f"))
def highpass(spark, d):
    return _filtered(spark, d, kernels.butterworth("highpass", 4, RATE, low=10.0))


@query(_FILTERED.format("f2"), SAMPLES, *_cascade(_quadratics("low", 10.0), "s", "f"))
def lowpass_long(spark, d):
    """The same filter on traces of any length."""
    return rounded(kernels.filter_blocks(data.samples(spark, d), kernels.butterworth("lowpass", 4, RATE, high=10.0)), 6, "y")


_ALIAS = [(r[0], r[1], r[2], r[4], r[5]) for r in kernels.chebyshev_lowpass(RATE / 8, RATE).tolist()]


@query(f"SELECT trace, idx // 4 AS idx, round(x, 5) + 0.0 AS y FROM f{len(_ALIAS)} WHERE idx % 4 = 0", SAMPLES, *_cascade(_ALIAS, "s", "f"))
def decimate_filtered(spark, d):
    return rounded(kernels.decimate(data.samples(spark, d), 4, RATE), 5, "y")


# --- analytic signal: the twin convolves with the cotangent kernel of the discrete Hilbert transform

_HILBERT = "h AS (SELECT a.trace, a.label, a.idx, any_value(a.x) AS re, sum(CASE WHEN (a.idx - b.idx) % 2 <> 0 THEN b.x / tan(pi() * (a.idx - b.idx) / 64) / 32 ELSE 0 END) AS im FROM {} a JOIN {} b ON b.trace = a.trace GROUP BY 1, 2, 3)"
_ANALYTIC = _HILBERT.format("v", "v")


@query("SELECT trace, idx, round(sqrt(re * re + im * im), 6) AS y FROM h", VECTORS, _ANALYTIC)
def envelope(spark, d):
    return _run(spark, d, kernels.envelope)


_RATES = "SELECT *, (coalesce(lead(re) OVER w, re) - coalesce(lag(re) OVER w, re)) * 100 / CASE WHEN idx IN (0, 63) THEN 1 ELSE 2 END AS dre, (coalesce(lead(im) OVER w, im) - coalesce(lag(im) OVER w, im)) * 100 / CASE WHEN idx IN (0, 63) THEN 1 ELSE 2 END AS dim FROM h WINDOW w AS (PARTITION BY trace ORDER BY idx)"


@query(f"SELECT trace, idx, round((re * dim - im * dre) / (2 * pi() * (re * re + im * im)), 5) + 0.0 AS y FROM ({_RATES})", VECTORS, _ANALYTIC)
def instantaneous_frequency(spark, d):
    return _run(spark, d, kernels.instantaneous_frequency(RATE), digits=5)


@query("SELECT trace, idx, round(abs(coalesce(lead(a) OVER w, a) - coalesce(lag(a) OVER w, a)) * 100 / (4 * pi() * a), 5) + 0.0 AS y FROM (SELECT *, sqrt(re * re + im * im) AS a FROM h) WINDOW w AS (PARTITION BY trace ORDER BY idx)", VECTORS, _ANALYTIC)
def instantaneous_bandwidth(spark, d):
    return _run(spark, d, kernels.instantaneous_bandwidth(RATE), digits=5)


@query("SELECT trace, round(arg_min(idx + 1 + (0.5 * whole - a) / (area - a), idx) / 64, 6) AS centroid FROM (SELECT trace, idx, a, sum(a) OVER (PARTITION BY trace ORDER BY idx) AS area, sum(a) OVER (PARTITION BY trace) AS whole FROM (SELECT *, sqrt(re * re + im * im) AS a FROM h)) WHERE area >= 0.5 * whole AND idx BETWEEN 1 AND 62 GROUP BY 1", VECTORS, _ANALYTIC)
def centroid_time(spark, d):
    return _pick(spark, d, ["centroid"], kernels.centroid)


_LINE = "l AS (SELECT v.trace, v.label, v.idx, v.x - (i + k * v.idx) AS x FROM v JOIN (SELECT trace, regr_slope(x, idx) AS k, regr_intercept(x, idx) AS i FROM v GROUP BY 1) m ON m.trace = v.trace)"


@query("SELECT trace, idx, round(sqrt(re * re + im * im), 6) AS y FROM h", VECTORS, _LINE, *_wide_cascade(_BAND, "l", "f"), "q AS (SELECT *, 0 AS label FROM f2)", _HILBERT.format("q", "q"))
def detrend_filter_envelope(spark, d):
    return _run(spark, d, kernels.polynomial_detrend(1), kernels.sections_filter(kernels.butterworth("bandpass", 4, RATE, 2.0, 20.0)), kernels.envelope)


@query("SELECT label, idx, round(avg(re) * (pow(avg(re / sqrt(re * re + im * im)), 2) + pow(avg(im / sqrt(re * re + im * im)), 2)), 7) + 0.0 AS y FROM h GROUP BY 1, 2", VECTORS, _ANALYTIC)
def stack_phase_weighted(spark, d):
    """Mean of the traces of a label times the squared length of their mean phasor."""
    both = data.vectors(spark, d).select("label", F.size("data").alias("n"), kernels.on_segments(kernels.with_phasors)(F.col("data")).alias("p"))
    rows = both.select("label", "n", F.posexplode("p").alias("place", "x"))
    means = rows.withColumn("part", F.floor(F.col("place") / F.col("n"))).withColumn("idx", F.pmod("place", "n").cast("long"))
    part = lambda k: F.avg(F.when(F.col("part") == k, F.col("x")))
    return rounded(means.groupBy("label", "idx").agg((part(0) * (part(1) * part(1) + part(2) * part(2))).alias("y")), 7, "y")


# --- trends and motion, as aggregates over samples

_CUBIC = (
    "c AS (SELECT s.trace, idx, x, CASE WHEN n > 1 THEN 2.0 * idx / (n - 1) - 1 ELSE 0 END AS t, n FROM s JOIN (SELECT trace, count(*) AS n FROM s GROUP BY 1) m ON m.trace = s.trace)",
    "m AS (SELECT trace, avg(t * t) AS m2, avg(pow(t, 4)) AS m4 FROM c GROUP BY 1)",
    "p AS (SELECT c.*, t * t - m2 AS p2, t * t * t - m4 / m2 * t AS p3 FROM c JOIN m ON m.trace = c.trace)",
    "k AS (SELECT trace, avg(x) AS k0, sum(x * t) / sum(t * t) AS k1, sum(x * p2) / sum(p2 * p2) AS k2, sum(x * p3) / sum(p3 * p3) AS k3 FROM p GROUP BY 1)",
)


@query("SELECT p.trace, idx, round(CASE WHEN n <= 4 THEN 0 ELSE x - k0 - k1 * t - k2 * p2 - k3 * p3 END, 5) + 0.0 AS y FROM p JOIN k ON k.trace = p.trace", SAMPLES, *_CUBIC)
def detrend_polynomial(spark, d):
    return rounded(series.detrend_polynomial(data.samples(spark, d), 3).drop("x"), 5, "y")


@query(
    "SELECT trace, round(max(abs(x)), 5) AS acceleration, round(max(abs(y)), 5) AS velocity, round(max(abs(z)), 5) AS displacement FROM (SELECT *, sum(CASE WHEN idx > 0 THEN (y + py) / 6 ELSE 0 END) OVER w AS z FROM (SELECT *, lag(y) OVER (PARTITION BY trace ORDER BY idx) AS py FROM (SELECT *, sum(CASE WHEN idx > 0 THEN (x + px) / 6 ELSE 0 END) OVER w AS y FROM (SELECT *, lag(x) OVER (PARTITION BY trace ORDER BY idx) AS px FROM (SELECT trace, idx, x / 3 AS x FROM s)) WINDOW w AS (PARTITION BY trace ORDER BY idx ROWS UNBOUNDED PRECEDING))) WINDOW w AS (PARTITION BY trace ORDER BY idx ROWS UNBOUNDED PRECEDING)) GROUP BY 1",
    SAMPLES,
)
def peak_motion(spark, d):
    rows = data.samples(spark, d).withColumn("x", F.col("x") / 3)
    return rounded(series.peak_motion(rows, 1 / 3), 5, "acceleration", "velocity", "displacement")


# --- resampling and interpolation

_DFT = "ft AS (SELECT trace, k, sum(x * cos(2 * pi() * k * idx / {n})) AS re, -sum(x * sin(2 * pi() * k * idx / {n})) AS im FROM {source}, (SELECT unnest(range(0, {n} // 2 + 1)) AS k) GROUP BY 1, 2)"


@query("SELECT trace, m AS idx, round(sum(CASE WHEN k IN (0, 24) THEN 1 ELSE 2 END * (0.5 - 0.5 * cos(2 * pi() * (k + 32) / 64)) * (re * cos(2 * pi() * k * m / 48) - CASE WHEN k IN (0, 24) THEN 0 ELSE im * sin(2 * pi() * k * m / 48) END)) / 64, 6) + 0.0 AS y FROM ft, (SELECT unnest(range(0, 48)) AS m) WHERE k <= 24 GROUP BY 1, 2", VECTORS, _DFT.format(n=64, source="v"))
def resample(spark, d):
    return _run(spark, d, kernels.fourier_resample(64 / 48))


@query("SELECT trace, j AS idx, round(sum(CASE WHEN j * 0.75 = idx THEN x ELSE x * sin(pi() * (j * 0.75 - idx)) / (pi() * (j * 0.75 - idx)) * sin(pi() * (j * 0.75 - idx) / 8) / (pi() * (j * 0.75 - idx) / 8) END), 6) + 0.0 AS y FROM v, (SELECT unnest(range(0, 85)) AS j) WHERE abs(j * 0.75 - idx) <= 8 GROUP BY 1, 2", VECTORS)
def interpolate_lanczos(spark, d):
    return rounded(series.interpolate_lanczos(_rows(spark, d), 0.0, 0.75, 8).withColumnRenamed("k", "idx"), 6, "y")


_SLOPES = (
    "r AS (SELECT *, x - lag(x) OVER w AS a, lead(x) OVER w - x AS b FROM v WINDOW w AS (PARTITION BY trace ORDER BY idx))",
    "sl AS (SELECT trace, idx, x, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN sign(a) <> sign(b) THEN 0 ELSE (a / greatest(abs(a), 2.220446049250313e-16) + b / greatest(abs(b), 2.220446049250313e-16)) / (1 / greatest(abs(a), 2.220446049250313e-16) + 1 / greatest(abs(b), 2.220446049250313e-16)) END AS k FROM r)",
)


@query("SELECT p.trace, j AS idx, round(p.x * (1 + 2 * t) * pow(1 - t, 2) + p.k * t * pow(1 - t, 2) + q.x * t * t * (3 - 2 * t) + q.k * t * t * (t - 1), 6) + 0.0 AS y FROM (SELECT j, CAST(least(floor(j * 0.75), 62) AS BIGINT) AS i, j * 0.75 - least(floor(j * 0.75), 62) AS t FROM (SELECT unnest(range(0, 85)) AS j)) JOIN sl p ON p.idx = i JOIN sl q ON q.trace = p.trace AND q.idx = i + 1", VECTORS, *_SLOPES)
def interpolate_weighted_slopes(spark, d):
    return rounded(series.interpolate_weighted_slopes(_rows(spark, d), 0.0, 0.75).withColumnRenamed("k", "idx"), 6, "y")


# --- spectra

_TAPERED = "tp AS (SELECT trace, idx, (x - avg(x) OVER (PARTITION BY trace)) * w AS x, w FROM v JOIN (SELECT i, CASE WHEN least(i, 63 - i) < 6 THEN 0.5 * (1 - cos(pi() * least(i, 63 - i) / 6)) ELSE 1 END AS w FROM (SELECT unnest(range(0, 64)) AS i)) ON i = idx)"
_POWER = "pd AS (SELECT ft.trace, k, (re * re + im * im) / (100 * ww) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS p FROM ft JOIN (SELECT trace, sum(w * w) AS ww FROM tp GROUP BY 1) n ON n.trace = ft.trace)"


@query("SELECT trace, k AS idx, round(p, 8) AS y FROM pd", VECTORS, _TAPERED, _DFT.format(n=64, source="tp"), _POWER)
def power_density(spark, d):
    found = spectra.periodograms(_rows(spark, d), 64, 64, RATE, spectra.flanked(64))
    return rounded(found.select("trace", F.col("k").alias("idx"), F.col("power").alias("y")), 8, "y")


_LOG_WINDOW = "kw AS (SELECT i, j, CASE WHEN i = j THEN 1 WHEN i = 0 OR j = 0 THEN 0 ELSE pow(sin(40 * log10(j / i)) / (40 * log10(j / i)), 4) END AS w FROM (SELECT CAST(unnest(range(0, 33)) AS DOUBLE) AS i), (SELECT CAST(unnest(range(0, 33)) AS DOUBLE) AS j))"


@query("SELECT trace, CAST(i AS BIGINT) AS idx, round(sum(w * p) / sum(w), 8) AS y FROM pd JOIN kw ON j = k GROUP BY 1, 2", VECTORS, _TAPERED, _DFT.format(n=64, source="tp"), _POWER, _LOG_WINDOW)
def konno_ohmachi(spark, d):
    return _run(spark, d, kernels.power_density(RATE), kernels.konno_ohmachi(np.fft.rfftfreq(64, 1 / RATE)), digits=8)


_CENTRED = "z AS (SELECT trace, idx, x - avg(x) OVER (PARTITION BY trace) AS x FROM v)"
_ENERGY = "en AS (SELECT trace, k, k * 100.0 / 64 AS f, re * re + im * im AS p FROM ft)"


@query("SELECT en.trace, round(any_value(c), 6) AS centre, round(sqrt(sum(p * pow(f - c, 2)) / sum(p)), 6) AS width, round(1 / arg_max(f, CASE WHEN k > 0 THEN p ELSE -1 END), 6) AS period FROM en JOIN (SELECT trace, sqrt(sum(p * f * f) / sum(p)) AS c FROM en GROUP BY 1) m ON m.trace = en.trace GROUP BY 1", VECTORS, _CENTRED, _DFT.format(n=64, source="z"), _ENERGY)
def spectral_attributes(spark, d):
    found = spectra.periodograms(_rows(spark, d), 64, 64, RATE)
    # two-sided energy, as the definition has it
    halved = found.withColumn("power", F.when((F.col("k") == 0) | (F.col("k") == 32), F.col("power")).otherwise(F.col("power") / 2))
    return rounded(spectra.attributes(halved, ["trace"]), 6, "centre", "width", "period")


_SEISMOMETER = (
    "om AS (SELECT k, 2 * pi() * k * 100 / 128 AS o, -pow(2 * pi() * k * 100 / 128, 2) + 2 * 4.44 * 4.44 AS dr, 2 * 4.44 * 2 * pi() * k * 100 / 128 AS di FROM (SELECT unnest(range(0, 65)) AS k))",
    "sz AS (SELECT *, 1500 * o * o / sqrt(dr * dr + di * di) AS size FROM om)",
    "iv AS (SELECT k, CASE WHEN size = 0 THEN 0 ELSE dr / (-1500 * o * o) * least(1, size / fl) END AS ir, CASE WHEN size = 0 THEN 0 ELSE di / (-1500 * o * o) * least(1, size / fl) END AS ii FROM sz, (SELECT max(size) / 1000 AS fl FROM sz))",
)


@query("SELECT trace, m AS idx, round(sum(CASE WHEN ft.k IN (0, 64) THEN (re * ir - im * ii) * cos(pi() * ft.k * m / 64) ELSE 2 * ((re * ir - im * ii) * cos(pi() * ft.k * m / 64) - (re * ii + im * ir) * sin(pi() * ft.k * m / 64)) END) / 128, 8) + 0.0 AS y FROM ft JOIN iv ON iv.k = ft.k, (SELECT unnest(range(0, 64)) AS m) GROUP BY 1, 2", VECTORS, _CENTRED, _DFT.format(n=128, source="z"), *_SEISMOMETER)
def remove_response(spark, d):
    return _run(spark, d, kernels.deconvolve([-4.44 + 4.44j, -4.44 - 4.44j], [0j, 0j], 1500.0, RATE), digits=8)


_HALVES = "hv AS (SELECT trace * 2 + idx // 32 AS trace, idx % 32 AS idx, x * (0.5 - 0.5 * cos(2 * pi() * (idx % 32) / 31)) AS x FROM v)"


@query("SELECT trace // 2 AS trace, (trace % 2) * 6 + CAST(floor(2 * log2(k * 3.125 / 3)) AS BIGINT) AS idx, round(sum(re * re + im * im), 6) AS y FROM ft WHERE k * 3.125 >= 3 AND k * 3.125 < 24 GROUP BY 1, 2", VECTORS, _HALVES, _DFT.format(n=32, source="hv"))
def band_energies(spark, d):
    """Bands without a frequency are left out; those without energy stay."""
    return _run(spark, d, kernels.band_energies(RATE, 3.0, 6, 2)).where((F.col("idx") % 6).isin(kernels.bands_held(RATE, 3.0, 6, 32)))


# --- polarisation: the twin takes eigenvalues of the covariance in closed form

_AXES = (
    "tr AS (SELECT trace, idx % 21 AS i, max(x) FILTER (idx // 21 = 0) AS e, max(x) FILTER (idx // 21 = 1) AS n, max(x) FILTER (idx // 21 = 2) AS z FROM v WHERE idx < 63 GROUP BY 1, 2)",
    "cv AS (SELECT trace, var_pop(e) AS ee, var_pop(n) AS nn, var_pop(z) AS zz, covar_pop(e, n) AS en, covar_pop(e, z) AS ez, covar_pop(n, z) AS nz FROM tr GROUP BY 1)",
    "mq AS (SELECT *, (ee + nn + zz) / 3 AS q, sqrt((pow(ee - (ee + nn + zz) / 3, 2) + pow(nn - (ee + nn + zz) / 3, 2) + pow(zz - (ee + nn + zz) / 3, 2) + 2 * (en * en + ez * ez + nz * nz)) / 6) AS p FROM cv)",
    "mr AS (SELECT *, acos(greatest(-1, least(1, ((ee - q) * ((nn - q) * (zz - q) - nz * nz) - en * (en * (zz - q) - nz * ez) + ez * (en * nz - (nn - q) * ez)) / (2 * p * p * p)))) / 3 AS phi FROM mq)",
    "ev AS (SELECT *, q + 2 * p * cos(phi) AS l1, q + 2 * p * cos(phi + 2 * pi() / 3) AS l3, 3 * q - (q + 2 * p * cos(phi)) - (q + 2 * p * cos(phi + 2 * pi() / 3)) AS l2 FROM mr)",
    # the cross product of two rows of the covariance less its largest value is the axis; the longest of three is taken
    "cr AS (SELECT trace, l1, l2, l3, unnest([struct_pack(a := en * nz - ez * (nn - l1), b := ez * en - (ee - l1) * nz, c := (ee - l1) * (nn - l1) - en * en), struct_pack(a := en * (zz - l1) - ez * nz, b := ez * ez - (ee - l1) * (zz - l1), c := (ee - l1) * nz - en * ez), struct_pack(a := (nn - l1) * (zz - l1) - nz * nz, b := nz * ez - en * (zz - l1), c := en * nz - (nn - l1) * ez)]) AS u FROM ev)",
    "ax AS (SELECT trace, any_value(l1) AS l1, any_value(l2) AS l2, any_value(l3) AS l3, arg_max(u, u.a * u.a + u.b * u.b + u.c * u.c) AS u FROM cr GROUP BY 1)",
)


def _components(spark, d) -> DataFrame:
    thirds = [F.slice("data", F.lit(1 + 21 * i), 21) for i in range(3)]
    rows = data.vectors(spark, d).select("trace", F.posexplode(F.arrays_zip(*[t.alias(c) for t, c in zip(thirds, "enz", strict=True)])).alias("idx", "s"))
    return rows.select("trace", F.col("idx").cast("long").alias("idx"), "s.e", "s.n", "s.z")



@query("SELECT trace, round(CASE WHEN atan2(u.a, u.b) < 0 THEN degrees(atan2(u.a, u.b)) + 180 ELSE degrees(atan2(u.a, u.b)) END, 4) AS azimuth, round(degrees(atan2(sqrt(u.a * u.a + u.b * u.b), abs(u.c))), 4) AS incidence, round(1 - sqrt(l2 / l1), 6) AS rectilinearity, round(1 - 2 * l3 / (l1 + l2), 6) AS planarity FROM ax", VECTORS, *_AXES)
def polarization(spark, d):
    """Axes of thirds of a vector as three components."""
    figures = polarization_operators.axes(_components(spark, d), ["trace"])
    return rounded(rounded(figures, 4, "azimuth", "incidence"), 6, "rectilinearity", "planarity")


# --- recursive kurtosis of a stream, lines on the ellipsoid

_ORDERED = "o AS (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY t) AS i FROM pk)"
_MOMENTS = "ku AS (SELECT trace, 0::BIGINT AS i, 0::BIGINT AS t, 0.0::DOUBLE AS m1, 1.0::DOUBLE AS m2, 0.0::DOUBLE AS k4 FROM o WHERE i = 1 UNION ALL SELECT o.trace, o.i, o.t, 0.95 * m1 + 0.05 * x, 0.95 * m2 + 0.04875 * pow(x - m1, 2), (1.05 - 0.1 * pow(x - m1, 2) / m2) * k4 + 0.05 * pow(pow(x - m1, 2) / m2, 2) FROM ku JOIN o ON o.trace = ku.trace AND o.i = ku.i + 1)"


@query("SELECT trace, t, round(k4 - 3.15, 3) AS y FROM ku WHERE i > 0", PACKETS, _ORDERED, _MOMENTS)
def rt_kurtosis(spark, d):
    return rounded(processes.finish(processes.run_process(data.packets(spark, d), processes.kurtosis(1.0, 20.0)), data.folder(spark)), 3, "y")


_NEAR = "nr AS (SELECT a.station AS one, b.station AS other, atan((1 - 1 / 298.257223563) * tan(radians(a.latitude))) AS u1, atan((1 - 1 / 298.257223563) * tan(radians(b.latitude))) AS u2, radians(b.longitude - a.longitude) AS l FROM st a JOIN st b ON a.station < b.station WHERE degrees(acos(least(1, greatest(-1, sin(radians(a.latitude)) * sin(radians(b.latitude)) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * cos(radians(b.longitude - a.longitude)))))) <= 25.3)"
_SPHERE = "SELECT *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM {}"
_ALPHA = "SELECT *, atan2(ss, cs) AS sg, cos(u1) * cos(u2) * sin(lam) / ss AS al, cs - 2 * sin(u1) * sin(u2) / (1 - pow(cos(u1) * cos(u2) * sin(lam) / ss, 2)) AS cm, 1 - pow(cos(u1) * cos(u2) * sin(lam) / ss, 2) AS fl FROM ({})"
_FLAT = 1 / 298.257223563
_VINCENTY = f"vi AS (SELECT *, l AS lam, 0 AS i FROM nr UNION ALL SELECT one, other, u1, u2, l, l + (1 - c) * {_FLAT!r} * al * (sg + c * ss * (cm + c * cs * (2 * cm * cm - 1))), i + 1 FROM (SELECT *, {_FLAT!r} / 16 * fl * (4 + {_FLAT!r} * (4 - 3 * fl)) AS c FROM ({_ALPHA.format(_SPHERE.format('vi'))})) WHERE i < 25)"
_LENGTH = f"SELECT *, 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu))) AS ba, uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu))) AS bb FROM (SELECT *, fl * (1 / pow(1 - {_FLAT!r}, 2) - 1) AS uu FROM ({_ALPHA.format(_SPHERE.format('vi'))}) WHERE i = 25)"


@query(
    f"SELECT one, other, round(6378137.0 * (1 - {_FLAT!r}) * ba * (sg - bb * ss * (cm + bb / 4 * (cs * (2 * cm * cm - 1) - bb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))), 2) AS meters, round(fmod(degrees(atan2(cos(u2) * sin(lam), cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam))) + 360, 360), 6) AS azimuth, round(fmod(degrees(atan2(cos(u1) * sin(lam), -sin(u1) * cos(u2) + cos(u1) * sin(u2) * cos(lam))) + 540, 360), 6) AS back_azimuth FROM ({_LENGTH})",
    STATIONS,
    _NEAR,
    _VINCENTY,
)
def ellipsoid_pairs(spark, d):
    pairs = geodesy.near_pairs(data.stations(spark, d).drop("network"), "station", 25.3)
    lines = pairs.select(F.col("station").alias("one"), F.col("_station").alias("other"), geodesy.ellipsoid_inverse(F.col("latitude"), F.col("longitude"), F.col("_latitude"), F.col("_longitude")).alias("g"))
    return rounded(rounded(lines.select("one", "other", "g.*"), 2, "meters"), 6, "azimuth", "back_azimuth")


# --- previews, network events, weighted lines

_PREVIEWS = "pv AS (SELECT trace, idx // 10 AS idx, part, round(max(x) - min(x), 6) AS x FROM (SELECT *, idx % 2 AS part FROM d WHERE idx % 7 < 4) GROUP BY 1, 2, 3)"


@query("SELECT g.trace, g.idx, coalesce(max(x), -1.0) AS x FROM (SELECT trace, unnest(range(min(idx), max(idx) + 1)) AS idx FROM pv GROUP BY 1) g LEFT JOIN pv ON pv.trace = g.trace AND pv.idx = g.idx GROUP BY 1, 2", DAYS, _PREVIEWS)
def previews_merged(spark, d):
    rows = data.days(spark, d).where("idx % 7 < 4").withColumn("part", F.col("idx") % 2)
    previews = rows.groupBy("trace", F.floor(F.col("idx") / 10).alias("idx"), "part").agg(F.round(F.max("x") - F.min("x"), 6).alias("x"))
    return series.merge_previews(previews)


_SIZED = "n AS (SELECT trace, count(*) AS n FROM s GROUP BY 1)"


@query("SELECT n.trace, k, max(x) AS x FROM n, (SELECT unnest(range(0, 5)) AS k), s WHERE n >= 5 AND s.trace = n.trace AND idx >= k * n // 5 AND idx < (k + 1) * n // 5 GROUP BY 1, 2", SAMPLES, _SIZED)
def preview_resampled(spark, d):
    return series.resample_preview(data.samples(spark, d), 5)


@query("SELECT n.trace, idx // (n // 5) AS k, max(x) AS x FROM n JOIN s ON s.trace = n.trace WHERE n >= 5 AND idx < 5 * (n // 5) GROUP BY 1, 2", SAMPLES, _SIZED)
def preview_resampled_fast(spark, d):
    return series.resample_preview(data.samples(spark, d), 5, fast=True)


_HIGH = "w AS (SELECT trace, t - t % 60000000 AS a, t - t % 60000000 + 1800000000 + trace % 7 * 600000000 AS z, CASE WHEN trace % 3 = 0 THEN 2 ELSE 1 END AS weight FROM e WHERE x > 90)"
_SCAN = (
    "t AS (SELECT *, row_number() OVER (ORDER BY a, z, trace) AS i FROM w)",
    "sc AS (SELECT i, i AS j, a, z AS off, [trace] AS members, weight AS total FROM t UNION ALL SELECT sc.i, t.i, sc.a, CASE WHEN list_contains(members, t.trace) THEN off ELSE greatest(off, t.z) END, CASE WHEN list_contains(members, t.trace) THEN members ELSE list_append(members, t.trace) END, total + CASE WHEN list_contains(members, t.trace) THEN 0 ELSE t.weight END FROM sc JOIN t ON t.i = sc.j + 1 WHERE list_contains(members, t.trace) OR t.a <= off + 60000000)",
    "qu AS (SELECT i, any_value(a) AS a, max(off) AS off, arg_max(members, j) AS members, max(total) AS total FROM sc GROUP BY 1 HAVING max(total) >= 3)",
)


@query("SELECT a AS start, off AS \"end\", CAST(total AS DOUBLE) AS coincidence_sum, array_to_string(members, ',') AS stations FROM (SELECT *, max(off) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM qu) WHERE before IS NULL OR off > before", TIMED, _HIGH, *_SCAN)
def network_coincidence(spark, d):
    minute = F.col("t") - F.col("t") % 60_000_000
    rows = data.timed(spark, d).where("x > 90").select("trace", minute.alias("a"), (minute + 1_800_000_000 + F.col("trace") % 7 * 600_000_000).alias("z"), F.when(F.col("trace") % 3 == 0, 2).otherwise(1).alias("w"))
    found = network.network_triggers(rows, "a", "z", "trace", 3, "w", 60_000_000)
    return found.withColumn("stations", F.array_join(F.col("stations").cast("array<string>"), ","))


_WEIGHTED = "wl AS (SELECT user_id AS trace, CAST(event_id % 97 AS DOUBLE) AS t, value AS y, 1.0 + event_id % 3 AS w FROM events)"


def _weighted(spark, d) -> DataFrame:
    return data.table(spark, d, "events").select(F.col("user_id").alias("trace"), (F.col("event_id") % 97).cast("double").alias("t"), F.col("value").alias("y"), (1.0 + F.col("event_id") % 3).alias("w"))


@query("SELECT trace, round(k, 6) + 0.0 AS slope, round(sqrt(max(sxx0) * (sum(w * w * pow(y - k * t, 2)) / (count(*) - 1))), 6) AS slope_error FROM (SELECT wl.*, sum(w * w * t * y) OVER p / sum(w * w * t * t) OVER p AS k, 1 / sum(w * w * t * t) OVER p AS sxx0 FROM wl WINDOW p AS (PARTITION BY trace)) GROUP BY trace, k HAVING count(*) > 1", _WEIGHTED)
def regression_through_origin(spark, d):
    return rounded(series.weighted_line(_weighted(spark, d), "t", "y", "w", origin=True).select("trace", "slope", "slope_error"), 6, "slope", "slope_error")


@query("SELECT trace, round(k, 6) + 0.0 AS slope, round(i, 5) + 0.0 AS intercept, round(sqrt(sum(w * w * pow(y - k * t - i, 2)) / (count(*) - 2) / sum(w * w * pow(t - tm, 2))), 6) AS slope_error, round(sqrt(sum(w * w * pow(y - k * t - i, 2)) / (count(*) - 2) * (1 / sum(w * w) + tm * tm / sum(w * w * pow(t - tm, 2)))), 5) AS intercept_error FROM (SELECT *, ym - k * tm AS i FROM (SELECT *, sum(w * w * (t - tm) * (y - ym)) OVER p / sum(w * w * pow(t - tm, 2)) OVER p AS k FROM (SELECT *, sum(w * w * t) OVER p / sum(w * w) OVER p AS tm, sum(w * w * y) OVER p / sum(w * w) OVER p AS ym FROM wl WINDOW p AS (PARTITION BY trace)) WINDOW p AS (PARTITION BY trace))) GROUP BY trace, k, i, tm HAVING count(*) > 2", _WEIGHTED)
def regression_weighted(spark, d):
    out = series.weighted_line(_weighted(spark, d), "t", "y", "w").select("trace", "slope", "intercept", "slope_error", "intercept_error")
    return rounded(rounded(out, 6, "slope", "slope_error"), 5, "intercept", "intercept_error")
