"""Queries of the wavelet transform and of time-frequency misfits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import timefreq
from . import data
from .data import SAMPLES, VECTORS
from .registry import query, rounded

_DT, _LOW, _HIGH, _COUNT, _W0 = 0.01, 2.0, 30.0, 5, 6
_CWT = (
    "fq AS (SELECT k, pow(10, log10(2.0) + k * (log10(30.0) - log10(2.0)) / 4) AS f FROM (SELECT unnest(range(0, 5)) AS k))",
    "cw AS (SELECT trace, k, n AS idx, sum(x * g * cos(6 * u)) AS re, -sum(x * g * sin(6 * u)) AS im FROM (SELECT v.trace, k, n, x, (v.idx - n + 0.5) * 0.01 / a AS u, exp(-pow((v.idx - n + 0.5) * 0.01 / a, 2) / 2) * pow(pi(), -0.25) * 0.01 / sqrt(a) AS g FROM {} v JOIN (SELECT k, 6 / (2 * pi() * f) AS a FROM fq) q ON true JOIN (SELECT trace, idx AS n FROM {}) p ON p.trace = v.trace) GROUP BY 1, 2, 3)",
)


def _cwt(source: str) -> tuple[str, ...]:
    return _CWT[0], _CWT[1].format(source, source)


def _vectors(spark, d) -> DataFrame:
    return data.vectors(spark, d).select("trace", F.posexplode("data").alias("idx", "x"))


@query("SELECT trace, k, idx, round(re, 7) + 0.0 AS re, round(im, 7) + 0.0 AS im FROM cw", SAMPLES, *_cwt("s"))
def wavelet_transform(spark, d):
    """Morlet transform of traces of any length at five frequencies."""
    return rounded(timefreq.wavelet_transform(data.samples(spark, d), ["trace"], _DT, _LOW, _HIGH, _COUNT, _W0), 7, "re", "im")


_SAME = "ab AS (SELECT trace // 2 AS trace, trace % 2 AS component, k, idx, sqrt(re * re + im * im) AS a, lead_re, lead_im, re, im, sqrt(lead_re * lead_re + lead_im * lead_im) AS b FROM (SELECT c.*, e.re AS lead_re, e.im AS lead_im FROM cw c JOIN cw e ON e.trace = c.trace + 2 AND e.k = c.k AND e.idx = c.idx))"
_PHASE = "ph AS (SELECT *, atan2(im * lead_re - re * lead_im, re * lead_re + im * lead_im) / pi() AS phase, max(a) OVER (PARTITION BY trace) > max(b) OVER (PARTITION BY trace) AS first FROM ab)"
_WEIGHED = {True: "wt AS (SELECT *, b AS r, b AS other FROM ph)", False: "wt AS (SELECT *, CASE WHEN first THEN a ELSE b END AS r, CASE WHEN first THEN b ELSE a END AS other FROM ph)"}
_SUMS = {
    "time_frequency": "SELECT trace, component, k, idx, a - b AS e, r * phase AS p, r, r AS w FROM wt",
    "time": "SELECT trace, component, idx, sum(a - b) AS e, sum(other * phase) AS p, sum(r) AS r, sum(other) AS w FROM wt GROUP BY ALL",
    "frequency": "SELECT trace, component, k, sum(a - b) AS e, sum(r * phase) AS p, sum(r) AS r, sum(r) AS w FROM wt GROUP BY ALL",
    "single": "SELECT trace, component, sqrt(sum(pow(a - b, 2))) AS e, sqrt(sum(pow(r * phase, 2))) AS p, sqrt(sum(r * r)) AS r, sqrt(sum(r * r)) AS w FROM wt GROUP BY ALL",
}


def _register(place: str, local: bool) -> None:
    places = "".join(f", {c}" for c in timefreq.PLACES[place])
    over = "" if local else " OVER (PARTITION BY trace)"
    most = (lambda c: c) if local else (lambda c: f"max({c}){over}")
    oracle = (
        f"SELECT trace, component{places}, round(e, 6) + 0.0 AS envelope, round(p, 6) + 0.0 AS phase, round(10 * exp(-abs(e)), 5) AS envelope_fit, round(10 * (1 - abs(p)), 5) AS phase_fit "
        f"FROM (SELECT trace, component{places}, e / {most('r')} AS e, p / {most('w')} AS p FROM ({_SUMS[place]}))"
    )

    def make(spark, d):
        pairs = _pairs(spark, d, not local)
        found = timefreq.misfits(pairs, place, local)
        good = timefreq.fits(F.col("envelope"), F.col("phase"))
        found = found.withColumns({"envelope_fit": good[0], "phase_fit": good[1]})
        return rounded(rounded(found, 6, "envelope", "phase"), 5, "envelope_fit", "phase_fit")

    make.__name__ = f"misfits_{place}_local" if local else f"misfits_{place}"
    query(oracle, VECTORS, *_cwt("v"), _SAME, _PHASE, _WEIGHED[not local])(make)


def _pairs(spark, d, reference: bool) -> DataFrame:
    """Traces 2 n and 2 n + 1 as two components, compared with those of the next n."""
    w = timefreq.wavelet_transform(_vectors(spark, d), ["trace"], _DT, _LOW, _HIGH, _COUNT, _W0)
    at = lambda shift: w.withColumn("component", F.col("trace") % 2).withColumn("trace", F.floor(F.col("trace") / 2) - shift)
    return timefreq.compared(at(0), at(1), reference)


for _place in timefreq.PLACES:
    for _local in (False, True):
        _register(_place, _local)
