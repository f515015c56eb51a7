"""Queries of sliding polarisation analysis and of the changes of eigenvalues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import polarization
from . import data
from .data import SAMPLES
from .registry import query, rounded
from .waveforms import _AXES

# traces in threes as east, north and vertical on one grid of sample numbers
_SETS = "cs AS (SELECT trace // 3 AS trace, idx, max(x) FILTER (trace % 3 = 0) AS e, max(x) FILTER (trace % 3 = 1) AS n, max(x) FILTER (trace % 3 = 2) AS z FROM s GROUP BY 1, 2 HAVING count(*) = 3)"
_CUT = "cw AS (SELECT cs.trace, win, idx - 6 * win AS i, e, n, z FROM cs JOIN (SELECT trace, max(idx) + 1 AS size FROM cs GROUP BY 1) m ON m.trace = cs.trace, (SELECT unnest(range(0, 400)) AS win) WHERE idx BETWEEN 6 * win AND 6 * win + 15 AND 6 * win + 16 <= size)"
_WEIGHT = "CASE WHEN i <= 1 THEN 0.5 * (1 - cos(pi() * i / 1)) WHEN i >= 14 THEN 0.5 * (1 + cos(pi() * (i - 14) / 1)) ELSE 1 END"
_TAPER = f"tp AS (SELECT trace, win, {', '.join(f'({c} - avg({c}) OVER (PARTITION BY trace, win)) * {_WEIGHT} AS {c}' for c in 'enz')} FROM cw)"
_FLINN = (
    _SETS,
    _CUT,
    _TAPER,
    "cv AS (SELECT trace * 1000 + win AS trace, var_samp(e) AS ee, var_samp(n) AS nn, var_samp(z) AS zz, covar_samp(e, n) AS en, covar_samp(e, z) AS ez, covar_samp(n, z) AS nz FROM tp WHERE e * e + n * n + z * z > 25 GROUP BY ALL HAVING count(*) > 1)",
    *_AXES[2:],
)


def _sets(spark, d) -> DataFrame:
    rows = data.samples(spark, d)
    part = lambda k: F.max(F.when(F.col("trace") % 3 == k, F.col("x")))
    sets = rows.groupBy(F.floor(F.col("trace") / 3).alias("trace"), "idx").agg(part(0).alias("e"), part(1).alias("n"), part(2).alias("z"), F.count("*").alias("_n"))
    return sets.where("_n = 3").drop("_n")


@query(
    "SELECT trace // 1000 AS trace, trace % 1000 AS \"window\", round(CASE WHEN degrees(atan2(sign(u.c) * u.a, sign(u.c) * u.b)) < 0 THEN degrees(atan2(sign(u.c) * u.a, sign(u.c) * u.b)) + 180 ELSE degrees(atan2(sign(u.c) * u.a, sign(u.c) * u.b)) END, 4) AS azimuth, round(degrees(atan2(sqrt(u.a * u.a + u.b * u.b), abs(u.c))), 4) AS incidence, round(1 - sqrt(greatest(l2, 0) / l1), 6) AS rectilinearity, round(1 - 2 * greatest(l3, 0) / (l1 + l2), 6) AS planarity FROM ax",
    SAMPLES,
    *_FLINN,
)
def sliding_polarization(spark, d):
    """Axes of tapered windows of 16 samples, of which only loud samples count."""
    found = polarization.sliding_axes(_sets(spark, d), 16, 6, 25.0)
    return rounded(rounded(found, 4, "azimuth", "incidence"), 6, "rectilinearity", "planarity")


@query(
    "SELECT trace, win AS \"window\", round(degrees(atan2(1, (yy - xx + sqrt(pow(yy - xx, 2) + 4 * xy * xy)) / (2 * xy))), 5) AS azimuth, round(degrees(atan2(1, (vv - hh + sqrt(pow(vv - hh, 2) + 4 * hv * hv)) / (2 * hv))), 5) AS incidence FROM (SELECT trace, win, sum(e * e) AS xx, sum(n * n) AS yy, sum(e * n) AS xy, sum(e * e + n * n) AS hh, sum(z * z) AS vv, sum(sqrt(e * e + n * n) * abs(z)) AS hv FROM tp WHERE e * e + n * n + z * z > 25 GROUP BY 1, 2)",
    SAMPLES,
    *_FLINN[:3],
)
def particle_motion(spark, d):
    return rounded(polarization.particle_motion(_sets(spark, d), 16, 6, 25.0), 5, "azimuth", "incidence")


_CHANGES = (
    _SETS,
    _CUT,
    "cv AS (SELECT trace * 1000 + win AS trace, var_samp(e) AS ee, var_samp(n) AS nn, var_samp(z) AS zz, covar_samp(e, n) AS en, covar_samp(e, z) AS ez, covar_samp(n, z) AS nz FROM cw GROUP BY ALL)",
    *_AXES[2:5],
    "vl AS (SELECT trace // 1000 AS trace, trace % 1000 AS idx, greatest(l3, 0) / 10 AS small, greatest(l2, 0) / 10 AS middle, l1 / 10 AS large, 1 - (greatest(l2, 0) + greatest(l3, 0)) / (2 * l1) AS rectilinearity, 1 - 2 * greatest(l3, 0) / (greatest(l2, 0) + l1) AS planarity FROM ev)",
)
_NAMES = ("small", "middle", "large", "rectilinearity", "planarity")
_FILTER = ", ".join(
    f"round(0.5 * coalesce(lead({c}) OVER w, {c}) + 0.25 * {c} - 0.75 * coalesce(lag({c}) OVER w, {c}), 6) + 0.0 AS d_{c}" for c in _NAMES
)


@query(f"SELECT trace, idx, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _NAMES)}, {_FILTER} FROM vl WINDOW w AS (PARTITION BY trace ORDER BY idx)", SAMPLES, *_CHANGES)
def window_eigenvalues(spark, d):
    found = polarization.window_eigenvalues(polarization.cut_windows(_sets(spark, d), 16, 6), [0.5, 0.25, -0.75], 10.0)
    return rounded(found, 6, *_NAMES, *[f"d_{c}" for c in _NAMES])
