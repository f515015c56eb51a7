"""Queries of splines; the twins solve the equations sample by sample, forwards and backwards."""

from __future__ import annotations

from ..operators import splines
from . import data
from .data import SAMPLES
from .registry import query, rounded

_SIZED = "sz AS (SELECT *, count(*) OVER (PARTITION BY trace) AS n FROM s)"
_D2 = "d2 AS (SELECT trace, idx, n, x, lead(x) OVER w - 2 * x + lag(x) OVER w AS d FROM sz WHERE n >= 6 WINDOW w AS (PARTITION BY trace ORDER BY idx))"
# second derivatives m: m1 and m(n-2) are second differences, and those between solve m(i-1) + 4 m(i) + m(i+1) = 6 d(i)
_CUBIC = (
    _SIZED,
    _D2,
    "up AS (SELECT trace, CAST(1 AS BIGINT) AS idx, 0.0::DOUBLE AS c, d AS r FROM d2 WHERE idx = 1 UNION ALL SELECT p.trace, p.idx, CASE WHEN p.idx = n - 2 THEN 0.0 ELSE 1 / (4 - up.c) END, CASE WHEN p.idx = n - 2 THEN p.d ELSE (6 * p.d - up.r) / (4 - up.c) END FROM up JOIN d2 p ON p.trace = up.trace AND p.idx = up.idx + 1 WHERE p.idx <= n - 2)",
    "dn AS (SELECT trace, n - 2 AS idx, d AS m FROM d2 WHERE idx = n - 2 UNION ALL SELECT dn.trace, dn.idx - 1, up.r - up.c * dn.m FROM dn JOIN up ON up.trace = dn.trace AND up.idx = dn.idx - 1)",
    "ms AS (SELECT trace, idx, m FROM dn UNION ALL SELECT trace, 0, 2 * max(CASE WHEN idx = 1 THEN m END) - max(CASE WHEN idx = 2 THEN m END) FROM dn GROUP BY 1 UNION ALL SELECT dn.trace, max(n) - 1, 2 * max(CASE WHEN idx = n - 2 THEN m END) - max(CASE WHEN idx = n - 3 THEN m END) FROM dn JOIN (SELECT DISTINCT trace, n FROM sz) z ON z.trace = dn.trace GROUP BY 1)",
    "sg AS (SELECT z.trace, z.idx, n, x, m, lead(x) OVER w AS xn, lead(m) OVER w AS mn FROM sz z JOIN ms ON ms.trace = z.trace AND ms.idx = z.idx WINDOW w AS (PARTITION BY z.trace ORDER BY z.idx))",
)
_PLACES = "(SELECT trace, k, 0.3 + k * 0.7 AS p FROM (SELECT trace, n, unnest(range(0, CAST(floor((n - 1 - 0.3) / 0.7) AS BIGINT) + 1)) AS k FROM (SELECT DISTINCT trace, n FROM sz WHERE n >= 6)))"


@query(
    f"SELECT trace, k, round(x * (1 - u) + xn * u + (pow(1 - u, 3) - (1 - u)) * m / 6 + (pow(u, 3) - u) * mn / 6, 6) + 0.0 AS y FROM (SELECT q.trace, k, q.p - sg.idx AS u, x, xn, m, mn FROM {_PLACES} q JOIN sg ON sg.trace = q.trace AND sg.idx = least(CAST(floor(q.p) AS BIGINT), n - 2))",
    SAMPLES,
    *_CUBIC,
)
def interpolate_cubic(spark, d):
    return rounded(splines.interpolate_spline(_long(spark, d), 0.3, 0.7, 3), 6, "y")


def _long(spark, d):
    """Traces of at least six samples."""
    rows = data.samples(spark, d)
    held = rows.groupBy("trace").count().where("count >= 6").select("trace")
    return rows.join(held, "trace")


@query("SELECT trace, idx, round(coalesce(sum((x + xn) / 2 - (m + mn) / 24) OVER (PARTITION BY trace ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 0.5, 5) + 0.0 AS y FROM sg", SAMPLES, *_CUBIC)
def integrate_spline(spark, d):
    return rounded(splines.integrate_spline(_long(spark, d), 0.5), 5, "y")


# coefficients c of quadratics with knots in the middles: c(i-1) + 6 c(i) + c(i+1) = 8 x(i); one polynomial spans the first two samples
_QUADRATIC = (
    _SIZED,
    "qx AS (SELECT trace, idx, n, x, lag(x) OVER w AS xb, lead(x) OVER w AS xn FROM sz WHERE n >= 6 WINDOW w AS (PARTITION BY trace ORDER BY idx))",
    "qu AS (SELECT trace, CAST(1 AS BIGINT) AS idx, 1 / 7.0::DOUBLE AS c, (9 * x - xb) / 7 AS r FROM qx WHERE idx = 1 UNION ALL SELECT p.trace, p.idx, 1 / ((CASE WHEN p.idx = n - 2 THEN 7 ELSE 6 END) - qu.c), (CASE WHEN p.idx = n - 2 THEN 9 * p.x - p.xn ELSE 8 * p.x END - qu.r) / ((CASE WHEN p.idx = n - 2 THEN 7 ELSE 6 END) - qu.c) FROM qu JOIN qx p ON p.trace = qu.trace AND p.idx = qu.idx + 1 WHERE p.idx <= n - 2)",
    "qd AS (SELECT trace, max(idx) AS idx, arg_max(r, idx) AS c FROM qu GROUP BY 1 UNION ALL SELECT qd.trace, qd.idx - 1, qu.r - qu.c * qd.c FROM qd JOIN qu ON qu.trace = qd.trace AND qu.idx = qd.idx - 1)",
    "qe AS (SELECT trace, idx, c FROM qd UNION ALL SELECT qd.trace, 0, c + xb - x FROM qd JOIN qx ON qx.trace = qd.trace AND qx.idx = 1 WHERE qd.idx = 1 UNION ALL SELECT qd.trace, n - 1, c + xn - x FROM qd JOIN qx ON qx.trace = qd.trace AND qx.idx = n - 2 WHERE qd.idx = n - 2)",
    "qa AS (SELECT trace, idx, c, lag(c) OVER w AS cb, lead(c) OVER w AS cn, lead(c, 2) OVER w AS c2, lag(c, 2) OVER w AS b2 FROM qe WINDOW w AS (PARTITION BY trace ORDER BY idx))",
    "qf AS (SELECT trace, idx, c, coalesce(cb, 3 * c - 3 * cn + c2) AS cb, coalesce(cn, 3 * c - 3 * cb + b2) AS cn FROM qa)",
)


@query(f"SELECT trace, k, round(cb * pow(0.5 - u, 2) / 2 + c * (0.75 - u * u) + cn * pow(0.5 + u, 2) / 2, 6) + 0.0 AS y FROM (SELECT q.trace, k, q.p - qf.idx AS u, c, cb, cn FROM {_PLACES} q JOIN qf ON qf.trace = q.trace AND qf.idx = CAST(floor(q.p + 0.5) AS BIGINT))", SAMPLES, *_QUADRATIC)
def interpolate_quadratic(spark, d):
    return rounded(splines.interpolate_spline(_long(spark, d), 0.3, 0.7, 2), 6, "y")


@query(f"SELECT trace, k, round(x + coalesce(xn - x, 0) * u, 6) + 0.0 AS y FROM (SELECT q.trace, k, q.p - z.idx AS u, x, xn FROM {_PLACES} q JOIN (SELECT *, lead(x) OVER (PARTITION BY trace ORDER BY idx) AS xn FROM sz) z ON z.trace = q.trace AND z.idx = CAST(floor(q.p) AS BIGINT))", SAMPLES, _SIZED)
def interpolate_slinear(spark, d):
    return rounded(splines.interpolate_spline(_long(spark, d), 0.3, 0.7, 1), 6, "y")


# least squares by hats on the nodes 0, 5, 15, ... and the end: equations of neighbours only
_TREND = (
    _SIZED,
    "nd AS (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY p) AS j, lag(p) OVER (PARTITION BY trace ORDER BY p) AS a, lead(p) OVER (PARTITION BY trace ORDER BY p) AS z FROM (SELECT DISTINCT trace, n, p FROM (SELECT trace, n, unnest(list_concat([0.0, n - 1.0], list_filter(list_transform(range(0, n), lambda i: 5.0 + 10 * i), lambda p: p < n - 1 AND p < n - 3))) AS p FROM (SELECT DISTINCT trace, n FROM sz WHERE n >= 6))))",
    "ht AS (SELECT sz.trace, idx, x, j, CASE WHEN idx <= p AND a IS NOT NULL THEN (idx - a) / (p - a) WHEN idx >= p AND z IS NOT NULL THEN (z - idx) / (z - p) ELSE 1 END AS h FROM sz JOIN nd ON nd.trace = sz.trace AND idx >= coalesce(a, p) AND idx <= coalesce(z, p))",
    "eq AS (SELECT o.trace, o.j, sum(o.h * o.h) AS b, sum(o.h * o.x) AS r, coalesce(sum(o.h * k.h), 0) AS c FROM ht o LEFT JOIN ht k ON k.trace = o.trace AND k.idx = o.idx AND k.j = o.j + 1 GROUP BY 1, 2)",
    "tu AS (SELECT trace, j, c / b AS g, r / b AS y, c FROM eq WHERE j = 1 UNION ALL SELECT e.trace, e.j, e.c / (e.b - tu.c * tu.g), (e.r - tu.c * tu.y) / (e.b - tu.c * tu.g), e.c FROM tu JOIN eq e ON e.trace = tu.trace AND e.j = tu.j + 1)",
    "td AS (SELECT trace, max(j) AS j, arg_max(y, j) AS w FROM tu GROUP BY 1 UNION ALL SELECT td.trace, tu.j, tu.y - tu.g * td.w FROM td JOIN tu ON tu.trace = td.trace AND tu.j = td.j - 1)",
)


@query("SELECT ht.trace, idx, round(any_value(x) - sum(h * w), 6) + 0.0 AS y FROM ht JOIN td ON td.trace = ht.trace AND td.j = ht.j GROUP BY 1, 2", SAMPLES, *_TREND)
def detrend_spline(spark, d):
    return rounded(splines.detrend_spline(_long(spark, d), 1, 10), 6, "y")
