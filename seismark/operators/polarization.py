"""Polarisation of three components by the axes of their covariance, in windows: sums of products, then closed forms.

A window's six moments are aggregates over its samples, which join the windows they lie in; eigenvalues of a symmetric 3 x 3
matrix follow from the angle of its normalised determinant, and the first axis from products of its rows. So nothing but a row per
window is left after the aggregation, and all of it stays in column expressions.
"""

from __future__ import annotations

from functools import reduce
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import IDX, TRACE, moving

#: Share of a window that its cosine flanks take.
FLANKS = 0.22
_PAIRS = ("ee", "en", "ez", "nn", "nz", "zz")


def eigenvalues(m: dict[str, Column]) -> list[Column]:
    """Of the symmetric matrix of (e, n, z), falling; null where all entries are 0 is 0."""
    q = (m["ee"] + m["nn"] + m["zz"]) / 3
    d = [m["ee"] - q, m["nn"] - q, m["zz"] - q]
    p = F.sqrt((d[0] * d[0] + d[1] * d[1] + d[2] * d[2] + 2 * (m["en"] * m["en"] + m["ez"] * m["ez"] + m["nz"] * m["nz"])) / 6)
    det = d[0] * (d[1] * d[2] - m["nz"] * m["nz"]) - m["en"] * (m["en"] * d[2] - m["nz"] * m["ez"]) + m["ez"] * (m["en"] * m["nz"] - d[1] * m["ez"])
    turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(det, 2 * p * p * p), F.lit(1.0))))) / 3
    first, last = q + 2 * p * F.cos(turn), q + 2 * p * F.cos(turn + 2 * pi / 3)
    return [first, 3 * q - first - last, last]


def first_axis(m: dict[str, Column], value: Column) -> Column:
    """(e, n, z) along the axis of an eigenvalue: the longest product of two rows of the matrix without it."""
    rows = [(m["ee"] - value, m["en"], m["ez"]), (m["en"], m["nn"] - value, m["nz"]), (m["ez"], m["nz"], m["zz"] - value)]

    def product(a, b) -> Column:
        e, n, z = a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]
        return F.struct((e * e + n * n + z * z).alias("size"), e.alias("e"), n.alias("n"), z.alias("z"))

    return F.greatest(product(rows[0], rows[1]), product(rows[0], rows[2]), product(rows[1], rows[2]))


def _direction(e: Column, n: Column, z: Column) -> tuple[Column, Column]:
    """Azimuth from 0 to 180 and incidence from 0 to 90 degrees of an axis, which has no sense."""
    up = z >= 0
    azimuth = F.degrees(F.atan2(F.when(up, e).otherwise(-e), F.when(up, n).otherwise(-n)))
    return F.when(azimuth < 0, azimuth + 180).otherwise(azimuth), F.degrees(F.atan2(F.sqrt(e * e + n * n), F.abs(z)))


def cut_windows(samples: DataFrame, length: int, step: int, end: int | None = None) -> DataFrame:
    """(trace, window, place, e, n, z): samples (trace, idx, e, n, z) in windows that end before ``end`` or with the trace."""
    first = F.greatest(F.lit(0), F.ceil((F.col(IDX) - length + 1) / step))
    last = F.floor(F.col(IDX) / step)
    ends = samples.groupBy(TRACE).agg((F.max(IDX) + 1).alias("_n"))
    every = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    rows = samples.join(ends, TRACE).withColumn("window", F.explode(every)).where(F.col("window") * step + length <= F.col("_n"))
    rows = rows if end is None else rows.where(F.col("window") * step + length <= end)
    return rows.select(TRACE, "window", (F.col(IDX) - F.col("window") * step).alias("place"), "e", "n", "z")


def _tapered(windows: DataFrame, length: int) -> DataFrame:
    """Without their means in the window, times a window with flanks of half cosines."""
    flank = int(length * FLANKS / 2 + 0.5)
    low, high = max(flank - 1, 1), min(length - flank, length - 2)
    rise = 0.5 * (1 - F.cos(pi * F.col("place") / low))
    fall = 0.5 * (1 + F.cos(pi * (F.col("place") - high) / (length - 1 - high)))
    weight = F.when(F.col("place") <= low, rise).when(F.col("place") >= high, fall).otherwise(1.0)
    means = windows.groupBy(TRACE, "window").agg(*[F.avg(c).alias(f"_{c}") for c in "enz"])
    return windows.join(means, [TRACE, "window"]).select(TRACE, "window", *[((F.col(c) - F.col(f"_{c}")) * weight).alias(c) for c in "enz"])


def _moments(rows: DataFrame, keys: list[str], centred: bool = True) -> tuple[DataFrame, dict[str, Column]]:
    """Covariances of (e, n, z) with the divisor n - 1, by key; not centred: means of products."""
    if not centred:
        sums = rows.groupBy(*keys).agg(*[F.avg(F.col(a) * F.col(b)).alias(f"_{a}{b}") for a, b in _PAIRS])
    else:
        sums = rows.groupBy(*keys).agg(*[F.covar_samp(a, b).alias(f"_{a}{b}") for a, b in _PAIRS])
    return sums, {p: F.col(f"_{p}") for p in _PAIRS}


def axes(rows: DataFrame, keys: list[str], noise: float = 0.0) -> DataFrame:
    """(keys, azimuth, incidence, rectilinearity, planarity) of the covariance of the samples whose square is above ``noise``; 0 without energy."""
    loud = rows.where(F.col("e") * F.col("e") + F.col("n") * F.col("n") + F.col("z") * F.col("z") > noise)
    sums, m = _moments(loud, keys)
    values = [F.greatest(v, F.lit(0.0)) for v in eigenvalues(m)]
    held = sums.where("_ee IS NOT NULL").withColumns({"_v1": values[0], "_v2": values[1], "_v3": values[2]}).withColumn("_axis", first_axis(m, F.col("_v1")))
    azimuth, incidence = _direction(F.col("_axis.e"), F.col("_axis.n"), F.col("_axis.z"))
    rect = F.coalesce(1 - F.sqrt(F.try_divide("_v2", "_v1")), F.lit(0.0))
    planar = F.coalesce(1 - F.try_divide(2 * F.col("_v3"), F.col("_v1") + F.col("_v2")), F.lit(0.0))
    return held.select(*keys, azimuth.alias("azimuth"), incidence.alias("incidence"), rect.alias("rectilinearity"), planar.alias("planarity"))


def sliding_axes(samples: DataFrame, length: int, step: int, noise: float = 0.0, end: int | None = None) -> DataFrame:
    """(trace, window, azimuth, incidence, rectilinearity, planarity) of tapered sliding windows of (trace, idx, e, n, z)."""
    return axes(_tapered(cut_windows(samples, length, step, end), length), [TRACE, "window"], noise)


def particle_motion(samples: DataFrame, length: int, step: int, noise: float = 0.0, end: int | None = None) -> DataFrame:
    """(trace, window, azimuth, incidence): lines through the origin with the least squares of orthogonal distances, n over e and |z| over the
    horizontal, in tapered sliding windows. Windows without a product of e and n, or of both of the others, lie along an axis.
    """
    rows = _tapered(cut_windows(samples, length, step, end), length)
    flat = F.sqrt(F.col("e") * F.col("e") + F.col("n") * F.col("n"))
    loud = rows.where(F.col("e") * F.col("e") + F.col("n") * F.col("n") + F.col("z") * F.col("z") > noise).withColumn("_h", flat).withColumn("_z", F.abs("z"))
    total = lambda a, b: F.sum(F.col(a) * F.col(b))
    sums = loud.groupBy(TRACE, "window").agg(*[total(*p).alias(n) for n, p in {"_xx": ("e", "e"), "_yy": ("n", "n"), "_xy": ("e", "n"), "_hh": ("_h", "_h"), "_vv": ("_z", "_z"), "_hv": ("_h", "_z")}.items()])

    def slope(xx: str, yy: str, xy: str) -> Column:
        gap = F.col(yy) - F.col(xx)
        return F.coalesce(F.try_divide(gap + F.sqrt(gap * gap + 4 * F.col(xy) * F.col(xy)), 2 * F.col(xy)), F.lit(0.0))

    lines = sums.withColumns({"_a": slope("_xx", "_yy", "_xy"), "_i": slope("_hh", "_vv", "_hv")})
    return lines.select(TRACE, "window", F.degrees(F.atan2(F.lit(1.0), F.col("_a"))).alias("azimuth"), F.degrees(F.atan2(F.lit(1.0), F.col("_i"))).alias("incidence"))


def window_eigenvalues(windows: DataFrame, weights: list[float], norm: float = 1.0) -> DataFrame:
    """(trace, idx, small, middle, large, rectilinearity, planarity, d_...) of windows (trace, window, e, n, z): eigenvalues of the covariance
    over ``norm``, and their changes along the windows, filtered by ``weights`` (an odd number) with the ends repeated.
    """
    sums, m = _moments(windows, [TRACE, "window"])
    large, middle, small = (F.greatest(v, F.lit(0.0)) for v in eigenvalues(m))
    rows = sums.where("_ee IS NOT NULL").select(TRACE, F.col("window").alias(IDX), small.alias("_s"), middle.alias("_m"), large.alias("_l"))
    rows = rows.select(
        TRACE,
        IDX,
        *[(F.col(c) / norm).alias(n) for n, c in {"small": "_s", "middle": "_m", "large": "_l"}.items()],
        (1 - F.try_divide(F.col("_m") + F.col("_s"), 2 * F.col("_l"))).alias("rectilinearity"),
        (1 - F.try_divide(2 * F.col("_s"), F.col("_m") + F.col("_l"))).alias("planarity"),
    )
    half = len(weights) // 2

    def change(name: str):
        def value(frame) -> Column:
            def at(k: int) -> Column:
                edge = F.first(name).over(frame(-half, 0)) if k < 0 else F.last(name).over(frame(0, half))
                return F.coalesce(F.first(name).over(frame(k, k)), edge)

            return reduce(lambda a, b: a + b, [w * at(half - j) for j, w in enumerate(weights)])

        return value

    names = ("small", "middle", "large", "rectilinearity", "planarity")
    return moving(rows, half, half, **{f"d_{n}": change(n) for n in names})
