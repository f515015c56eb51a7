"""Relative calibration of one sensor by another, and mean spectra of windows."""

from __future__ import annotations

from math import pi

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import weighted_spectra
from .series import BLOCK


def welch_spectra(samples: DataFrame, taper: np.ndarray, size: int, overlap: float = 0.0, block: int = BLOCK) -> DataFrame:
    """(array, station, k, power): mean over the windows of the squared transform over the window's energy, bins 0 to size / 2; bin 0 repeats bin 1."""
    spectra = weighted_spectra(samples, taper, max(1, round((1 - overlap) * len(taper))), size, 0, size // 2, block=block)
    power = F.zip_with("re", "im", lambda a, b: a * a + b * b)
    rows = spectra.select("array", "station", F.posexplode(power).alias("k", "p"))
    means = rows.groupBy("array", "station", F.col("k").cast("long").alias("k")).agg((F.avg("p") / float((taper**2).sum())).alias("power"))
    second = F.max(F.when(F.col("k") == 1, F.col("power"))).over(Window.partitionBy("array", "station"))
    return means.withColumn("power", F.when(F.col("k") == 0, second).otherwise(F.col("power")))


def _unwrapped(angle: Column, order) -> Column:
    """Angles without jumps of more than half a turn."""
    step = angle - F.lag(angle).over(order)
    turns = F.coalesce(-F.when(F.abs(step) > pi, F.signum(step) * F.ceil((F.abs(step) - pi) / (2 * pi))).otherwise(0.0), F.lit(0.0))
    return turns


def relative_response(samples: DataFrame, known: DataFrame, length: int, rate: float, overlap: float = 0.5, block: int = BLOCK) -> DataFrame:
    """(array, k, frequency, amplitude, phase): response of the sensor "new" of each array from the one, "known", beside it.

    samples: (array, station, idx, x) with both as stations; known: (k, re, im), the known response at k rate / size, size being
    the power of two from ``length`` up. Spectra of both in windows under a bell, those that both have, give a quotient for each
    bin; its mean over the windows times the known response is the new one. Windows without energy at a bin do not count there.
    The phase is unwrapped from bin 1 on.
    """
    size = 1 << (length - 1).bit_length()
    spectra = weighted_spectra(samples, np.hanning(size), max(1, int(size - size * overlap)), size, 0, size // 2, block=block)
    side = lambda name, re, im: spectra.where(F.col("station") == name).select("array", "window", F.col("re").alias(re), F.col("im").alias(im))
    both = side("known", "_a", "_b").join(side("new", "_c", "_d"), ["array", "window"])
    bins = both.select("array", F.posexplode(F.arrays_zip("_a", "_b", "_c", "_d")).alias("k", "s")).where("k > 0").select("array", F.col("k").cast("long").alias("k"), "s.*")
    energy = F.col("_a") * F.col("_a") + F.col("_b") * F.col("_b")
    # the conjugate of new over known
    quotient = [F.avg(F.try_divide(x, energy)) for x in (F.col("_c") * F.col("_a") + F.col("_d") * F.col("_b"), F.col("_c") * F.col("_b") - F.col("_d") * F.col("_a"))]
    means = bins.groupBy("array", "k").agg(quotient[0].alias("_p"), quotient[1].alias("_q")).join(F.broadcast(known) if known.count() <= size else known, "k")
    re, im = F.col("_p") * F.col("re") - F.col("_q") * F.col("im"), F.col("_p") * F.col("im") + F.col("_q") * F.col("re")
    out = means.select("array", "k", (F.col("k") * rate / size).alias("frequency"), F.sqrt(re * re + im * im).alias("amplitude"), F.atan2(im, re).alias("_angle"))
    order = Window.partitionBy("array").orderBy("k")
    turned = out.withColumn("_turns", _unwrapped(F.col("_angle"), order))
    return turned.select("array", "k", "frequency", "amplitude", (F.col("_angle") + 2 * pi * F.sum("_turns").over(order)).alias("phase"))
