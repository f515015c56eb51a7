"""Periodograms of windows as rows, and figures of spectra as aggregates over them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import weighted_spectra
from .series import BLOCK


def flanked(length: int, share: float = 0.1) -> np.ndarray:
    """Ones with flanks of half cosines, each ``share`` of the samples and at least one of them."""
    ramp = max(1, int(length * share))
    window = np.ones(length)
    window[:ramp] = 0.5 * (1 - np.cos(np.pi * np.arange(ramp) / ramp))
    window[-ramp:] = window[:ramp][::-1]
    return window


def periodograms(samples: DataFrame, length: int, step: int, rate: float, taper: np.ndarray | None = None, block: int = BLOCK) -> DataFrame:
    """(trace, window, k, frequency, power): one-sided density of windows of (trace, idx, x) without their means, times ``taper``."""
    weights = np.ones(length) if taper is None else taper
    rows = samples.select(F.lit(0).alias("array"), F.col("trace").alias("station"), "idx", "x")
    spectra = weighted_spectra(rows, weights, step, length, 0, length // 2, demean=True, block=block)
    bins = spectra.select(F.col("station").alias("trace"), "window", F.posexplode(F.zip_with("re", "im", lambda a, b: a * a + b * b)).alias("k", "p"))
    sides = F.when((F.col("k") == 0) | (F.col("k") * 2 == length), 1.0).otherwise(2.0)
    return bins.select("trace", "window", F.col("k").cast("long").alias("k"), (F.col("k") * rate / length).alias("frequency"), (F.col("p") * sides / (rate * float((weights**2).sum()))).alias("power"))


def attributes(spectra: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, centre, width, period): root of the mean squared frequency, spread around it and period of the largest bin above 0, by power.

    A spectrum without power has no centre and no width; of equal bins the first gives the period.
    """
    p, f = F.col("power"), F.col("frequency")
    best = F.max(F.when(F.col("k") > 0, F.struct(p.alias("p"), (-f).alias("f"))))
    sums = spectra.groupBy(*keys).agg(F.sum(p).alias("_p"), F.sum(p * f).alias("_pf"), F.sum(p * f * f).alias("_pff"), best.alias("_b"))
    centre = F.sqrt(F.try_divide("_pff", "_p"))
    spread = F.greatest(2 * centre * centre - 2 * centre * F.try_divide("_pf", "_p"), F.lit(0.0))
    return sums.select(*keys, centre.alias("centre"), F.sqrt(spread).alias("width"), F.try_divide(F.lit(-1.0), F.col("_b.f")).alias("period"))
