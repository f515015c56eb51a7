"""Instrument responses and amplitudes as column expressions."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The Wood-Anderson seismometer.
WOOD_ANDERSON = {"poles": [-6.283 + 4.7124j, -6.283 - 4.7124j], "zeros": [0j], "gain": 1.0, "sensitivity": 2080.0}


def corner_response(frequency: float, damping: float = 0.707) -> dict:
    """Poles and zeros of a damped pendulum."""
    side = (1 - damping**2) ** 0.5
    return {"poles": [-(damping + side * 1j) * 2 * pi * frequency, -(damping - side * 1j) * 2 * pi * frequency], "zeros": [0j, 0j], "gain": 1.0, "sensitivity": 1.0}


def amplitude(response: dict, frequency: Column) -> Column:
    """Absolute value of a pole-zero response at a frequency."""
    omega = 2 * pi * frequency
    away = lambda root: F.sqrt(F.lit(root.real) * root.real + F.pow(omega - root.imag, F.lit(2)))
    out = F.lit(float(response["gain"]))
    for zero in response["zeros"]:
        out = out * away(zero)
    for pole in response["poles"]:
        out = out / away(pole)
    return out


def wood_anderson_amplitude(response: dict, peak_to_peak: Column, timespan: Column) -> Column:
    """Millimetres on a Wood-Anderson seismometer of a peak-to-peak amplitude in counts over half a period."""
    frequency = 1 / (2 * timespan)
    ground = peak_to_peak / 2 / (amplitude(response, frequency) * response["sensitivity"])
    return ground * amplitude(WOOD_ANDERSON, frequency) * WOOD_ANDERSON["sensitivity"] * 1000


def local_magnitude(amplitude_mm: Column, distance_km: Column) -> Column:
    return F.log10(amplitude_mm) + F.log10(distance_km / 100.0) + 0.00301 * (distance_km - 100.0) + 3.0


def cosine_frequency_taper(frequency: Column, f1: float, f2: float, f3: float, f4: float) -> Column:
    """0 outside [f1, f4], 1 between f2 and f3, cosine flanks."""
    rise = 0.5 * (1 - F.cos(pi * (frequency - f1) / (f2 - f1)))
    fall = 0.5 * (1 + F.cos(pi * (frequency - f3) / (f4 - f3)))
    return F.when((frequency >= f1) & (frequency <= f2), rise).when((frequency > f2) & (frequency < f3), 1.0).when((frequency >= f3) & (frequency <= f4), fall).otherwise(0.0)


def staged_response(stages: DataFrame, roots: DataFrame, keys: list[str], frequencies: list[float]) -> DataFrame:
    """(keys, frequency, amplitude, phase): all stages of a channel at some frequencies, as products over stages and their roots.

    stages: (keys, stage, gain, factor); roots: (keys, stage, kind, re, im) of the analog stages, whose ``factor`` is not null. A
    response with a zero at a frequency has amplitude 0 and no phase there; the phase is in radians and not unwrapped.
    """
    at = F.explode(F.array(*[F.lit(float(f)) for f in frequencies]))
    up = 2 * pi * F.col("frequency") - F.col("im")
    size, turn = F.sqrt(F.col("re") * F.col("re") + up * up), F.atan2(up, -F.col("re"))
    zero = F.col("kind") == "zero"
    # a pole on the axis at the frequency has no amplitude either
    parts = roots.withColumn("frequency", at).groupBy(*keys, "frequency").agg(F.product(F.when(zero, size).otherwise(F.try_divide(F.lit(1.0), size))).alias("_size"), F.sum(F.when(zero, turn).otherwise(-turn)).alias("_turn"))
    gains = stages.groupBy(*keys).agg(F.product(F.coalesce("gain", F.lit(1.0)) * F.coalesce("factor", F.lit(1.0))).alias("_gain")).withColumn("frequency", at)
    rows = gains.join(parts, [*keys, "frequency"], "left")
    value = F.col("_gain") * F.coalesce("_size", F.lit(1.0))
    phase = F.coalesce("_turn", F.lit(0.0)) + F.when(F.col("_gain") < 0, F.lit(pi)).otherwise(0.0)
    return rows.select(*keys, "frequency", F.abs(value).alias("amplitude"), F.when(value != 0, F.atan2(F.sin(phase), F.cos(phase))).alias("phase"))
