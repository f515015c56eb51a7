"""Probabilistic power spectral densities as a histogram: periods by decibel bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels


def calendar(time: Column, years: list[int] | None = None, months: list[int] | None = None, weekdays: list[int] | None = None, isoweeks: list[int] | None = None, hours: tuple[float, float] | None = None) -> Column:
    """Which segments to take, by their start; weekday 1 is Monday."""
    out = F.lit(True)
    for part, wanted in ((F.year(time), years), (F.month(time), months), (F.weekday(time) + 1, weekdays), (F.weekofyear(time), isoweeks)):
        if wanted is not None:
            out = out & part.isin(wanted)
    if hours is not None:
        hour = F.hour(time) + F.minute(time) / 60 + F.second(time) / 3600
        out = out & (hour >= hours[0]) & (hour <= hours[1])
    return out


def octave_densities(segments: DataFrame, column: str, rate: float, nfft: int, overlap: int, step: float = 0.125) -> DataFrame:
    """Segments with (bin, period, db) instead of their samples, in one Arrow pass and without a shuffle."""
    density = kernels.on_segments(kernels.octave_densities(rate, nfft, overlap, step=step))(F.col(column))
    shortest = float(kernels.octave_centres(rate, nfft, step)[0])
    rows = segments.select("*", F.posexplode(density).alias("bin", "db")).drop(column).where(~F.isnan("db"))
    return rows.select(*[c for c in segments.columns if c != column], F.col("bin").cast("long").alias("bin"), (shortest * F.pow(F.lit(2.0), F.col("bin") * step)).alias("period"), "db")


def at_period(densities: DataFrame, key: str, period: float) -> DataFrame:
    """(key, db): the bin whose centre is nearest to a period, the shorter of equally near ones."""
    return densities.groupBy(key).agg(F.min_by("db", F.struct(F.abs(F.col("period") - period), "bin")).alias("db"))


def histogram(values: DataFrame, low: float, high: float, step: float) -> DataFrame:
    """(period, bin, n): counts of db in (edge, edge + step]; values outside go to the edge bins."""
    bins = int(round((high - low) / step))
    place = F.ceil((F.col("db") - low) / step) - 1
    return values.groupBy("period", F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def percentile(hist: DataFrame, p: float, low: float, step: float) -> DataFrame:
    """First right edge at which the cumulative share reaches p."""
    order = Window.partitionBy("period").orderBy("bin")
    share = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) * 100.0 / F.sum("n").over(Window.partitionBy("period"))
    return hist.withColumn("_share", share).where(F.col("_share") >= p).groupBy("period").agg((F.min("bin") * step + low + step).alias("db"))


def mode(hist: DataFrame, low: float, step: float) -> DataFrame:
    """Centre of the fullest bin, the lowest of equal ones."""
    return hist.groupBy("period").agg((F.max_by("bin", F.struct("n", -F.col("bin"))) * step + low + step / 2).alias("db"))


def mean(hist: DataFrame, low: float, step: float) -> DataFrame:
    return hist.groupBy("period").agg((F.sum(F.col("n") * (F.col("bin") * step + low + step / 2)) / F.sum("n")).alias("db"))
