"""Streams, catalogs and inventories as tables: put together, repeated, picked by place, labelled and checked."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .series import IDX, TRACE


def joined(*tables: DataFrame) -> DataFrame:
    """All rows of all tables, in no order; columns that a table lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def repeated(rows: DataFrame, times: int) -> DataFrame:
    """Each row ``times`` times, with its ``copy`` from 0; none for 0."""
    return rows.withColumn("copy", F.explode(F.when(F.lit(times) > 0, F.sequence(F.lit(0), F.lit(times - 1))).otherwise(F.array().cast("array<int>"))))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with ``place``, their number from 0 in the order of the given columns (which should tell all rows apart).

    They are dealt by range, numbered apart, and moved by the number of rows in the ranges before, which is one row per range.
    """
    dealt = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order))))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return dealt.join(F.broadcast(base), "_part").withColumn("place", F.col("_base") + F.col("_in") - 1).drop("_part", "_in", "_base")


def _sliced(place: Column, count: Column, start: int | None, stop: int | None, step: int) -> Column:
    """Whether a place is in a slice with a positive step; negative bounds count from the end."""
    low = F.lit(0) if start is None else F.lit(start) if start >= 0 else F.greatest(count + start, F.lit(0))
    high = count if stop is None else F.lit(stop) if stop >= 0 else count + stop
    return (place >= low) & (place < high) & ((place - low) % step == 0)


def picked(rows: DataFrame, order: list[str], start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Rows of a slice of a table in an order, with their place in the whole."""
    placed = numbered(rows, *order)
    return placed.where(_sliced(F.col("place"), F.lit(placed.count()), start, stop, step))


def sample_slice(df: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Samples of a slice of each trace (trace, idx, ...)."""
    sizes = df.groupBy(TRACE).agg((F.max(IDX) + 1).alias("_n"))
    return df.join(sizes, TRACE).where(_sliced(F.col(IDX), F.col("_n"), start, stop, step)).drop("_n")


def label(template: str) -> Column:
    """A text with columns in braces, as {network}.{station}; null columns are empty."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(F.col(p).cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def stack(df: DataFrame, group_by: str, method: str = "linear", power: float = 2.0, samples_tolerance: int = 0, time_tolerance: float = 0.0) -> DataFrame:
    """(label, idx, y, traces): mean of the traces (trace, idx, x, start, codes) whose labels agree; root: of signed roots, raised again.

    Traces of a label may differ by ``samples_tolerance`` samples, of which all take the least, and by ``time_tolerance`` seconds in
    their start; a label whose traces differ by more is an error of that label: it has no samples, and ``problem`` tells why.
    """
    rows = df.withColumn("label", label(group_by))
    sizes = rows.groupBy("label", TRACE).agg((F.max(IDX) + 1).alias("_n"), F.min("start").alias("_t"))
    spans = sizes.groupBy("label").agg(F.min("_n").alias("_low"), F.max("_n").alias("_high"), F.min("_t").alias("_a"), F.max("_t").alias("_z"), F.count("*").alias("traces"))
    problem = F.when(F.col("_high") - F.col("_low") > samples_tolerance, "different lengths").when((F.col("_z") - F.col("_a")) > time_tolerance, "different starts")
    spans = spans.withColumn("problem", problem)
    held = rows.join(spans, "label").where(F.col("problem").isNull() & (F.col(IDX) < F.col("_low")))
    if method == "root":
        mean = F.avg(F.signum("x") * F.pow(F.abs("x"), F.lit(1 / power)))
        value = F.signum(mean) * F.pow(F.abs(mean), F.lit(power))
    else:
        value = F.avg("x")
    sums = held.groupBy("label", IDX).agg(value.alias("y"), F.first("traces").alias("traces"))
    return sums.withColumn("problem", F.lit(None).cast("string")).unionByName(spans.where("problem IS NOT NULL").select("label", "traces", "problem"), allowMissingColumns=True)


def checked(traces: DataFrame) -> DataFrame:
    """(trace, problem) of headers (trace, npts, rate, delta, start, end in seconds) and ``samples``, the number of samples that are there.

    The first rule that a trace breaks: a rate above 0, an interval that is its inverse, as many samples as the header says, an end
    that follows from start, rate and samples. Sound traces have no problem.
    """
    near = lambda a, b: F.abs(a - b) <= 1e-6 * F.greatest(F.abs(a), F.lit(1.0))
    last = F.col("start") + F.greatest(F.col("npts") - 1, F.lit(0)) / F.col("rate")
    problem = (
        F.when(F.coalesce(F.col("rate") <= 0, F.lit(True)), "no sampling rate")
        .when(~near(F.col("delta") * F.col("rate"), F.lit(1.0)), "rate and interval differ")
        .when(F.col("npts") != F.col("samples"), "other number of samples")
        .when(F.col("end") < F.col("start"), "ends before its start")
        .when(~near(F.col("end") - F.col("start"), last - F.col("start")), "end does not follow")
    )
    return traces.select(TRACE, problem.alias("problem"))


def regions(points: DataFrame, runs: DataFrame, names: DataFrame) -> DataFrame:
    """``points`` (latitude, longitude, ...) with number and name of their region, by a raster of degrees.

    runs: (north, east, degree, start, number): in a quadrant, from ``start`` degrees of longitude on, a band of whole degrees of
    latitude belongs to a region, until the next start. The raster has at most four times 91 bands, which are broadcast; a point
    looks its band up by key and takes the last run that starts before it. Points outside of the raster have no region.
    """
    lat, lon = F.abs("latitude"), F.abs("longitude")
    bands = runs.groupBy("north", "east", "degree").agg(F.array_sort(F.collect_list(F.struct("start", "number"))).alias("_runs"))
    placed = points.withColumns({"north": F.col("latitude") >= 0, "east": F.col("longitude") >= 0, "degree": F.floor(lat).cast("int")})
    near = F.filter("_runs", lambda r: r["start"] <= F.floor(lon))
    found = placed.join(F.broadcast(bands), ["north", "east", "degree"], "left").withColumn("number", F.try_element_at(near, F.lit(-1))["number"]).drop("_runs", "north", "east", "degree")
    return found.join(F.broadcast(names.select("number", "name")), "number", "left")
