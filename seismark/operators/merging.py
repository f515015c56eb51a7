"""Merging overlapping segments and cutting or padding traces, on rows of (trace, part, idx, x): one per sample of a segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRACE = "trace"


def _segments(samples: DataFrame) -> DataFrame:
    """(trace, part, first, last, reach, order): reach is the last sample of all segments before, in order of start and end."""
    spans = samples.groupBy(TRACE, "part").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    order = Window.partitionBy(TRACE).orderBy("first", "last", "part")
    return spans.withColumn("reach", F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("order", F.row_number().over(order))


def merge(samples: DataFrame, method: int = 0, interpolation: int = 0, fill: float | None = None) -> DataFrame:
    """One value per (trace, idx) of segments without gaps.

    Method 0: an overlap whose values all agree stays, any other becomes ``fill`` (null without one) as a whole. Method 1: the
    later segment's values count, but a segment that earlier ones cover adds nothing; the first ``interpolation`` samples of
    an overlap (-1: all of it) lie on a line from the sample before it to the later segment's next one.
    """
    segments = _segments(samples)
    rows = samples.join(segments, [TRACE, "part"])
    if method == 0:
        overlap = F.col("idx") <= F.col("reach")
        values = rows.groupBy(TRACE, "idx").agg(F.max(F.struct("order", "x"))["x"].alias("x"), (F.min("x") != F.max("x")).alias("torn"), F.max(F.when(overlap, F.col("order"))).alias("region"))
        torn = values.where("torn").select(TRACE, "region").distinct().withColumn("_masked", F.lit(True))
        out = values.join(torn, [TRACE, "region"], "left")
        return out.select(TRACE, "idx", F.when(F.col("_masked"), F.lit(fill).cast("double")).otherwise(F.col("x")).alias("x"))
    alive = rows.where(F.col("reach").isNull() | (F.col("last") > F.col("reach")))
    merged = alive.groupBy(TRACE, "idx").agg(F.max(F.struct("order", "x", "first", "reach", "last"))["order"].alias("order"), F.max_by(F.struct("x", "first", "reach", "last"), "order").alias("s"))
    if interpolation == 0:
        return merged.select(TRACE, "idx", F.col("s.x").alias("x"))
    width = F.col("s.reach") - F.col("s.first") + 1
    length = width if interpolation == -1 else F.least(width, F.lit(interpolation))
    merged = merged.withColumn("_n", F.coalesce(F.greatest(length, F.lit(0)), F.lit(0)))
    ends = alive.select(TRACE, F.col("order").alias("_order"), F.col("idx").alias("_idx"), F.col("x").alias("_x"))
    within = (F.col("_n") > 0) & (F.col("idx") - F.col("s.first") < F.col("_n"))
    line = merged.where(within)
    spots = line.select(TRACE, "order", (F.col("s.first") - 1).alias("_a"), F.least(F.col("s.first") + F.col("_n"), F.col("s.last")).alias("_b")).distinct()
    right = spots.join(ends.withColumnRenamed("_x", "_right"), (spots[TRACE] == ends[TRACE]) & (F.col("order") == F.col("_order")) & (F.col("_b") == F.col("_idx"))).select(spots[TRACE], "order", "_a", "_right")
    before = ends.groupBy(TRACE, F.col("_idx").alias("_a")).agg(F.collect_list(F.struct("_order", "_x")).alias("_l"))
    known = right.join(before, [TRACE, "_a"], "left")
    left = F.array_max(F.filter("_l", lambda s: s["_order"] < F.col("order")))["_x"]
    known = known.select(TRACE, "order", left.alias("_left"), "_right")
    out = merged.join(known, [TRACE, "order"], "left")
    value = F.col("_left") + (F.col("_right") - F.col("_left")) * (F.col("idx") - F.col("s.first") + 1) / (F.col("_n") + 1)
    return out.select(TRACE, "idx", F.coalesce(F.when(within, value), F.col("s.x")).alias("x"))


def trim(samples: DataFrame, start: Column, end: Column, nearest: bool = True, pad: bool = False, fill: float | None = None) -> DataFrame:
    """Samples (trace, idx, x) between two places, given in samples as columns of the trace's first and last idx (lo, hi).

    Ends between samples go to the nearest one, or else inwards; ``pad`` adds samples beyond the trace, null or ``fill``.
    """
    spans = samples.groupBy(TRACE).agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    low, high = (F.floor(start + 0.5), F.floor(end + 0.5)) if nearest else (F.ceil(start), F.floor(end))
    edges = spans.select(TRACE, "lo", "hi", low.cast("long").alias("_a"), high.cast("long").alias("_z"))
    kept = samples.join(edges, TRACE).where(F.col("idx").between(F.col("_a"), F.col("_z"))).select(TRACE, "idx", "x")
    if not pad:
        return kept
    runs = F.array(F.struct(F.col("_a").alias("a"), F.least(F.col("_z"), F.col("lo") - 1).alias("z")), F.struct(F.greatest(F.col("_a"), F.col("hi") + 1).alias("a"), F.col("_z").alias("z")))
    added = edges.select(TRACE, F.explode(runs).alias("r")).where("r.a <= r.z").select(TRACE, F.explode(F.sequence("r.a", "r.z")).alias("idx"))
    return kept.union(added.select(TRACE, "idx", F.lit(fill).cast("double")))


def window_times(spans: DataFrame, length: float, step: float, offset: float = 0.0, partial: bool = False) -> DataFrame:
    """(trace, window, start, end): windows of [start, end] every ``step`` from ``offset`` on; partial ones end with the span."""
    count = F.ceil((F.col("end") - F.col("start") - offset) / step - 0.001)
    windows = spans.where(count > 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("window"))
    begin = F.col("start") + offset + F.col("window") * step
    out = windows.select(TRACE, "window", begin.alias("_a"), F.least(begin + length, F.col("end")).alias("_z"))
    out = out if partial else out.where(F.col("_z") - F.col("_a") > 0.999 * length)
    return out.select(TRACE, "window", F.col("_a").alias("start"), F.col("_z").alias("end"))
