"""Operators on segments: rows of (trace, start, end, ...) with one row per contiguous piece."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRACE = "trace"
#: Samples of a trace that are worked on together.
BLOCK = 1 << 16


def gaps(segments: DataFrame, step: float, min_gap: float | None = None, max_gap: float | None = None) -> DataFrame:
    """Per trace, from each segment's end to the next start: (gap_start, gap_end, delta, samples); overlaps are negative.

    The end that counts is the greatest so far, so a gap that an earlier segment covers is none.
    """
    order = Window.partitionBy(TRACE).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    out = segments.withColumn("gap_start", reach).withColumn("gap_end", F.col("start"))
    delta = F.col("start") - (F.least(F.col("gap_start"), F.col("end")) + step)
    out = out.withColumn("delta", F.when(F.col("start") > F.col("gap_start"), F.col("start") - F.col("gap_start") - step).otherwise(delta))
    out = out.where(F.col("gap_start").isNotNull() & (F.abs("delta") > step / 1000)).withColumn("samples", F.round(F.abs(F.col("delta")) / step).cast("long"))
    if min_gap is not None:
        out = out.where(F.col("delta") >= min_gap)
    if max_gap is not None:
        out = out.where(F.col("delta") <= max_gap)
    return out.select(TRACE, "gap_start", "gap_end", "delta", "samples")


def islands(segments: DataFrame, margin: float) -> DataFrame:
    """Spans of segments that overlap or follow each other within ``margin``: (trace, start, end, segments)."""
    order = Window.partitionBy(TRACE).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") > reach + margin), 1).otherwise(0)
    numbered = segments.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(TRACE, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("segments")).drop("_island")


def cover(spans: DataFrame, start: float, end: float) -> DataFrame:
    """Share of [start, end] that the islands of a trace cover, and the gaps between them."""
    inside = spans.where((F.col("end") > start) & (F.col("start") < end))
    length = F.least("end", F.lit(end)) - F.greatest("start", F.lit(start))
    return inside.groupBy(TRACE).agg((F.sum(length) / (end - start)).alias("share"), (F.count("*") - 1).alias("gaps"))


def merge_samples(samples: DataFrame, method: int = 0) -> DataFrame:
    """One value per (trace, idx) from overlapping segments (``part``): equal values stay; of unequal ones, null (0) or the later part's (1)."""
    groups = samples.groupBy(TRACE, "idx")
    if method == 1:
        return groups.agg(F.max(F.struct("part", "x"))["x"].alias("x"))
    return groups.agg(F.when(F.count_distinct("x") == 1, F.max("x")).alias("x"))


def cleanup(samples: DataFrame) -> DataFrame:
    """Overlaps only where all segments agree: samples of traces without a conflict, once each."""
    merged = samples.groupBy(TRACE, "idx").agg(F.min("x").alias("x"), F.max("x").alias("_high"))
    torn = merged.where(F.col("x") != F.col("_high")).select(TRACE).distinct()
    return merged.join(torn, TRACE, "left_anti").drop("_high")


def grid(samples: DataFrame) -> DataFrame:
    """Every idx between a trace's first and last, null where no sample is."""
    ends = samples.groupBy(TRACE).agg(F.min("idx").alias("_a"), F.max("idx").alias("_b"))
    blocks = ends.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_a") / BLOCK), F.floor(F.col("_b") / BLOCK))))
    inside = F.sequence(F.greatest("_a", F.col("_block") * BLOCK), F.least("_b", F.col("_block") * BLOCK + BLOCK - 1))
    return blocks.select(TRACE, F.explode(inside).alias("idx")).join(samples, [TRACE, "idx"], "left")


def fill(samples: DataFrame, how: str | float) -> DataFrame:
    """Gaps of the full grid: 'latest', 'interpolate' or a constant."""
    full = grid(samples)
    if how not in ("latest", "interpolate"):
        return full.withColumn("x", F.coalesce("x", F.lit(float(how))))
    # the last value before and the first after a block come from one row per block
    full = full.withColumn("_block", F.floor(F.col("idx") / BLOCK))
    known = F.when(F.col("x").isNotNull(), F.struct("idx", "x"))
    edges = full.groupBy(TRACE, "_block").agg(F.max(known).alias("_z"), F.min(known).alias("_a"))
    past = Window.partitionBy(TRACE).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    future = Window.partitionBy(TRACE).orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(TRACE, "_block", F.last("_z", ignorenulls=True).over(past).alias("_before"), F.last("_a", ignorenulls=True).over(future).alias("_after"))
    full = full.join(edges, [TRACE, "_block"])
    up = Window.partitionBy(TRACE, "_block").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    left = F.coalesce(F.last(known, ignorenulls=True).over(up), F.col("_before"))
    if how == "latest":
        return full.select(TRACE, "idx", left["x"].alias("x"))
    down = Window.partitionBy(TRACE, "_block").orderBy(F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, 0)
    right = F.coalesce(F.last(known, ignorenulls=True).over(down), F.col("_after"))
    full = full.withColumn("_l", left).withColumn("_r", right)
    line = F.col("_l.x") + (F.col("_r.x") - F.col("_l.x")) * (F.col("idx") - F.col("_l.idx")) / (F.col("_r.idx") - F.col("_l.idx"))
    return full.select(TRACE, "idx", F.coalesce("x", line).alias("x"))


def epoch_join(events: DataFrame, epochs: DataFrame, key: str, at: str, bucket: int, start: str = "start", end: str = "end") -> DataFrame:
    """Events with the epochs [start, end) of their key that hold their time; null end: open.

    Epochs are dealt to buckets of time, so the join is one of equal keys; an open epoch goes on to the last event's bucket.
    """
    last = events.agg(F.max(F.floor(F.col(at) / bucket)).alias("_last"))
    low, high = F.floor(F.col(start) / bucket), F.least(F.coalesce(F.floor(F.col(end) / bucket), F.col("_last")), F.col("_last"))
    dealt = epochs.crossJoin(F.broadcast(last)).where(low <= high).withColumn("_bucket", F.explode(F.sequence(low, high))).drop("_last")
    timed = events.withColumn("_bucket", F.floor(F.col(at) / bucket))
    hit = timed.join(dealt, [key, "_bucket"]).where((F.col(at) >= F.col(start)) & (F.col(end).isNull() | (F.col(at) < F.col(end))))
    return hit.drop("_bucket")


def trim_common(rows: DataFrame, group: list[str], channel: str, at: str) -> DataFrame:
    """Rows of a group between the latest start and the earliest end of its channels."""
    spans = rows.groupBy(*group, channel).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    common = spans.groupBy(*group).agg(F.max("_lo").alias("_lo"), F.min("_hi").alias("_hi"))
    return rows.join(common, group).where(F.col(at).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def merge_checks(rows: DataFrame, key: str, headers: list[str]) -> DataFrame:
    """How many values of each header the segments of a key have, and the first header that differs among them."""
    counts = rows.groupBy(key).agg(*[F.countDistinct(h).alias(f"n_{h}") for h in headers])
    return counts.withColumn("problem", F.coalesce(*[F.when(F.col(f"n_{h}") > 1, F.lit(f"differing {h}")) for h in headers]))


def active(start: Column, end: Column, time: Column) -> Column:
    """Closed test of a time against an epoch with open ends."""
    return (start.isNull() | (start <= time)) & (end.isNull() | (end >= time))


def archive_files(paths: DataFrame) -> DataFrame:
    """Codes and day of daily files named .../network.station.location.channel.D.year.day; other paths give no row."""
    name = F.element_at(F.split("path", "/"), -1)
    parts = F.split(name, "[.]")
    day = F.date_add(F.make_date(F.get(parts, 5).cast("int"), F.lit(1), F.lit(1)), F.get(parts, 6).cast("int") - 1)
    codes = [F.get(parts, i).alias(c) for i, c in enumerate(("network", "station", "location", "channel"))]
    return paths.where(name.rlike(r"^[^.]*[.][^.]*[.][^.]*[.][^.]*[.][A-Z][.][0-9]{4}[.][0-9]{3}$")).select("path", *codes, day.alias("day"))
