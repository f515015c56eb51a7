"""Phase picks by the thresholds of a characteristic function whose mean and deviation follow the noise.

The function stands on running sums, which are additive over blocks of a trace. Only one thing is not: a sample counts for mean
and deviation if its own value, by those of the samples before, is small. Blocks settle that apart, each from the sums with
which it is entered; as these change with what the blocks before leave out, the pass is repeated until no block changes any
more. Triggers are runs of high samples with short pauses, found by frames, and their figures are aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .series import BLOCK, IDX, TRACE, X, moving, running, with_halo


def energy_function(df: DataFrame, rate: float, preset: int) -> DataFrame:
    """(trace, idx, x, rise, energy) from sample 1 on: the square of x^2 + w rise^2, w being the ratio of both sums so far.

    rise is the slope; the sums start with those of samples 2 to ``preset``.
    """
    rows = df.where(F.col(IDX) >= 1).select(TRACE, IDX, F.col(X).cast("double").alias(X))
    rows = moving(rows, 1, 0, rise=lambda r: (F.col(X) - F.first(X).over(r(-1, 0))) * rate)
    early = (F.col(IDX) >= 2) & (F.col(IDX) <= preset)
    first = rows.groupBy(TRACE).agg(*[F.sum(F.when(early, c * c).otherwise(0.0)).alias(n) for c, n in ((F.col(X), "_y0"), (F.col("rise"), "_t0"))])
    sums = running(rows, _y=F.col(X) * F.col(X), _t=F.col("rise") * F.col("rise")).join(first, TRACE)
    squares = F.col(X) * F.col(X), F.col("rise") * F.col("rise")
    ratio = F.coalesce(F.try_divide(F.col("_y0") + F.col("_y") - squares[0], F.col("_t0") + F.col("_t") - squares[1]), F.lit(0.0))
    whole = squares[0] + ratio * squares[1]
    return sums.select(TRACE, IDX, X, "rise", (whole * whole).alias("energy"))


def _settle(idx: np.ndarray, energy: np.ndarray, entry: tuple[float, float, float], start: tuple[float, float] | None, limit: float, free: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(deviation, counts, sums): values by mean and deviation of what counted before; counts: which samples count.

    start: the deviation that holds for the first sample of the trace, given in its first block.
    """
    counts = np.ones(len(idx), bool)
    while True:
        n, s, q = (np.concatenate([[e], e + np.cumsum(v * counts)]) for e, v in zip(entry, (np.ones(len(idx)), energy, energy * energy), strict=True))
        sound = n[:-1] > 0
        mean = np.where(sound, s[:-1] / np.maximum(n[:-1], 1), 0.0)
        spread = np.where(sound, (n[:-1] * q[:-1] - s[:-1] ** 2) / np.maximum(n[:-1], 1) ** 2, 0.0)
        deviation = np.where(spread >= 0, np.sqrt(np.maximum(spread, 0.0)), 1.0)
        if start is not None:
            deviation[0] = start[0]
        value = np.where(deviation > 0, (energy - mean) / np.where(deviation > 0, deviation, 1.0), np.nan)
        held = np.maximum.accumulate(np.where(np.isnan(value), 0, np.arange(len(value))))
        value = value[held]  # without a deviation the value before stays
        again = (value < limit) | (idx <= free)
        if (again == counts).all():
            return value, counts, np.array([n[-1], s[-1], q[-1]]) - np.array(entry)
        counts = again


def noise_values(energies: DataFrame, limit: float, preset: int, block: int = BLOCK) -> DataFrame:
    """(trace, idx, value): (energy - mean) / deviation of the samples before that counted: the first 2 ``preset`` and those below ``limit``."""
    begun = energies.where(F.col(IDX) <= preset).groupBy(TRACE).agg(F.sum(X).alias("_s"), F.sum(F.when(F.col(IDX) >= 2, F.col(X) * F.col(X)).otherwise(0.0)).alias("_q"))
    first = F.lit(float(preset)) * F.col("_q") - F.col("_s") * F.col("_s")
    begun = begun.select(TRACE, F.when(first / (preset * preset) > 0, F.sqrt(first) / (preset * preset)).otherwise(1.0).alias("_start"))
    blocks = energies.withColumn("_block", F.floor((F.col(IDX) - 1) / block)).groupBy(TRACE, "_block").agg(F.array_sort(F.collect_list(F.struct(IDX, "energy"))).alias("_e"))
    blocks = written(blocks.join(begun, TRACE).select(TRACE, "_block", F.col(f"_e.{IDX}").alias("_idx"), F.col("_e.energy").alias("_energy"), F.when(F.col("_block") == 0, F.col("_start")).alias("_start")))
    zeros = F.array(*[F.lit(0.0)] * 3)
    known = blocks.select(TRACE, "_block", zeros.alias("_sums"))

    def entries(sums: DataFrame) -> DataFrame:
        before = Window.partitionBy(TRACE).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        return sums.select(TRACE, "_block", F.array(*[F.coalesce(F.sum(F.col("_sums")[k]).over(before), F.lit(0.0)) for k in range(3)]).alias("_entry"), F.col("_sums").alias("_old"))

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, changed = [], []
            for idx, energy, start, entry, old in zip(*(batch.column(c) for c in ("_idx", "_energy", "_start", "_entry", "_old")), strict=True):
                start = start.as_py()
                new = _settle(np.asarray(idx.values), np.asarray(energy.values), tuple(entry.as_py()), None if start is None else (start,), limit, 2 * preset)[2]
                sums.append(new.tolist())
                changed.append(not np.allclose(new, old.as_py(), rtol=1e-13, atol=0.0))
            yield pa.record_batch({TRACE: batch.column(TRACE), "_block": batch.column("_block"), "_sums": pa.array(sums, pa.list_(pa.float64())), "_changed": pa.array(changed, pa.bool_())})

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for idx, energy, start, entry in zip(*(batch.column(c) for c in ("_idx", "_energy", "_start", "_entry")), strict=True):
                start = start.as_py()
                values.append(_settle(np.asarray(idx.values), np.asarray(energy.values), tuple(entry.as_py()), None if start is None else (start,), limit, 2 * preset)[0])
            take = pa.array(np.repeat(np.arange(len(values)), [len(v) for v in values]))
            yield pa.record_batch({TRACE: batch.column(TRACE).take(take), IDX: batch.column("_idx").flatten(), "value": pa.array(np.concatenate(values) if values else np.zeros(0))})

    kind = dict(blocks.dtypes)[TRACE]
    while True:
        passed = written(blocks.join(entries(known), [TRACE, "_block"]).mapInArrow(settled, f"{TRACE} {kind}, _block long, _sums array<double>, _changed boolean"))
        known = passed.drop("_changed")
        if not passed.where("_changed").limit(1).count():
            break
    return blocks.join(entries(known), [TRACE, "_block"]).mapInArrow(valued, f"{TRACE} {kind}, {IDX} long, value double")


#: Ratios of signal to noise above which a pick has quality 3, 2, 1 and 0.
QUALITIES = (1.5, 4.0, 6.0, 8.0)


def first_picks(df: DataFrame, rate: float, down: int, up: int, on: float, limit: float, preset: int, duration: int, block: int = BLOCK) -> DataFrame:
    """(trace, pick, phase) of traces (trace, idx, x), of which sample 0 is not looked at.

    A trigger starts where the value of ``noise_values`` exceeds ``on`` after twice ``preset`` samples, and ends with its last high
    sample before ``down`` + 1 low ones. Its length counts, two more for each sample above four times ``on`` that follows a high
    one, and one more if the trace ends first. The first with ``up`` or more is the pick, one past its first sample. phase is I or E
    (impulsive, emergent), P, U or D by the slope at the first sample, and 0 to 4 by the largest amplitude to ``duration`` samples
    later over that up to the first trigger. Without a pick: 1 and an empty phase.
    """
    energies = written(energy_function(df, rate, preset))
    values = noise_values(energies, limit, preset, block)
    high = values.where((F.col("value") > on) & (F.col(IDX) > 2 * preset))
    before = Window.partitionBy(TRACE, "_block").orderBy(IDX)
    near = with_halo(high, down + 1, 0).withColumn("_last", F.max(IDX).over(before.rangeBetween(-(down + 1), -1))).where("_own")
    marked = near.select(TRACE, IDX, F.col("_last").isNull().cast("int").alias("_fresh"), ((F.col("value") > 4 * on) & F.coalesce(F.col("_last") == F.col(IDX) - 1, F.lit(False))).cast("int").alias("_strong"))
    runs = running(marked, _run=F.col("_fresh")).groupBy(TRACE, "_run").agg(F.min(IDX).alias("_from"), F.max(IDX).alias("_to"), F.sum("_strong").alias("_bonus"))
    ends = energies.groupBy(TRACE).agg(F.max(IDX).alias("_n"), F.max(F.abs(X)).alias("_scale"))
    runs = runs.join(ends.select(TRACE, "_n"), TRACE)
    opened = F.col("_to") + down + 1 > F.col("_n")
    length = F.col("_to") - F.col("_from") + 1 + 2 * F.col("_bonus") + opened.cast("int")
    figures = runs.withColumns({"_long": length >= up, "_decided": F.when(opened, F.col("_n")).otherwise(F.col("_to") + down + 1)}).groupBy(TRACE)
    picked = figures.agg(F.min("_from").alias("_first"), F.min(F.when(F.col("_long"), F.struct("_from", "_decided"))).alias("_p")).where("_p IS NOT NULL")
    bounds = picked.select(TRACE, "_first", F.col("_p._from").alias("_from"), F.least(F.col("_p._decided"), F.col("_p._from") + duration).alias("_until"))
    size = F.abs((256.0 * F.col(X) / F.col("_scale") + 0.5).cast("long"))
    held = energies.join(bounds, TRACE).join(ends.select(TRACE, "_scale"), TRACE)
    sizes = held.groupBy(TRACE).agg(
        F.first("_from").alias("_from"),
        F.max(F.when(F.col(IDX) <= F.col("_first"), size)).alias("_noise"),
        F.max(F.when(F.col(IDX) <= F.col("_until"), size)).alias("_signal"),
        F.max(F.when(F.col(IDX) == F.col("_from"), F.signum("rise"))).alias("_sign"),
    )
    ratio = F.coalesce(F.try_divide(F.col("_signal").cast("double"), F.col("_noise")), F.lit(float("inf")))
    grade = F.lit(4) - sum((F.when(ratio > q, 1).otherwise(0) for q in QUALITIES), F.lit(0))
    way = F.when(F.col("_sign") > 0, "U").when(F.col("_sign") < 0, "D")
    phase = F.concat(F.when(grade <= 1, "IP").otherwise("EP"), F.coalesce(F.concat(way, grade.cast("string")), F.lit("")))
    return ends.select(TRACE).join(sizes.select(TRACE, (F.col("_from") + 1).alias("pick"), phase.alias("phase")), TRACE, "left").select(TRACE, F.coalesce("pick", F.lit(1).cast("long")).alias("pick"), F.coalesce("phase", F.lit("")).alias("phase"))
